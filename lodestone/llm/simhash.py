"""SimHash near-dedup with BK-trees over Hamming distance.

Fingerprints: a bit is set if more than half of the document's 4-word shingles set
it in their XXH64.  Two fingerprints within ``radius`` bits must agree on at least
one of radius + 1 pieces of the 64 bits (or on several of more pieces, once shards
would grow large), so fingerprints are shuffled to one shard per choice of pieces
and value, and each shard is searched with a BK-tree whose children are
keyed by their integer distance to the parent; only edges within the radius are
followed.  Trees stay with their shard: a broadcast of all of them would grow with
the corpus.  A shard beyond ``SHARD_ROWS`` is cut into parts, and each pair of
parts is a cell of its own with a tree over one side, so a large group of near
copies spreads over many tasks.  A cell yields a spanning forest of its links,
never all pairs.

Equal fingerprints are collapsed first, with a map-side combine.  Links join into
components by alternating star steps over tables in the shared folder, each a grouped
minimum that is written and a join of plain tables, which Spark splits at a hub.

Edge cases: null text counts as empty; a document without words has fingerprint
zero and is linked like any other; fewer words than a shingle give one shingle of
them all.  Rows that repeat a doc_id each get a row; null ids never name a
component unless all ids in it are null.  A very long text is hashed whole, its bits counted in
slices.  Extra columns are ignored, whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.components import components

from . import common

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints in one cell's tree, at most about this many on either side.
SHARD_ROWS = 8192
LEAF = 48


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the ASCII-lower-cased text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0], starts[1:] = 0, ends[:-1] + 1
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    return np.array(found, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounds the unpacked bits of a very long text
        part = hashes[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED,
                 row_col: str | None = None) -> DataFrame:
    """(row, doc_id, fp): fp holds the 64 bits as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), width, seed)) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], pa.array(np.array(found, np.uint64).view(np.int64))], ["row", "doc_id", "fp"])

    return common.text_rows(df, id_col, text_col, row_col=row_col).mapInArrow(each, "row long, doc_id long, fp long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class BKTree:
    """Distinct fingerprints; children are keyed by their distance to the parent."""

    def __init__(self, items: np.ndarray, at: np.ndarray | None = None):
        at = np.arange(len(items)) if at is None else at
        self.children: dict[int, BKTree] = {}
        self.leaf = len(at) <= LEAF
        self.at = at if self.leaf else at[:1]
        self.own = items[self.at]
        if not self.leaf:
            rest = at[1:]
            far = hamming(items[rest], self.own[0])
            for d in np.unique(far):
                self.children[int(d)] = BKTree(items, rest[far == d])

    def search(self, queries: np.ndarray, radius: int, at: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, item positions) within the radius, node by node."""
        stack = [(self, np.arange(len(queries)) if at is None else at)]
        while stack:
            node, at = stack.pop()
            far = hamming(queries[at][:, None], node.own[None, :])
            i, j = np.nonzero(far <= radius)
            if len(i):
                yield at[i], node.at[j]
            for d, child in node.children.items():
                near = np.abs(far[:, 0].astype(np.int64) - d) <= radius
                if near.any():
                    stack.append((child, at[near]))


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a and b; every entry of ``parent`` is a root before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links over positions of ``fps``: a forest of what a cell's tree finds."""
    parent = np.arange(len(fps))
    tree = BKTree(fps[left])
    for at in range(0, len(right), 512):
        block = right[at : at + 512]
        for q, t in tree.search(fps[block], radius):
            a, b = block[q], left[t]
            if (other := a != b).any():
                _hook(parent, a[other], b[other])
    linked = np.nonzero(parent != np.arange(len(fps)))[0]
    return linked, parent[linked]


def _masks(n: int, radius: int, shard_rows: int) -> list[int]:
    """Bit masks, one of which leaves any two values within the radius equal.

    The 64 bits are cut into m pieces; differing bits spoil at most ``radius`` of
    them, so some m - radius pieces agree.  m grows until shards are small.
    """
    m = radius + 1
    while m < radius + 4 and n > shard_rows * 2 ** (64 * (m - radius) / m):
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    piece = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(m)]
    masks = [sum(piece[i] for i in chosen) for chosen in combinations(range(m), m - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links among distinct ``fp`` that connect all that lie within the radius."""
    masks = _masks(distinct.count(), radius, SHARD_ROWS)
    keyed = [F.struct(F.lit(i).alias("piece"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)]
    shards = distinct.select("fp", F.explode(F.array(*keyed)).alias("s")).select("s.piece", "s.value", "fp")
    sizes = shards.groupBy("piece", "value").count().filter("count > 1")
    sizes = sizes.withColumn("parts", F.ceil(F.col("count") / SHARD_ROWS).cast("int")).drop("count")
    shards = shards.join(sizes, ["piece", "value"])
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(
        F.least(o, F.col("part")).alias("low"), F.greatest(o, F.col("part")).alias("high")))
    shards = shards.withColumn("part", part).select("piece", "value", "part", "fp", F.explode(cells).alias("cell"))
    shards = shards.select("piece", "value", "cell.low", "cell.high", "part", "fp")
    keys = ["piece", "value", "low", "high"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rest) == 0:
                continue
            k = rest[keys].to_numpy()
            new = np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1
            bounds = [0, *new.tolist()]
            if len(bounds) > 1:
                yield from cells_of(rest, bounds)
            rest = rest.iloc[bounds[-1] :]
        if rest is not None and len(rest):
            yield from cells_of(rest, [0, len(rest)])

    def cells_of(rows: pd.DataFrame, bounds: list[int]) -> Iterator[pd.DataFrame]:
        fps, part = rows["fp"].to_numpy().view(np.uint64), rows["part"].to_numpy()
        low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
        a, b = [], []
        for s, e in zip(bounds, bounds[1:], strict=False):
            own = fps[s:e]
            if low[s] == high[s]:
                x = y = np.arange(e - s)
            else:
                x, y = np.nonzero(part[s:e] == low[s])[0], np.nonzero(part[s:e] == high[s])[0]
            if len(x) and len(y):
                m, r = _forest(own, x, y, radius)
                a.append(own[m])
                b.append(own[r])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return shards.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(each, "a long, b long").distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED,
                radius: int = RADIUS, row_col: str | None = None) -> DataFrame:
    """One row per row of ``df``: row, doc_id, fp, component_id (least id), first (row that stays)."""
    docs = common.keep(fingerprints(df, id_col, text_col, width, seed, row_col), "fingerprints")
    distinct = common.keep(docs.select("fp").distinct(), "distinct-fp")
    roots = common.keep(components(links(distinct, radius)), "fp-roots")
    docs = docs.join(roots, docs["fp"] == roots["node"], "left").select("row", "doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("least")
    groups = common.keep(docs.groupBy("root").agg(least), "components")  # a plain table, so that the join can be split
    return docs.join(groups, "root").select("row", "doc_id", "fp", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("first"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
