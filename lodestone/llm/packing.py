"""Packing tokenised documents into fixed windows by non-negative least squares.

A document of n tokens gives n div W full pieces, a sequence each, and a remainder
of n mod W.  Over the histogram of remainders (W - 1 counts at most, whatever the
corpus) all pairs and a spread of triples of lengths that fill a window are
enumerated; non-negative least squares by coordinate descent finds how often to
use each, the solution is rounded down to what the histogram holds, and what is
left is packed greedily, longest first, cut where a window fills.

Documents of one length are told apart by a rank, counted inside the partition that
read them and offset by the counts of the partitions before; so a length that a
third of all documents share is spread like any other.

Edge cases: null text counts as empty and still has the closing id; rows that
repeat a doc_id are packed separately; a very long text is tokenised whole and cut into
pieces; extra columns are ignored, whatever their names; an empty table gives an empty one;
only the last sequence may be padded.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import ChainMap
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Parts, and pieces of parts, whose ids a worker remembers: the first it meets, so mostly frequent ones.
MEMORY = 700_000
#: White space where cutting before a space would change the tokens.
UNCUTTABLE = re.compile(r"\s (?:\s|$)")
#: Parts of letters that every Unicode version counts as such, digits, ASCII marks and
#: line ends, and how the pre-tokenizer's published pattern cuts them.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
PLAIN = re.compile(rf"(?!\n)[{LETTER}!-~\n]+")
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^ \n0-9{LETTER}]+|\n+(?!.)|\n+")
#: Second parts tried for each first part of a triple.
TRIPLES = 8
SWEEPS = 30


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer always cuts before a single space that precedes
    other characters, so the ids of space-led parts are remembered.  A new part of
    plain characters is cut as the pre-tokenizer does, and each of its pieces goes
    through the tokenizer once; any other new part goes through it whole.  So do
    texts with special tokens or with runs of white space that end in a space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, texts: list[str], led: str) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast([led + p for p in texts], add_special_tokens=False)
        return {p: array("I", f.ids).tobytes() for p, f in zip(texts, found, strict=True)}

    def _new_parts(self, new: list[str]) -> dict[str, bytes]:
        cut = {p: PIECES.findall(" " + p) for p in new if PLAIN.fullmatch(p)}
        fresh = self._ids([x for x in {x for own in cut.values() for x in own} if x not in self.pieces], "")
        if len(self.pieces) < MEMORY:
            self.pieces.update(fresh)
        get = ChainMap(fresh, self.pieces).__getitem__ if len(self.pieces) >= MEMORY else self.pieces.__getitem__
        found = {p: get(own[0]) if len(own) == 1 else b"".join(map(get, own)) for p, own in cut.items()}
        if len(found) < len(new):
            found |= self._ids([p for p in new if p not in cut], " ")
        return found

    def encode(self, text: str) -> bytes:
        if UNCUTTABLE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        ids = list(map(self.parts.get, rest))
        if None in ids:
            found = self._new_parts(list({p for p, x in zip(rest, ids, strict=True) if x is None}))
            if len(self.parts) < MEMORY:
                self.parts.update(found)
            ids = [found[p] if x is None else x for p, x in zip(rest, ids, strict=True)]
        return (self.whole(first) if first else b"") + b"".join(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, kept from task to task with what it remembers."""
    return Encoder(path)


def tokenize(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """(row, doc_id, n, full_crcs, rest_crc, rest_ids) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out: dict[str, list] = {"n": [], "full_crcs": [], "rest_crc": [], "rest_ids": []}
            for text in b["text"]:
                ids = own.encode(text.as_py()) + end
                n, view = len(ids) // 4, memoryview(ids)
                cut = n // window * window * 4
                out["n"].append(n)
                out["full_crcs"].append([zlib.crc32(view[i : i + 4 * window]) for i in range(0, cut, 4 * window)])
                out["rest_crc"].append(zlib.crc32(view[cut:]))
                rest = np.frombuffer(view[cut:], "<u4")
                out["rest_ids"].append((rest.astype("<u2") if len(rest) == 0 or rest.max() < 1 << 16 else rest).tobytes())
            kinds = {"n": pa.int64(), "full_crcs": pa.list_(pa.int64()), "rest_crc": pa.int64(), "rest_ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({"row": b["row"], "doc_id": b["doc_id"]} | {c: pa.array(out[c], t) for c, t in kinds.items()})

    return common.text_rows(df, id_col, text_col).mapInArrow(
        each, "row long, doc_id long, n long, full_crcs array<long>, rest_crc long, rest_ids binary")


def fillings(lengths: list[int], window: int) -> list[tuple[int, ...]]:
    """Pairs and some triples of the given lengths that add up to the window."""
    there = set(lengths)
    found: list[tuple[int, ...]] = [(a, window - a) for a in lengths if 2 * a <= window and window - a in there]
    for a in lengths:
        seconds = [b for b in range(a, (window - a) // 2 + 1) if b in there and window - a - b in there] if 3 * a <= window else []
        found += [(a, b, window - a - b) for b in seconds[:: max(1, len(seconds) // TRIPLES)][:TRIPLES]]
    return found


def solve(histogram: dict[int, int], window: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Repeat counts of fillings, rounded to what is there, and the lengths left over."""
    use = fillings(sorted(histogram), window)
    gap = {r: float(n) for r, n in histogram.items()}
    x = [0.0] * len(use)
    for _ in range(SWEEPS):
        for i, parts in enumerate(use):
            norm = sum(parts.count(p) for p in parts)
            new = max(0.0, x[i] + sum(gap[p] for p in parts) / norm)
            if new != x[i]:
                for p in parts:
                    gap[p] -= new - x[i]
                x[i] = new
    left, counts = dict(histogram), []
    for parts, v in sorted(zip(use, x, strict=True), key=lambda e: -e[1]):
        times = min(int(v + 0.5), *(left[p] // parts.count(p) for p in parts))
        if times > 0:
            counts.append((parts, times))
            for p in parts:
                left[p] -= times
    for parts in use:  # whole windows that rounding has left
        times = min(left[p] // parts.count(p) for p in parts)
        if times > 0:
            counts.append((parts, times))
            for p in parts:
                left[p] -= times
    return counts, left


def _slots(histogram: dict[int, int], window: int) -> tuple[list[tuple], int]:
    """Rows (rest, first, last, sequence, offset, stream): which ranks of a length go where.

    For fillings, rank r goes to sequence + r - first at the offset.  For what is
    left, ``stream`` is the place of rank ``first`` in one stream that is cut into
    windows from ``sequence`` on.
    """
    counts, left = solve(histogram, window)
    used = dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    for parts, times in counts:
        offset = 0
        for p in parts:
            rows.append((p, used[p], used[p] + times - 1, sequence, offset, None))
            used[p] += times
            offset += p
        sequence += times
    stream = 0
    for p in sorted(left, reverse=True):
        if left[p]:
            rows.append((p, used[p], used[p] + left[p] - 1, sequence, 0, stream))
            stream += left[p] * p
    return rows, sequence


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    docs = common.keep(tokenize(df, tokenizer_path, id_col, text_col, window, end_id), "tokens")
    part = F.shiftright("row", 33)  # the partition that read the row
    plan = docs.select("row", "n", part.alias("part"), F.expr(f"n div {window}").alias("full"), (F.col("n") % window).alias("rest"))

    before = Window.unboundedPreceding
    sizes = plan.groupBy("part").agg(F.sum("full").alias("total"))
    sizes = sizes.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(before, -1)), F.lit(0)).alias("full_base"), "total")
    sizes = common.keep(sizes, "full-bases")
    full_total = sizes.agg(F.sum("total")).first()[0] or 0

    counts = common.keep(plan.groupBy("part", "rest").agg(F.count("*").alias("there")), "rest-counts")
    histogram = {r["rest"]: r["n"] for r in counts.filter("rest > 0").groupBy("rest").agg(F.sum("there").alias("n")).collect()}  # window - 1 rows at most
    bases = counts.select("part", "rest", F.coalesce(F.sum("there").over(
        Window.partitionBy("rest").orderBy("part").rowsBetween(before, -1)), F.lit(0)).alias("rest_base"))
    slots, used = _slots(histogram, window)
    slots = spark.createDataFrame(slots, "rest long, first long, last long, sequence long, at long, stream long")

    plan = plan.withColumn("full_before", F.coalesce(F.sum("full").over(Window.partitionBy("part").orderBy("row").rowsBetween(before, -1)), F.lit(0)))
    plan = plan.withColumn("inner", F.row_number().over(Window.partitionBy("part", "rest").orderBy("row")) - 1)
    plan = plan.join(sizes.drop("total"), "part").join(bases, ["part", "rest"])
    plan = plan.withColumn("rank", F.col("rest_base") + F.col("inner"))
    plan = plan.withColumnRenamed("rest", "own").join(  # a few rows a length, however large the corpus
        F.broadcast(slots), (F.col("own") == F.col("rest")) & F.col("rank").between(F.col("first"), F.col("last")), "left")
    plan = plan.withColumn("place", F.col("stream") + (F.col("rank") - F.col("first")) * F.col("own"))
    plan = plan.withColumn("ahead", F.coalesce(F.expr(f"place div {window}"), F.col("rank") - F.col("first")))
    plan = plan.withColumn("at", F.coalesce(F.col("place") % window, F.col("at")))
    crosses = F.col("place").isNotNull() & (F.col("at") + F.col("own") > window)
    plan = common.keep(plan.select(
        "row", (F.col("full_base") + F.col("full_before")).alias("full_sequence"),
        (full_total + F.col("sequence") + F.col("ahead")).alias("sequence"), "at",
        F.when(crosses, window - F.col("at")).alias("cut")), "plan")

    docs = docs.join(plan, "row")
    full = docs.select("row", "doc_id", "n", "full_sequence", F.posexplode("full_crcs").alias("k", "crc")).select(
        "row", "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "crc", "n",
        (F.col("full_sequence") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = F.col("n") % window
    whole = docs.filter("sequence is not null and cut is null").select(
        "row", "doc_id", (F.col("n") - rest).alias("start"), rest.alias("length"), F.col("rest_crc").alias("crc"), "n",
        F.col("sequence").alias("sequence_id"), F.col("at").alias("offset"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for r in b.to_pylist():
                start, at = r["n"] - r["rest"], 4 * r["cut"]
                ids = np.frombuffer(r["rest_ids"], "<u2" if len(r["rest_ids"]) == 2 * r["rest"] else "<u4").astype("<u4").tobytes()
                head = (r["row"], r["doc_id"], start, r["cut"], zlib.crc32(ids[:at]), r["n"], r["sequence"], r["at"])
                tail = (r["row"], r["doc_id"], start + r["cut"], r["rest"] - r["cut"], zlib.crc32(ids[at:]), r["n"], r["sequence"] + 1, 0)
                for column, x, y in zip(out, head, tail, strict=True):
                    column += [x, y]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    names = ["row", "doc_id", "start", "length", "crc", "n", "sequence_id", "offset"]
    cut = docs.filter("cut is not null").select("row", "doc_id", "n", rest.alias("rest"), "sequence", "at", "cut", "rest_ids").mapInArrow(
        both, ", ".join(f"{c} long" for c in names))
    return full.union(whole).union(cut).select(
        "row", "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and where it lies."""
    import public_tokenizers

    found = pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.drop("row")
