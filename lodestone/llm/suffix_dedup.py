"""Suffix-array dedup: remove bytes covered by a long string that also starts elsewhere.

Windows of two lengths are judged at once: those of ``length`` bytes, which are removed,
and shorter ones of ``short`` bytes, which tell passages of ``PASSAGE_WORDS`` words that
repeat.  Every short window is ruled by one anchor: the ``GRAM``-byte string in it with
the least hash (the last of equals); a long window by that of the short one that it
starts with.  Equal windows have equal anchors at equal offsets, so only suffixes that
start at anchors of equal content need to be brought together, about one in 90 bytes,
and only anchors whose content occurs twice.  A record holds an anchor, the range of
windows that it rules and their bytes.

Equal records are told by a 128-bit BLAKE2 digest and settled by counting; only one of
each kind, and only where an anchor has several kinds, takes its bytes along.  Records
with one anchor content then meet in one task.  Its shards are sorted by the bytes from
the anchor on, each row keeping the bytes before it (what the Burrows-Wheeler transform
keeps of a suffix).  Sorted shards are merged by refining their interleave eight bytes
at a time: a class of rows equal so far is split by stable merging, rows alone in a
class are left, and the split gives the common prefix of neighbours.  The same is done
for the bytes before the anchor.  A window that starts l bytes before the anchor is
repeated if its row shares both the class of length - l bytes after and the class of
l bytes before with another row.

Nothing is sorted whole and no pairs are formed.  A content that has too many unlike
records (a passage that a third of all documents share) has its window ranges halved,
and the halves are dealt again by the bytes that all windows of a half have in common;
at one window equal records have all collapsed.  Whole texts that occur twice are
settled by their SHA-256 and stand in once.

Edge cases: null text is empty; texts shorter than ``length`` lose nothing; a very long
text is cut into records, none longer than twice ``length``; rows that repeat are copies
of each other; extra columns are ignored, whatever their names; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 400
#: Windows in which passages are told, and how many words a passage has at least.
SHORT = 240
PASSAGE_WORDS = 51
GRAM = 64
#: Unlike records of one anchor content that meet in one task, at most.
GROUP_ROWS = 10_000
#: Records that a task merges at a time, at least.
BUNDLE_ROWS = 20_000
SHARD_ROWS = 4096
#: Bytes of a text whose anchors are sought at a time.
SPAN = 1 << 19
LOW = (1 << 20) - 1
NAMES = ("key", "tid", "pos", "first", "last", "size", "h1", "h2")
RECORD = ", ".join(f"{n} long" for n in NAMES)
STARTS = "tid long, start long, end long, long boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


BYTE_HASH = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram``-byte string (gram a power of two)."""
    h, m, c = BYTE_HASH[data], 1, 0x9E3779B97F4A7C15
    while m < gram:
        h = h[:-m] * np.uint64(c) + h[m:]
        m, c = 2 * m, c * c % (1 << 64)
    return _mixed(h)


def anchors(data: np.ndarray, length: int = SHORT, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(hash, pos, first, last): windows starting from first to last are ruled by pos."""
    width = length - gram + 1
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(data) - length + 1), SPAN):
        part = data[at : at + SPAN + length - 1]
        h = gram_hashes(part, gram)
        low = (h & np.uint64(~LOW & (1 << 64) - 1)) | (np.uint64(LOW) - np.arange(len(h), dtype=np.uint64))
        m = 1
        while 2 * m <= width:
            low, m = np.minimum(low[:-m], low[m:]), 2 * m
        if m < width:
            low = np.minimum(low[: len(low) - (width - m)], low[width - m :])
        where = (np.uint64(LOW) - (low & np.uint64(LOW))).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(where[1:] != where[:-1])[0] + 1])
        last = np.append(first[1:] - 1, len(where) - 1)
        parts.append((h[where[first]].view(np.int64), where[first] + at, first + at, last + at))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def refine(order: np.ndarray, keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows and the common prefix in bytes of each with the one before.

    ``order`` may hold sorted runs (shards) one after another: each step only merges
    them.  The prefix is -1 where the key changes and the full width for equal rows.
    """
    order = order[np.argsort(keys[order], kind="stable")]
    n, width = len(order), words.shape[1]
    k = keys[order]
    starts = np.ones(n, bool)
    starts[1:] = k[1:] != k[:-1]
    lcp = np.where(starts, -1, 8 * width)
    for w in range(width):
        cls = np.cumsum(starts)
        alone = starts & np.append(starts[1:], True)
        at = np.nonzero(~alone)[0]
        if not len(at):
            break
        own, v = cls[at], words[order[at], w]
        if ((v[1:] == v[:-1]) | (own[1:] != own[:-1])).all():
            continue
        by = np.lexsort((v, own))
        order[at], v = order[at][by], v[by]
        split = np.nonzero((own[1:] == own[:-1]) & (v[1:] != v[:-1]))[0] + 1
        diff = v[split] ^ v[split - 1]
        starts[at[split]] = True
        lcp[at[split]] = 8 * w + sum((diff >> np.uint64(64 - 8 * b) == 0).astype(np.int64) for b in range(1, 8))
    return order, lcp


def merged(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort shards of rows, then merge them by interleave refinement."""
    shards = [np.arange(a, min(a + SHARD_ROWS, len(keys))) for a in range(0, len(keys), SHARD_ROWS)]
    if len(shards) > 1:
        shards = [refine(s, keys, words)[0] for s in shards]
    return refine(np.concatenate(shards), keys, words)


def repeated(keys: np.ndarray, before: list[bytes], after: list[bytes], least: np.ndarray, most: np.ndarray, *lengths: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length and row, the least and the greatest offset l (or -1) of a window that another row has.

    ``before`` holds the bytes ahead of the anchor, nearest last; row i rules the
    windows that start l bytes ahead of the anchor for least <= l <= most.
    """
    n, width = len(keys), -(-max(lengths) // 8) * 8
    room = np.array([len(a) for a in after])
    right = np.zeros((n, width), np.uint8)
    left = np.zeros((n, width), np.uint8)
    for i, (b, a) in enumerate(zip(before, after, strict=True)):
        right[i, : min(len(a), width)] = np.frombuffer(a[:width], np.uint8)
        left[i, : len(b)] = np.frombuffer(b, np.uint8)[::-1]
    big = lambda m: m.view(">u8").astype(np.uint64)
    r_order, r_lcp = merged(keys, big(right))
    l_order, l_lcp = merged(keys, big(left))
    out = [(np.full(n, -1), np.full(n, -1)) for _ in lengths]
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(int(least.min()), int(most.max()) + 1):
        l_class[l_order] = np.cumsum(l_lcp < l)
        for length, (low, high) in zip(lengths, out, strict=True):
            here = np.nonzero((least <= l) & (l <= most) & (l + room >= length))[0]
            if len(here) < 2:
                continue
            r_class[r_order] = np.cumsum(r_lcp < length - l)
            both = r_class[here] * (n + 1) + l_class[here]
            by = np.argsort(both, kind="stable")
            same = both[by][1:] == both[by][:-1]
            hit = here[by[np.append(same, False) | np.append(False, same)]]
            high[hit] = l
            low[hit[low[hit] < 0]] = l
    return out


def _row(key: int, tid: int, pos: int, first: int, last: int, ctx: bytes) -> tuple[int, ...]:
    """A record without its bytes: their digest tells them, the anchor's place in them and how many windows it rules."""
    digest = hashlib.blake2b(ctx + b"%d %d" % (pos - first, last - first), digest_size=16).digest()
    return (key, tid, pos, first, last, len(ctx), int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))


def _batch(rows: list[tuple], ctx: list[bytes] | None = None) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(NAMES))]
    return pa.RecordBatch.from_arrays(columns + ([pa.array(ctx, pa.binary())] if ctx is not None else []), [*NAMES, *(["ctx"] if ctx is not None else [])])


def _collapse(records: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(starts of records that occur twice, one record of each kind with the kinds of its key); ``records``, a kept table, goes."""
    kinds = records.groupBy("key", "h1", "h2").agg(F.count("*").alias("there"), F.min(F.struct("tid", "first")).alias("one"))
    kinds = common.keep(kinds, "record-kinds")
    sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.max("there").alias("most")).filter("kinds > 1 or most > 1")
    sizes = common.keep(sizes.drop("most"), "record-keys")
    sized = common.keep(kinds.join(sizes, "key").withColumnsRenamed({"key": "k", "h1": "g1", "h2": "g2"}), "record-sizes")
    common.release(kinds, sizes)
    met = records.join(sized, (F.col("key") == F.col("k")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    met = common.keep(met.withColumn("stays", F.struct("tid", "first") == F.col("one")).drop("k", "g1", "g2", "one"), "records")
    common.release(records, sized)
    twice = met.filter("there > 1")
    whole = F.least("last", F.col("first") + F.col("size") - length)  # the last start of a long window
    starts = twice.select("tid", F.col("first").alias("start"), F.col("last").alias("end"), F.lit(False).alias("long")).union(
        twice.select("tid", F.col("first").alias("start"), whole.alias("end"), F.lit(True).alias("long")).filter("start <= end"))
    return starts, met.filter("stays and kinds > 1").drop("stays", "there")


def _with_bytes(records: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``records`` (with ``kinds``) and their bytes, cut from the texts again."""
    names = (*NAMES, "kinds")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, own in zip(b["text"], b["own"].to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for at in range(0, len(own), 4096):
                    part = own[at : at + 4096]
                    columns = [pa.array([r[n] for r in part], pa.int64()) for n in names]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([data[r["first"] : r["last"] + length] for r in part], pa.binary())], [*names, "ctx"])

    own = records.groupBy("tid").agg(F.collect_list(F.struct(*names)).alias("own"))  # those of one text
    return texts.join(own, "tid").select("text", "own").mapInArrow(each, RECORD + ", kinds long, ctx binary")


def _merge_groups(records: DataFrame, length: int, short: int) -> DataFrame:
    """(tid, start, end, long): first and last start of repeated windows of each record."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(h.num_rows for h in held) >= BUNDLE_ROWS:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = np.searchsorted(t["key"].to_numpy(), t["key"][-1].as_py())  # the last key may go on
                if cut:
                    yield from found(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tid, pos, first, last = (t[c].to_numpy() for c in ("tid", "pos", "first", "last"))
        ctx = t["ctx"].to_pylist()
        cut = (pos - first).tolist()
        sides = [c[:n] for c, n in zip(ctx, cut, strict=True)], [c[n:] for c, n in zip(ctx, cut, strict=True)]
        both = repeated(t["key"].to_numpy(), *sides, pos - last, pos - first, length, short)
        for is_long, (low, high) in zip((True, False), both, strict=True):
            hit = np.nonzero(high >= 0)[0]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(tid[hit]), pa.array(pos[hit] - high[hit]), pa.array(pos[hit] - low[hit]), pa.array(np.full(len(hit), is_long))], ["tid", "start", "end", "long"])

    return records.select("key", "tid", "pos", "first", "last", "ctx").repartition("key").sortWithinPartitions("key").mapInArrow(each, STARTS)


def _halve(records: DataFrame, length: int, short: int) -> DataFrame:
    """Both halves of each record's window range, dealt by the bytes all windows of a half share.

    Halves are cut at offsets from the anchor, in the steps of a power of two, so equal
    windows fall into equal halves.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], []
            for r in b.to_pylist():
                near, far = r["pos"] - r["last"], r["pos"] - r["first"]  # offsets ruled
                step = 1 << max(0, r["step"] - 1)
                for at in range(near // step * step, far + 1, step):
                    a, z = max(near, at), min(far, at + step - 1)
                    first, last = r["pos"] - z, r["pos"] - a
                    ctx = r["ctx"][first - r["first"] : last - r["first"] + length]
                    core = r["ctx"][max(0, r["pos"] - at - r["first"]) : max(0, r["pos"] - at - step + 1 - r["first"] + short)]
                    key = hashlib.blake2b(core + b"%d %d %d" % (r["key"], at, step), digest_size=8).digest()
                    rows.append(_row(int.from_bytes(key, "little", signed=True), r["tid"], r["pos"], first, last, ctx))
                    held.append(ctx)
            yield _batch(rows, held)

    return records.mapInArrow(each, RECORD + ", ctx binary")


def _records(texts: DataFrame, length: int) -> DataFrame:
    """Records of the marked anchors of each text, without their bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for tid, text, marks in zip(b["tid"].to_pylist(), b["text"], b["marks"].to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for m in marks:
                    rows.append(_row(m["key"], tid, m["pos"], m["first"], m["last"], data[m["first"] : m["last"] + length]))
                    if len(rows) >= 1 << 16:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    return common.keep(texts.mapInArrow(each, RECORD), "records-0")


def repeated_starts(texts: DataFrame, length: int, short: int, group_rows: int) -> DataFrame:
    """(tid, start, end, long): runs of window starts, of which the ends at least are repeated
    and share an anchor, from (tid, text, marks)."""
    starts, records = _collapse(_records(texts, length), length)
    starts, records, step = [starts], common.keep(_with_bytes(records, texts, length), "record-bytes"), (short - 1).bit_length()
    while True:
        starts.append(_merge_groups(records.filter(F.col("kinds") <= group_rows), length, short))
        records = records.filter(F.col("kinds") > group_rows)
        if records.isEmpty():
            return reduce(DataFrame.union, starts)
        if step == 0:  # one window each: unlike long ones, equal short ones
            starts.append(records.select("tid", F.col("first").alias("start"), F.col("last").alias("end"), F.lit(False).alias("long")))
            return reduce(DataFrame.union, starts)
        known, records = _collapse(common.keep(_halve(records.withColumn("step", F.lit(step)), length, short), "halves"), length)
        starts.append(known)
        step -= 1


def n_passages(data: bytes, runs: list[tuple[int, int]], words: int) -> int:
    """How many of the [start, end) in ``runs`` hold so many whole words."""
    found = 0
    for s, e in runs:
        part = data[s:e]
        n = len(part.split())
        n -= s > 0 and not data[s - 1 : s].isspace() and not part[:1].isspace()
        n -= e < len(data) and not data[e : e + 1].isspace() and not part[-1:].isspace()
        found += n >= words
    return found


def _marked(docs: DataFrame, short: int, gram: int) -> DataFrame:
    """(sha, doc_id, n_bytes, n_words, marks): every anchor of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("key", "pos", "first", "last")]))
        for b in batches:
            sizes, lists, words = [], [], []
            for t in b["text"]:
                whole = t.as_py().encode("utf-8", "surrogatepass")
                data = np.frombuffer(whole, np.uint8)
                sizes.append(len(data))
                words.append(len(whole.split()))
                lists.append(list(map(tuple, zip(*(c.tolist() for c in anchors(data, short, gram)), strict=True))))
            yield pa.RecordBatch.from_arrays([b["sha"], b["doc_id"], pa.array(sizes, pa.int64()), pa.array(words, pa.int64()), pa.array(lists, kind)], ["sha", "doc_id", "n_bytes", "n_words", "marks"])

    return docs.select("sha", "doc_id", "text").mapInArrow(
        each, "sha string, doc_id long, n_bytes long, n_words long, marks array<struct<key:long,pos:long,first:long,last:long>>")


def _joined(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """[start, end) of the bytes under the windows of (start, end) runs of starts."""
    own: list[tuple[int, int]] = []
    for r in sorted(runs, key=lambda r: r["start"]):
        end = r["end"] + length
        if own and r["start"] <= own[-1][1]:
            own[-1] = (own[-1][0], max(own[-1][1], end))
        else:
            own.append((r["start"], end))
    return own


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS,
          short: int | None = None, words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, spans (start, end), kept_sha256, n_passages.

    ``n_passages`` counts the maximal runs of bytes under repeated strings of ``short``
    bytes (the length, if that is less) that hold ``words`` whole words or more.
    """
    short = min(SHORT, length) if short is None else short
    docs = common.text_rows(df, id_col, text_col).select("doc_id", "text", F.sha2("text", 256).alias("sha"))
    anchored = common.keep(_marked(docs, short, gram).withColumn("row", F.monotonically_increasing_id()), "anchors")
    copies = anchored.groupBy("sha").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "row")).alias("one"))
    copies = common.keep(copies.select("sha", "copies", "one.*").withColumnRenamed("doc_id", "one").withColumn("tid", F.monotonically_increasing_id()), "texts")
    single = anchored.join(copies.select("row", "tid"), "row")  # one row of each text, also where rows repeat
    single = common.keep(single.select("tid", F.explode("marks").alias("m")).select("tid", "m.*"), "text-anchors")
    marked = common.keep(anchored.select("sha", "doc_id", "n_bytes", "n_words"), "text-sizes")
    common.release(anchored)
    often = common.keep(single.groupBy("key").count().filter("count > 1").select("key"), "anchor-keys")  # plain, so that the join can be split
    marks = single.join(often, "key").groupBy("tid").agg(F.collect_list(F.struct("key", "pos", "first", "last")).alias("marks"))
    marks = marks.join(copies.select("tid", "sha", "one"), "tid").withColumnsRenamed({"sha": "s", "one": "o"})
    texts = docs.join(marks, (F.col("sha") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("o"))).select("tid", "text", "marks")
    texts = common.keep(texts, "marked-texts")  # rows that repeat stay: they do repeat each other
    common.release(single, often)
    starts = repeated_starts(texts, length, short, group_rows)
    starts = starts.groupBy("tid").agg(F.collect_list(F.struct("start", "end", "long")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans, shas, passages = [], [], []
            for text, runs in zip(b["text"], b["runs"].to_pylist(), strict=True):
                data, kept, at = text.as_py().encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
                spans.append(_joined([r for r in runs if r["long"]], length))
                for s, e in spans[-1]:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                shas.append(kept.hexdigest())
                passages.append(n_passages(data, _joined([r for r in runs if not r["long"]], short), words))
            yield pa.RecordBatch.from_arrays([b["tid"], pa.array(spans, kind), pa.array(shas), pa.array(passages, pa.int64())], ["tid", "spans", "kept", "passages"])

    cuts = texts.join(starts, "tid").select("tid", "text", "runs").mapInArrow(cut, "tid long, spans array<struct<start:long,end:long>>, kept string, passages long").dropDuplicates(["tid"])
    facts = common.keep(copies.select("sha", "copies", "tid").join(cuts, "tid", "left").drop("tid"), "text-cuts")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    again = (F.col("copies") > 1) & (F.col("n_bytes") >= short) & (F.col("n_words") >= words)
    return marked.join(facts, "sha").select(
        "doc_id", "n_bytes", F.when(whole, all_of_it).otherwise(F.coalesce("spans", empty)).alias("spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(again, F.lit(1).cast("long")).otherwise(F.coalesce("passages", F.lit(0).cast("long"))).alias("n_passages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 400 bytes take away from every document, and how many long passages repeat in it."""
    found = dedup(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_passages")
