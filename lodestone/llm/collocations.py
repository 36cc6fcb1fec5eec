"""Phrase collocations from mergeable Misra-Gries summaries and an exact second pass.

First pass.  Documents are dealt into chunks of ``CHUNK_BYTES``.  A chunk summarises its
n-grams: each is hashed to one of the hash partitions and a 32-bit key there, and every
partition gets one compact summary (sorted keys and counts) from every chunk.  A
partition's task merges its summaries: counts of equal keys are added, and beyond the
capacity the (capacity + 1)-th largest count is taken off all of them.  The capacity
exceeds the partition's mass divided by the least count, so what is taken off stays below
the least count, and an n-gram that is frequent enough always survives.  The number of
partitions grows with the text, so a task holds a bounded summary at any size.

Second pass.  A partition tells each chunk which of the chunk's own keys survived, and
nothing else; nothing is broadcast.  The chunk counts those n-grams again, now by their
words, and the counts are added by language and text.  So results are exact: a shared
hash only makes an n-gram counted that is then found too rare.

Scores are exact decimal arithmetic.  A candidate inside a longer one that holds
``WITHIN`` percent of its occurrences is dropped.  The first ``top`` of a language are
ranked in two steps, so no task ranks all candidates of a language.

Edge cases: null text counts as empty; a null language counts as ``und``; a very long text is
counted in slices that overlap by the longest phrase less one word; equal rows count as
often as they occur; words keep what is no separator, accents and quotes too; extra columns
are ignored, whatever their names; ties in the ranking go to the smaller phrase by bytes.
An empty table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LOW, HIGH, LEAST, TOP = 2, 3, 10, 2000
#: A candidate goes if a longer one around it has this share of its occurrences, in percent.
WITHIN = 50
CHUNK_BYTES = 6 << 20
#: Words that are counted at a time, at most.
SLICE = 1 << 20
#: Capacity of a summary is this many times its mass divided by the least count, and one more.
SLACK = 4
#: N-grams of one hash partition, about, and partitions at least.
PARTITION_MASS, LEAST_PARTITIONS = 4 << 20, 256
#: Buckets that a language is ranked in before the whole.
RANK_BUCKETS = 64

BREAK = b"\xff"
_TABLE = bytes(0xFF if c in b".,;:!?\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(texts: list[bytes]) -> list[bytes]:
    """Lower-cased words of all texts, with ``BREAK`` wherever a piece or a text ends."""
    return b"\n".join(texts).translate(_TABLE).replace(BREAK, b" " + BREAK + b" ").split()


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words as numbers, 0 for ``BREAK``, and the word of each number."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    known[BREAK]
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), list(known)


def places(ids: np.ndarray, vocabulary: list[bytes], lang: str, longest: int, starts: int, partitions: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, positions, partition << 32 | key) of the n-grams that start before ``starts``."""
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))
    own, real = hashes[ids], ids != 0
    mixed, valid = own, real
    for k in range(1, longest + 1):
        if k > 1:
            n = max(len(ids) - k + 1, 0)
            mixed = mixed[:n] * np.uint64(0x9E3779B97F4A7C15) + own[k - 1 :]
            mixed ^= mixed >> np.uint64(29)
            valid = valid[:n] & real[k - 1 :]
        at = np.nonzero(valid[:starts])[0]
        h = mixed[at] * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        part = (h >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)
        yield k, at, part << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A summary: how many keys occur once, those keys, the others and their counts; keys as differences, by byte planes."""
    once = counts == 1
    sizes = np.array([once.sum(), (~once).sum()], "<u4").tobytes()
    planes = [np.diff(k.astype("<u4"), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for k in (keys[once], keys[~once])]
    return b"".join([sizes, *planes, counts[~once].astype("<u8").tobytes()])


def unpack(summary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a packed summary."""
    ones, more = np.frombuffer(summary, "<u4", 2).tolist()
    plane = lambda at, n: np.cumsum(np.ascontiguousarray(np.frombuffer(summary, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel(), dtype=np.uint32)
    counts = np.frombuffer(summary, "<u8", more, 8 + 4 * (ones + more)).astype(np.int64)
    return np.concatenate([plane(8, ones), plane(8 + 4 * ones, more)]), np.concatenate([np.ones(ones, np.int64), counts])


def merge(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys ascending, counts, taken off): one Misra-Gries summary of at most ``capacity`` keys."""
    keys, counts, off = np.empty(0, np.uint32), np.empty(0, np.int64), 0
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for i, s in enumerate(summaries):
        waiting.append(s)
        if i + 1 < len(summaries) and sum(len(k) for k, _ in waiting) <= capacity:
            continue
        k, c = np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)])
        waiting = []
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.nonzero(np.diff(k, prepend=k[:1] + np.uint32(1)))[0] if len(k) else np.empty(0, np.int64)
        keys, counts = k[first], np.add.reduceat(c, first) if len(first) else c
        if len(keys) > capacity:
            least = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            keys, counts, off = keys[counts > least], counts[counts > least] - least, off + least
    return keys, counts, off


def held(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in the ascending ``among``."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def slices(texts: dict[str, list[bytes]], longest: int, size: int = SLICE) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words, starts): slices of words, each with what n-grams that start in it need of the next."""
    size = min(size, (1 << 63 // longest) - longest - 1)  # so that word numbers of an n-gram fit 63 bits
    for lang, own in texts.items():
        words = tokens(own)
        for at in range(0, len(words), size):
            yield lang, words[at : at + size + longest - 1], size


def _chunked(docs: DataFrame) -> DataFrame:
    """(chunk, lang, text): documents in chunks of about ``CHUNK_BYTES``, one after another."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held_bytes = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            own = []
            for n in pc.binary_length(b["text"]).to_pylist():
                if held_bytes >= CHUNK_BYTES:
                    chunk, held_bytes = chunk + 1, 0
                own.append(chunk)
                held_bytes += n
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), b["lang"], b["text"]], ["chunk", "lang", "text"])

    return docs.mapInArrow(each, "chunk long, lang string, text string")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """(key, rows) of batches that are sorted by the key; rows are read as they come."""
    rows = (r for b in batches for r in _rows(b))
    ahead = next(rows, None)
    while ahead is not None:
        now, first = ahead[key], ahead
        ahead = None

        def own() -> Iterator[dict]:
            nonlocal ahead
            yield first
            for r in rows:
                if r[key] != now:
                    ahead = r
                    return
                yield r

        rest = own()
        yield now, rest
        for _ in rest:
            pass


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    columns = [(n, b[n].cast(pa.binary()) if n == "text" else b[n]) for n in b.schema.names]
    return ({n: c[i].as_py() for n, c in columns} for i in range(b.num_rows))


def _full(rows: Iterator[dict]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, at most about a chunk at a time."""
    texts, size = defaultdict(list), 0
    for r in rows:
        texts[r["lang"]].append(r["text"])
        size += len(r["text"])
        if size >= CHUNK_BYTES:
            yield texts
            texts, size = defaultdict(list), 0
    if texts:
        yield texts


def summaries(chunks: DataFrame, longest: int, partitions: int) -> DataFrame:
    """(part, chunk, summary): what each chunk holds for each hash partition."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _groups(batches, "chunk"):
            for texts in _full(rows):
                found = [at for lang, words, starts in slices(texts, longest) for _, _, at in places(*numbered(words), lang, longest, starts, partitions)]
                at = np.sort(np.concatenate(found)) if found else np.empty(0, np.uint64)
                if not len(at):
                    continue
                first = np.nonzero(np.diff(at, prepend=~at[:1]))[0]
                n = np.diff(np.append(first, len(at)))
                at = at[first]
                part, keys = at >> np.uint64(32), at.astype(np.uint32)
                new = np.nonzero(np.diff(part, prepend=~part[:1]))[0]
                ends = np.append(new[1:], len(at))
                packed = [pack(keys[s:e], n[s:e]) for s, e in zip(new.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[new].astype(np.int64)), pa.array(np.full(len(new), chunk)), pa.array(packed, pa.binary())], ["part", "chunk", "summary"])

    return chunks.mapInArrow(each, "part long, chunk long, summary binary")


def survivors(summed: DataFrame, least: int) -> DataFrame:
    """(chunk, part, keys): of each chunk's keys those that may occur ``least`` times in all."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches, "part"):
            own = [(r["chunk"], *unpack(r["summary"])) for r in rows]
            mass = sum(int(c.sum()) for _, _, c in own)
            keys, counts, off = merge([(k, c) for _, k, c in own], 1 + SLACK * mass // least)
            keys = keys[counts + off >= least]
            back = [(chunk, k[held(k, keys)].astype("<u4").tobytes()) for chunk, k, _ in own]
            back = [x for x in back if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in back], pa.int64()), pa.array([part] * len(back), pa.int64()), pa.array([x[1] for x in back], pa.binary())], ["chunk", "part", "keys"])

    return summed.repartition("part").sortWithinPartitions("part").mapInArrow(each, "chunk long, part long, keys binary")


def recount(chunks: DataFrame, asked: DataFrame, longest: int, partitions: int) -> DataFrame:
    """(lang, words, phrase, n): each chunk's counts of the n-grams that it was asked for; words = 0 counts all words."""
    schema = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
    bits = 63 // longest

    def counted(lang: str, words: list[bytes], starts: int, surviving: np.ndarray, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, vocabulary = numbered(words)
        sizes, phrases, ns = [0], [b""], [int((ids[:starts] != 0).sum())]
        for k, at, place in places(ids, vocabulary, lang, longest, starts, partitions):
            likely = seen[place & np.uint64(len(seen) - 1)]
            at, place = at[likely], place[likely]
            at = at[held(place, surviving)]
            code = ids[at]
            for j in range(1, k):
                code = code << bits | ids[at + j]
            code.sort()
            first = np.nonzero(np.diff(code, prepend=-1))[0]
            ns += np.diff(np.append(first, len(code))).tolist()
            code = code[first]
            own = [[vocabulary[i] for i in (code >> bits * (k - 1 - j) & (1 << bits) - 1).tolist()] for j in range(k)]
            phrases += own[0] if k == 1 else map(b" ".join, zip(*own, strict=True))
            sizes += [k] * len(code)
        columns = [pa.array([lang] * len(ns), pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "chunk"):
            asked_for, first = [], None
            for r in rows:  # what is asked for stands first
                if r["text"] is not None:
                    first = r
                    break
                asked_for.append(np.uint64(r["part"]) << np.uint64(32) | np.frombuffer(r["keys"], "<u4").astype(np.uint64))
            if first is None:
                continue
            surviving = np.sort(np.concatenate(asked_for)) if asked_for else np.empty(0, np.uint64)
            seen = np.zeros(1 << 23, bool)  # a first look by the low bits
            seen[surviving & np.uint64(len(seen) - 1)] = True

            def documents(one: dict = first, more: Iterator[dict] = rows) -> Iterator[dict]:
                yield one
                yield from more

            for texts in _full(documents()):
                for lang, words, starts in slices(texts, longest):
                    yield from counted(lang, words, starts, surviving, seen)

    none = lambda kind: F.lit(None).cast(kind)
    both = asked.select("chunk", "part", "keys", none("string").alias("lang"), none("string").alias("text"))
    both = both.union(chunks.select("chunk", none("long"), none("binary"), "lang", "text"))
    return both.repartition("chunk").sortWithinPartitions("chunk", F.col("part").isNull()).mapInArrow(each, "lang string, words int, phrase string, n long")


def frequent(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = HIGH, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): every n-gram of up to ``longest`` words that occurs ``least`` times, and per language all words as words = 0."""
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    chunks = common.keep(_chunked(docs), "collocation-chunks")
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(LEAST_PARTITIONS, size // 2 // PARTITION_MASS)
    asked = survivors(summaries(chunks, longest, partitions), least)
    counts = recount(chunks, asked, longest, partitions)
    return counts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).filter((F.col("words") == 0) | (F.col("f") >= least))


def phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", low: int = LOW, high: int = HIGH, least: int = LEAST, top: int = TOP, within: int = WITHIN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the strongest collocations of each language."""
    grams = common.keep(frequent(df, text_col, lang_col, high, least), "collocation-grams")
    candidates = grams.filter(F.col("words") >= low).withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))

    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w")).alias("rest"))
    side = lambda name, n: grams.filter("words > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    big = lambda c: f"cast({c} as decimal(14,0))"
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * {big('a')} * {big('a')}) div ({big('l')} * {big('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(low), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: part(i, n))))
    around = candidates.filter(F.col("words") > low).select("lang", F.col("a").alias("longer"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    alone = scored.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", *by).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    bucketed = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)).alias("bucket"))
    words = grams.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked(ranked(bucketed, "bucket").drop("rank")).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of ``documents`` by language."""
    return phrases(common.table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
word AS MATERIALIZED (SELECT p, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT *, row_number() OVER () AS p FROM piece)),
run AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY p ORDER BY i)),
gram AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS k, w1 AS phrase FROM run UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM run UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM run)
  WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
parts AS MATERIALIZED (
  SELECT lang, phrase, f, j, array_to_string(w[:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM gram WHERE k >= {LOW})),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, c.j AS k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM parts c JOIN gram l ON l.lang = c.lang AND l.phrase = c.first JOIN gram r ON r.lang = c.lang AND r.phrase = c.rest),
scored AS (SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM cut GROUP BY ALL),
around AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + n - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range({LOW}, k)) AS n FROM gram WHERE k > {LOW})) GROUP BY ALL),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, encode(s.phrase)) AS rank
  FROM scored s LEFT JOIN around o USING (lang, phrase) WHERE o.longer IS NULL OR 100 * o.longer < {WITHIN} * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
