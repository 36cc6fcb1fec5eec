"""Shingles and MinHash: FNV-1a hashes, a fixed permutation family, LSH bands.

Unsigned 64-bit arithmetic has no Spark type, so signing is one pass over Arrow
batches with numpy; longs carry the bit patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .textquality import let, words_of

PERMUTATIONS, BANDS, SHINGLE = 128, 16, 5
# FNV-1a, and the generator of the permutation coefficients.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LCG_SEED, LCG_MULTIPLIER, LCG_INCREMENT = 0x4D696E4861736831, 6364136223846793005, 1442695040888963407
MASK = (1 << 64) - 1
#: Texts whose shingles are held at a time, and strings whose hashes advance together.
TEXTS, BLOCK = 64, 1 << 14


def shingle_text(text: Column, k: int = SHINGLE) -> Column:
    """Lower-cased k-word shingles; fewer words make one shingle, none (or a null text) make none."""
    trimmed = F.transform(words_of(F.coalesce(text, F.lit(""))), lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))

    def shingles(words: Column) -> Column:
        whole = F.array(F.lower(F.array_join(words, " ")))
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.lower(F.array_join(F.slice(words, i, F.lit(k)), " ")))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) <= k, whole).otherwise(many)

    return let(F.filter(trimmed, lambda w: w != ""), shingles)


def plain_words(text: Column) -> Column:
    """The words that shingles are made of, lower-cased, in one string, a space between two.

    What lies between two letters or digits parts words if it holds white space; marks next to it go.
    One pass forward and one backward do that for whole texts, in time that grows with their length.
    """
    marks = lambda c: F.reverse(F.regexp_replace(c, r"(?:\A|[ \t\n\x0B\f\r])[^\p{IsAlphabetic}\p{N}]*+", " "))
    return F.lower(F.trim(marks(marks(F.coalesce(text, F.lit(""))))))


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & MASK
    return h


def coefficients(n: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of n permutations x -> a x + b; every a is odd."""
    state, out = LCG_SEED, []
    for _ in range(n):
        state = (state * LCG_MULTIPLIER + LCG_INCREMENT) & MASK
        a = state | 1 if state % 2 else state + 1
        state = (state * LCG_MULTIPLIER + LCG_INCREMENT) & MASK
        out.append((a & MASK, state))
    a, b = zip(*out, strict=True)
    return np.array(a, np.uint64), np.array(b, np.uint64)


def fnv1a_many(items: list[str]) -> np.ndarray:
    """FNV-1a of every string."""
    raw = [x.encode() for x in items]
    sizes = np.array([len(r) for r in raw], np.int64)
    return fnv1a_spans(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)


def fnv1a_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """FNV-1a of stretches of ``data``, blocks of them advanced a byte together."""
    out = np.full(len(start), FNV_OFFSET, np.uint64)
    order = np.argsort(-size, kind="stable")
    prime = np.uint64(FNV_PRIME)
    for at in range(0, len(order), BLOCK):
        own = order[at : at + BLOCK]
        where, left = start[own], -size[own]
        h = out[own]
        live = np.searchsorted(left, -np.arange(-int(left[0])), side="left").tolist() if len(own) else []
        for j, n in enumerate(live):
            part = h[:n]
            part ^= data[where[:n] + j]
            part *= prime
        out[own] = h
    return out


def shingle_hashes(texts: pa.StringArray, k: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the k-word shingles of each text, none of which is empty, of words between single spaces."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    first, last = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    gaps = np.flatnonzero(data == ord(" "))
    start, end = np.sort(np.append(first, gaps + 1)), np.sort(np.append(gaps, last))
    words = np.searchsorted(gaps, last) - np.searchsorted(gaps, first) + 1
    own = np.maximum(words - k + 1, 1)  # shingles of each text
    text = np.repeat(np.arange(len(texts)), own)
    at = np.arange(len(text)) + (np.cumsum(words) - words - np.cumsum(own) + own)[text]  # their first words
    where, to = start[at], end[at + np.minimum(k, words)[text] - 1]
    return np.split(fnv1a_spans(data, where, to - where), np.cumsum(own)[:-1])


def signatures(hashes: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row for each of the texts, whose hashes are given: the least of every permutation."""
    every = np.concatenate(hashes)
    first = np.cumsum([0, *(len(h) for h in hashes[:-1])])
    out, room = np.empty((len(hashes), len(a)), np.uint64), np.empty_like(every)
    for i in range(len(a)):
        np.multiply(every, a[i], out=room)
        room += b[i]
        out[:, i] = np.minimum.reduceat(room, first)
    return out


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return signatures([hashes], a, b)[0] if len(hashes) else np.full(len(a), MASK, np.uint64)


def fnv1a_words(m: np.ndarray) -> np.ndarray:
    """FNV-1a of each row of 64-bit values, taken as little-endian bytes."""
    raw = np.ascontiguousarray(m.astype("<u8")).view(np.uint8).reshape(len(m), -1)
    h = np.full(len(m), FNV_OFFSET, np.uint64)
    for j in range(raw.shape[1]):
        h = (h ^ raw[:, j]) * np.uint64(FNV_PRIME)
    return h


def sign(batches: Iterator[pa.RecordBatch], k: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """Columns ``sig`` and ``bands`` in place of ``words``; for mapInArrow."""
    a, b = coefficients()
    longs = pa.list_(pa.int64())
    for batch in batches:
        if not batch.num_rows:
            continue
        sigs = np.concatenate([signatures(shingle_hashes(batch["words"].slice(at, TEXTS), k), a, b) for at in range(0, batch.num_rows, TEXTS)])
        bands = fnv1a_words(sigs.reshape(-1, len(a) // BANDS)).view(np.int64)
        kept = [c for c in batch.schema.names if c != "words"]
        lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, n), pa.int32()), pa.array(values)).cast(longs)
        columns = [batch[c] for c in kept] + [lists(sigs.reshape(-1).view(np.int64), len(a)), lists(bands, BANDS)]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "sig", "bands"])


def estimated_jaccard(x: Column, y: Column) -> Column:
    """Share of equal places; places of empty texts (all bits set) never match."""
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != -1)), lambda e: e))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), same / F.size(x)).otherwise(F.lit(0.0))


def verified_jaccard(x: str, y: str, k: int = SHINGLE) -> float:
    """Exact Jaccard similarity of the k-word shingles of two texts of words between single spaces."""
    def shingles(text: str) -> set[tuple[str, ...]]:
        words = text.split(" ")
        return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) > k else {tuple(words)}

    if not x or not y:
        return 0.0
    own, other = shingles(x), shingles(y)
    both = len(own & other)
    return both / (len(own) + len(other) - both)


def compare(batches: Iterator[pa.RecordBatch], k: int = SHINGLE) -> Iterator[pa.RecordBatch]:
    """(sha_a, sha_b, share) of rows that also hold ``words_a`` and ``words_b``; for mapInArrow."""
    for b in batches:
        share = [verified_jaccard(x.as_py(), y.as_py(), k) for x, y in zip(b["words_a"], b["words_b"], strict=True)]
        yield pa.RecordBatch.from_arrays([b["sha_a"], b["sha_b"], pa.array(share, pa.float64())], ["sha_a", "sha_b", "share"])


def generation_key(permutations: int = PERMUTATIONS, shingle: int = SHINGLE, n_bands: int = BANDS) -> str:
    return f"np{permutations}-k{shingle}-b{n_bands}"
