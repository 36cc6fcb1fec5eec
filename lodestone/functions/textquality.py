"""Web-text quality heuristics: measures, gates, families, explanations.

Published heuristics (Gopher, C4, FineWeb): all but the n-gram measures are column
expressions over whole texts and lines; those are one Arrow pass over the words.  Gates compare 32-bit
floats, so values at a threshold fall the same way for every caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words and markers of the published heuristics.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
MARKERS = ("lorem ipsum", "javascript is disabled", "enable cookies")
BULLETS = r"^(•|-|\*|‣|◦|· |\x{200B}•)"
CLOSING = r"[.!?\"”’।]$"
SHORT_LINE = 30


@dataclass(frozen=True)
class Gates:
    """Thresholds; each names the measure it bounds."""

    min_words: int = 50
    max_words: int = 100_000
    min_word_length: float = 3.0
    max_word_length: float = 10.0
    max_symbol_ratio: float = 0.1
    max_bullet_lines: float = 0.9
    max_ellipsis_lines: float = 0.3
    min_alpha_words: float = 0.8
    stop_words: bool = True
    stop_word_floor: int = 50
    min_stop_words: int = 2
    max_dup_lines: float = 0.3
    max_dup_line_chars: float = 0.2
    ngram_floor: int = 100
    max_top2: float = 0.20
    max_top3: float = 0.18
    max_top4: float = 0.16
    max_dup5: float = 0.15
    max_dup10: float = 0.10
    punct_floor: int = 50
    min_punct_lines: float = 0.12
    max_short_lines: float = 0.67
    max_newline_ratio: float = 0.3
    min_failures: int = 3
    min_families: int = 2


FAMILY = {
    "word_count_low": "length", "word_count_high": "length", "mean_word_length": "composition", "symbol_ratio": "composition",
    "bullet_lines": "line_shape", "ellipsis_lines": "line_shape", "alpha_words": "composition", "stopwords": "composition",
    "dup_lines": "repetition", "repeated_ngrams": "repetition", "unterminated_lines": "line_shape", "short_lines": "line_shape",
    "newline_ratio": "line_shape", "boilerplate_marker": "marker",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, also where a lambda uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def bare(words: Column) -> Column:
    """Lower-cased words without marks at their ends; words of marks only become empty."""
    return F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", "")))


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def bare_text(text: Column) -> Column:
    """``bare`` words of a text, a space between two (two spaces where one is empty)."""
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(text, r"\s+", " ")))
    marks = lambda c: F.reverse(F.regexp_replace(c, r" [^\p{IsAlphabetic}\p{N} ]++", " "))
    whole = marks(F.concat(F.lit(" "), marks(flat)))  # backward for the marks at the ends of words
    return F.lower(F.substring(whole, F.lit(2), F.length(whole) - 2))


def ngram_measures(words: list[str]) -> dict[str, float]:
    """Character shares of the top 2-, 3-, 4-grams and of repeated 5- and 10-grams."""
    return dict(zip(NGRAM_SHARES, ngram_shares(words, [len(words)])[0].tolist(), strict=True))


def ngram_shares(words: list[str], counts: list[int]) -> np.ndarray:
    """``ngram_measures`` of texts whose words follow each other, ``counts`` to a text; a row each.

    A gram is numbered within its text, from the numbers of its two parts, so that grams are in the order of texts.
    """
    n, texts = len(words), len(counts)
    out = np.zeros((texts, len(NGRAM_SHARES)))
    if not n:
        return out
    known: dict[str, int] = {}
    word = np.fromiter(map(known.setdefault, words, count()), np.int64, n)  # where it first occurs
    chars, octets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for w, at in known.items():
        chars[at], octets[at] = len(w), len(w.encode("utf-8", "surrogatepass"))
    up_to = lambda sizes: np.concatenate([[0], np.cumsum(sizes[word])])
    chars_to, octets_to = up_to(chars), up_to(octets)
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(texts), counts)
    left = ends[text] - np.arange(n)
    total = np.maximum(chars_to[ends] - chars_to[ends - counts], 1)

    def joined(x: np.ndarray, size: int, y: np.ndarray, more: int) -> tuple[np.ndarray, ...]:
        """Starts of grams of ``size + more`` words, the number of each by start, first starts and counts by number."""
        at = np.flatnonzero(left >= size + more)
        _, first, own, often = np.unique(x[at] * n + y[at + size], return_index=True, return_inverse=True, return_counts=True)
        numbers = np.zeros(n, np.int64)
        numbers[at] = own
        return at, numbers, at[first], often

    def top(first: np.ndarray, often: np.ndarray, size: int) -> np.ndarray:
        """Characters under each text's most frequent gram; of equals the one of most bytes, then of most characters."""
        own = text[first]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        length = chars_to[first + size] - chars_to[first]
        best = np.ones(len(first), bool)
        for value in (often, octets_to[first + size] - octets_to[first], length):
            most = np.maximum.reduceat(np.where(best, value, -1), starts)
            best &= value == np.repeat(most, np.diff(starts, append=len(first)))
        hit = np.zeros(texts, np.int64)
        hit[own[best]] = (often * length)[best]
        return hit

    def repeated(at: np.ndarray, numbers: np.ndarray, often: np.ndarray, size: int) -> np.ndarray:
        """Characters of each text's words under grams that occur more than once."""
        again = at[often[numbers[at]] > 1]
        edge = np.zeros(n + 1, np.int64)
        edge[again] += 1
        edge[again + size] -= 1
        under = np.concatenate([[0], np.cumsum(np.where(np.cumsum(edge[:-1]) > 0, chars[word], 0))])
        return under[ends] - under[ends - counts]

    one = np.unique(text * n + word, return_inverse=True)[1]
    found, numbers = {}, {1: one}
    for size, more in ((1, 1), (2, 1), (2, 2), (4, 1), (5, 5)):
        found[size + more] = at, numbers[size + more], _, _ = joined(numbers[size], size, numbers[more], more)
    for i, size in enumerate((2, 3, 4)):
        if len(found[size][0]):
            out[:, i] = np.minimum(top(*found[size][2:], size) / total, 1.0)
    for i, size in enumerate((5, 10), 3):
        at, numbers_at, _, often = found[size]
        if len(at):
            out[:, i] = repeated(at, numbers_at, often, size) / total
    return out


NGRAM_SHARES = ("top2", "top3", "top4", "dup5", "dup10")
NGRAM_COLUMNS = [f"{k[:3]}_{k[3:]}gram_char_fraction" for k in NGRAM_SHARES]
#: Words that are held at a time, unless one text has more.
WORDS = 1 << 16


def add_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-gram measures in place of ``_bare``; for mapInArrow."""
    for b in batches:
        rows: list[np.ndarray] = [np.empty((0, len(NGRAM_SHARES)))]
        words: list[str] = []
        counts: list[int] = []
        for t in b["_bare"]:
            own = t.as_py()
            size = len(words)
            words += own.split(" ") if own else []
            counts.append(len(words) - size)
            if len(words) >= WORDS:
                rows.append(ngram_shares(words, counts))
                words, counts = [], []
        if counts:
            rows.append(ngram_shares(words, counts))
        shares = np.concatenate(rows)
        kept = [c for c in b.schema.names if c != "_bare"]
        yield pa.RecordBatch.from_arrays([b[c] for c in kept] + [pa.array(shares[:, i]) for i in range(shares.shape[1])], [*kept, *NGRAM_COLUMNS])


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The 19 measures of ``text_col`` in its place; shares are 0 where there is nothing to share.

    The Arrow pass at the end lets no filter through, so each text is measured once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    others = [c for c in df.columns if c != text_col]
    df = df.select(*others, text.alias("_text"), lines.alias("_lines"), bare_text(text).alias("_bare"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("_flat"))
    spaced = lambda c: F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1)
    df = df.withColumn("_n", spaced(F.col("_flat"))).withColumn("_letters", F.trim(F.regexp_replace(F.regexp_replace("_flat", r"[^\p{IsAlphabetic} ]++", ""), " {2,}", " ")))
    n, ln = F.col("_n"), F.greatest(F.size("_lines"), F.lit(1))
    share = lambda top, bottom: F.when((n > 0) & (bottom > 0), top / bottom).otherwise(F.lit(0.0)).cast("double")
    chars = lambda a: F.aggregate(a, F.lit(0), lambda acc, w: acc + F.length(w))
    lines_like = lambda test: share(F.size(F.filter("_lines", test)), ln)
    symbols = F.regexp_count(F.col("_text"), F.lit("[#…]")) + F.regexp_count(F.col("_text"), F.lit(r"\.\.\."))
    distinct = F.array_distinct("_lines")
    around = F.concat(F.lit(" "), F.col("_bare"), F.lit(" "))
    df = df.select(*others, "_bare", *[c.alias(k) for k, c in {
        "word_count": n,
        "mean_word_length": share(F.length("_flat") - n + 1, n),
        "symbol_word_ratio": share(symbols, n),
        "alpha_word_fraction": share(spaced(F.col("_letters")), n),
        "stopword_hits": reduce(Column.__add__, [F.contains(around, F.lit(f" {w} ")).cast("int") for w in STOP_WORDS]),
        "bullet_line_fraction": lines_like(lambda x: x.rlike(BULLETS)),
        "ellipsis_line_fraction": lines_like(lambda x: x.endswith("...") | x.endswith("…")),
        "punct_line_fraction": lines_like(lambda x: x.rlike(CLOSING)),
        "short_line_fraction": lines_like(lambda x: F.length(x) < SHORT_LINE),
        "dup_line_fraction": share(F.size("_lines") - F.size(distinct), F.size("_lines")),
        "dup_line_char_fraction": share(chars(F.col("_lines")) - chars(distinct), chars(F.col("_lines"))),
        "newline_word_ratio": share(F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))), n),
        "has_boilerplate_marker": F.lower(F.col("_text")).rlike("|".join(MARKERS)),
    }.items()])
    fields = [*df.drop("_bare").schema.fields, *(T.StructField(c, T.DoubleType()) for c in NGRAM_COLUMNS)]
    return df.mapInArrow(add_ngrams, T.StructType(fields))


def failures(g: Gates = Gates()) -> Column:
    """Names of the gates that a measured row fails, in fixed order."""
    f = lambda c: F.col(c).cast("float")
    lit = lambda v: F.lit(v).cast("float")
    n = F.col("word_count")
    over = lambda c, v: f(c) > lit(v)
    rules = {
        "word_count_low": n < g.min_words,
        "word_count_high": n > g.max_words,
        "mean_word_length": (f("mean_word_length") < lit(g.min_word_length)) | over("mean_word_length", g.max_word_length),
        "symbol_ratio": over("symbol_word_ratio", g.max_symbol_ratio),
        "bullet_lines": over("bullet_line_fraction", g.max_bullet_lines),
        "ellipsis_lines": over("ellipsis_line_fraction", g.max_ellipsis_lines),
        "alpha_words": f("alpha_word_fraction") < lit(g.min_alpha_words),
        "stopwords": F.lit(g.stop_words) & (n >= g.stop_word_floor) & (F.col("stopword_hits") < g.min_stop_words),
        "dup_lines": over("dup_line_fraction", g.max_dup_lines) | over("dup_line_char_fraction", g.max_dup_line_chars),
        "repeated_ngrams": (n >= g.ngram_floor) & (over("top_2gram_char_fraction", g.max_top2) | over("top_3gram_char_fraction", g.max_top3) | over(
            "top_4gram_char_fraction", g.max_top4) | over("dup_5gram_char_fraction", g.max_dup5) | over("dup_10gram_char_fraction", g.max_dup10)),
        "unterminated_lines": (n >= g.punct_floor) & (f("punct_line_fraction") < lit(g.min_punct_lines)),
        "short_lines": over("short_line_fraction", g.max_short_lines),
        "newline_ratio": over("newline_word_ratio", g.max_newline_ratio),
        "boilerplate_marker": F.col("has_boilerplate_marker"),
    }
    return F.when(n > 0, F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))).otherwise(F.array().cast("array<string>"))


def families(gates: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair])
    return F.array_sort(F.array_distinct(F.transform(gates, lambda x: pairs[x])))


def evaluate(df: DataFrame, g: Gates = Gates()) -> DataFrame:
    """Add gates, families, is_candidate and confidence to measured rows."""
    df = df.withColumn("gates", failures(g)).withColumn("families", families(F.col("gates")))
    count = F.size("gates")
    sure = F.least(F.lit(0.55) + F.lit(0.1) * F.greatest(count - g.min_failures, F.lit(0)), F.lit(0.85)).cast("float")
    return df.withColumn("is_candidate", (count >= g.min_failures) & (F.size("families") >= g.min_families)).withColumn("confidence", sure)


def explain(g: Gates = Gates()) -> Column:
    """One sentence a failed gate, with what was measured and the bound."""
    shown = {
        "word_count_low": ("%s words, fewer than " + str(g.min_words), "word_count"),
        "word_count_high": ("%s words, more than " + str(g.max_words), "word_count"),
        "mean_word_length": (f"mean word length %s, outside {g.min_word_length}-{g.max_word_length}", "mean_word_length"),
        "symbol_ratio": (f"%s symbols a word, more than {g.max_symbol_ratio}", "symbol_word_ratio"),
        "bullet_lines": (f"%s of lines are bullets, more than {g.max_bullet_lines}", "bullet_line_fraction"),
        "ellipsis_lines": (f"%s of lines end in an ellipsis, more than {g.max_ellipsis_lines}", "ellipsis_line_fraction"),
        "alpha_words": (f"%s of words have a letter, fewer than {g.min_alpha_words}", "alpha_word_fraction"),
        "stopwords": (f"%s of the stop words occur, fewer than {g.min_stop_words}", "stopword_hits"),
        "dup_lines": (f"%s of lines repeat, more than {g.max_dup_lines}", "dup_line_fraction"),
        "repeated_ngrams": (f"%s of characters in repeated 5-grams, bound {g.max_dup5}", "dup_5gram_char_fraction"),
        "unterminated_lines": (f"%s of lines end in a mark, fewer than {g.min_punct_lines}", "punct_line_fraction"),
        "short_lines": (f"%s of lines are short, more than {g.max_short_lines}", "short_line_fraction"),
        "newline_ratio": (f"%s line ends a word, more than {g.max_newline_ratio}", "newline_word_ratio"),
        "boilerplate_marker": ("a boilerplate marker occurs: %s", "has_boilerplate_marker"),
    }
    said = [F.when(F.array_contains("gates", k), F.format_string(form, (F.round(c, 2) if c.endswith(("fraction", "ratio", "length")) else F.col(c)).cast("string"))) for k, (form, c) in shown.items()]
    return F.array_compact(F.array(*said))


GATE_FIELDS = tuple(f.name for f in fields(Gates))
