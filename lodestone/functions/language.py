"""Language by function words: a small, deterministic stand-in for a trigram model.

Scores the share of words that are function words of each language; the contract is
the usual one: no verdict on short or unsure texts, and a note when the parts of a
document disagree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textquality import bare_text, let

# Common function words, and two-letter to three-letter codes.
FUNCTION_WORDS = {
    "eng": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "by", "be", "this", "are"),
    "fra": ("le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "en", "dans", "qui", "pour", "sur", "est", "au"),
    "deu": ("der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "ein", "eine", "nicht", "im", "auf", "sich", "dem"),
    "spa": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "del", "se", "no", "es"),
}
CODES = {"en": "eng", "fr": "fra", "de": "deu", "es": "spa", "it": "ita", "pt": "por", "nl": "nld"}
FLOOR_BYTES, SURE = 200, 0.85


def detect(text: Column) -> Column:
    """struct(code, confidence), or null for under 200 bytes, no function words or confidence below 0.85.

    Confidence is the best language's share of the squared counts, so a clear lead counts.
    """
    def verdict(words: Column) -> Column:
        # One filter leaves the function words, of which each language then counts its own.
        every = sorted({w for own in FUNCTION_WORDS.values() for w in own})
        among = lambda own: lambda w: w.isin(*own)
        sizes = lambda few: F.array(*[F.size(F.filter(few, among(own))) for own in FUNCTION_WORDS.values()])
        return let(F.filter(words, among(every)), lambda few: let(sizes(few), scored))

    def scored(counts: Column) -> Column:
        best = F.array_max(counts)
        code = F.element_at(F.array(*[F.lit(c) for c in FUNCTION_WORDS]), F.array_position(counts, best).cast("int"))
        sure = best * best / F.aggregate(counts, F.lit(0), lambda s, n: s + n * n)
        return F.when((best > 0) & (sure >= SURE), F.struct(code.alias("code"), sure.alias("confidence")))

    return F.when(F.octet_length(F.trim(text)) >= FLOOR_BYTES, let(F.split(bare_text(F.trim(text)), " "), verdict))


def detect_document(chunks: Column) -> Column:
    """struct(code, confidence, mixed_with) of the first two chunks; mixed_with: another chunk's verdict."""
    first = F.slice(chunks, 1, 2)
    each = lambda: F.array(*[detect(F.try_element_at(first, F.lit(i)))["code"] for i in (1, 2)])

    def told(found: Column) -> Column:
        other = F.filter(each(), lambda c: c != found["code"])
        return F.when(found.isNotNull(), F.struct(found["code"].alias("code"), found["confidence"].alias("confidence"), F.try_element_at(other, F.lit(1)).alias("mixed_with")))

    return let(detect(F.array_join(first, "\n")), told)


def allowed(code: Column, languages: tuple[str, ...]) -> Column:
    """Whether a three-letter code is among languages given in either form, in any case."""
    known = {CODES.get(x.lower(), x.lower()) for x in languages}
    return F.lower(code).isin(*known)
