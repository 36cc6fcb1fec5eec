"""Small text expressions: epochs, truncation, prompts, answers, display forms, grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROMPT_CHARS = 4000
FENCE = "<<<DOCUMENT>>>"


def epoch(value: Column) -> Column:
    """Seconds or milliseconds since 1970, told apart by size."""
    return F.when(F.abs(value) > 100_000_000_000, F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest start of ``most`` bytes or fewer that ends between characters."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, most + 1)
    # a character is whole if the byte after it starts another: drop bytes 10xxxxxx and the one before them at the cut
    tail = F.regexp_extract(F.hex(cut), "(?:[89AB][0-9A-F])*$", 0)
    whole = F.octet_length(cut) - F.length(tail) / 2 - 1
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(cut, F.lit(1), whole.cast("int")), "UTF-8"))


def fingerprint(content_hash: Column, chunk_count: Column, updated_at: Column) -> Column:
    """The content hash, else chunk count and update time."""
    count = F.coalesce(F.concat(F.lit("Some("), chunk_count.cast("string"), F.lit(")")), F.lit("None"))
    return F.coalesce(content_hash, F.concat(F.lit("cc"), count, F.lit("-"), F.coalesce(updated_at.cast("long"), F.lit(0)).cast("string")))


def sanitize(text: Column) -> Column:
    """A text that cannot close its fence or pose as a chat marker: 4,000 characters at most."""
    cut = F.translate(F.substring(text, 1, PROMPT_CHARS), "\x00", "")
    lines = F.transform(F.split(cut, "\n"), lambda x: F.when(F.trim(x).rlike(r"^<{3,}.*>{3,}$"), "[redacted marker]").otherwise(x))
    return F.replace(F.array_join(lines, "\n"), F.lit("<|"), F.lit("< |"))


def fenced(instruction: str, text: Column) -> Column:
    return F.concat(F.lit(f"{instruction}\n{FENCE}\n"), sanitize(text), F.lit(f"\n{FENCE}"))


def prompt_hash(instruction: Column) -> Column:
    return F.substring(F.sha2(instruction, 256), 1, 32)


def extract_answer(reply: Column) -> Column:
    """``answer`` of a JSON reply, else the reply without space and quotes around it."""
    return F.coalesce(F.get_json_object(reply, "$.answer"), F.regexp_replace(F.trim(reply), "^[\"'`]+|[\"'`]+$", ""))


def expected_grade(options: Column) -> Column:
    """struct(grade, confidence) of (token, p) options that read as 0-3; null without any."""
    graded = F.filter(F.transform(options, lambda o: F.struct(F.regexp_replace(F.trim(o["token"]), "[\"' ]", "").alias("t"), o["p"].alias("p"))), lambda o: o["t"].rlike("^[0-3]$"))
    mass = F.aggregate(graded, F.lit(0.0), lambda s, o: s + o["p"])
    grade = F.aggregate(graded, F.lit(0.0), lambda s, o: s + o["t"].cast("double") * o["p"]) / mass
    return F.when(mass > 0, F.struct(grade.alias("grade"), (F.array_max(F.transform(graded, lambda o: o["p"])) / mass).alias("confidence")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def human_bytes(n: Column) -> Column:
    shown = F.format_string("%d B", n)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        shown = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / 1024**power)).otherwise(shown)
    return shown


def fuzzy_score(text: Column, query: str) -> Column:
    """Ordered-subsequence score: 1 a character, 2 more at a word's start, 1 more in a run; null without a match."""
    low, score, at = F.lower(text), F.lit(0), F.lit(0)
    found = F.lit(True)
    for c in query.lower():
        here = F.locate(c, low, 1) if score is None else F.call_function("locate", F.lit(c), low, at + 1)
        found = found & (here > 0)
        start = (here == 1) | F.substring(low, here - 1, F.lit(1)).rlike("[^a-z0-9]")
        score = score + 1 + F.when(start, 2).otherwise(0) + F.when((at > 0) & (here == at + 1), 1).otherwise(0)
        at = here
    return F.when(found, score * 100 - F.length(text))


def narration(answer: Column) -> Column:
    """(title, summary) of a JSON object, or of one inside a JSON string; null unless both are texts with something in them."""
    inner = F.when(answer.rlike(r'^\s*"'), F.from_json(F.concat(F.lit('{"v":'), answer, F.lit("}")), "v string")["v"]).otherwise(answer)
    part = lambda name: F.trim(F.get_json_object(inner, f"$.{name}"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get(F.try_parse_json(inner), f"$.{name}", "variant"))
    fits = (F.length(part("title")) > 0) & (F.length(part("summary")) > 0) & (kind("title") == "STRING") & (kind("summary") == "STRING")
    return F.when(fits, F.struct(part("title").alias("title"), part("summary").alias("summary")))


def clamp_words(text: Column, most: int) -> Column:
    """White space folded, cut to ``most`` characters: at a space, if one is in the last quarter, with an ellipsis."""
    folded = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.substring(folded, 1, most - 1)
    head = F.regexp_extract(cut, r"^(.*) ", 1)
    kept = F.when(F.length(head) * 4 >= most * 3, head).otherwise(F.rtrim(cut))
    return F.when(F.length(folded) <= most, folded).otherwise(F.concat(kept, F.lit("…")))


def source_links(value: Column) -> Column:
    """JSON kept in a string: its value as JSON, else the string itself as JSON; null stays null."""
    plain = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.isNotNull(), F.coalesce(F.try_parse_json(value).cast("string"), plain))
