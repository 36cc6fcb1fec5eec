"""Secret scan: three base patterns and a randomness test battery (DataFrame functions only).

Base kinds are found by pattern, leftmost and non-overlapping per kind, and kept
when long enough.  The battery looks at every other long token that mixes letters
and digits: it infers the encoding from the alphabet, and tests the string for
uniform use of that alphabet (chi-squared, both too uneven and too even), for runs about
the alphabet's middle and for serial correlation at distance one and two.  The least of the three p-values, times three, says
how far the string is from random.  Strings that are not random are rejected with
false-discovery control (Benjamini-Hochberg) inside classes of length, since short
strings give the tests less power; what is not rejected is reported as ``random``.

Positions come from the lengths of the pieces between matches: only pieces and
matches of a document that has any are counted, and a running sum over them gives
the offsets in code points, end exclusive.

Edge cases: null text counts as empty and has no spans; rows that repeat a doc_id
are scanned separately; a very long text is scanned whole, and a match may have any length;
extra columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (kind, pattern, group whose length counts, least length); in this order for equal starts.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
)
RANDOM = ("random", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24)
KINDS = tuple(k for k, *_ in BASE) + ("random",)
#: Encodings from the narrowest alphabet to the widest.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"),
    ("mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
)
#: Upper ends (exclusive) of the classes of length.
LENGTH_CLASSES = (32, 48, 64, 128)
FALSE_DISCOVERY = 0.05


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches of one kind: gap before, length, whether long enough, value if tested."""
    lengths = lambda a: F.transform(a, lambda s: F.length(s))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    value = whole if kind == "random" else F.transform(whole, lambda s: F.lit(None).cast("string"))
    hits = F.arrays_zip(lengths(F.split(text, pattern, -1)).alias("gap"), lengths(whole).alias("len"),
                        lengths(counted).alias("counted"), value.alias("value"))
    hits = F.filter(hits, lambda h: h["len"].isNotNull())
    return F.when(F.regexp_like(text, F.lit(pattern)), F.transform(hits, lambda h: F.struct(
        F.lit(kind).alias("kind"), h["gap"].alias("gap"), h["len"].alias("len"),
        (h["counted"] >= least).alias("long_enough"), h["value"].alias("value"))))


def _upper_tail(z: Column) -> Column:
    """P(N > z), by a logistic approximation that is within 0.0002."""
    return F.when(z.isNotNull(), 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z))))


def battery(df: DataFrame, value: str = "value") -> DataFrame:
    """Add encoding, p_chi, p_runs, p_serial (at distance one and two) and p (combined) for the strings in ``value``.

    A string outside every alphabet, null or of fewer than two characters gets nulls.
    """
    text = F.col(value)
    encoding = reduce(lambda rest, a: F.when(text.rlike(f"^[{a[1]}]+$"), F.lit(a[1]))
                      .otherwise(rest), reversed(ALPHABETS), F.lit(None).cast("string"))
    df = df.withColumn("_alphabet", F.when(F.length(text) > 1, encoding))
    df = df.withColumn("_chars", F.split(text, "")).withColumn("_n", F.when(F.col("_alphabet").isNotNull(), F.length(text)).cast("double"))
    df = df.withColumn("_k", F.length("_alphabet").cast("double"))
    df = df.withColumn("_at", F.transform("_chars", lambda c: F.expr("1.0D") * F.call_function("instr", F.col("_alphabet"), c)))
    n, k = F.col("_n"), F.col("_k")
    squares = F.aggregate(F.array_distinct("_chars"), F.lit(0.0), lambda acc, c: acc + F.pow(
        F.size(F.filter("_chars", lambda x: x == c)).cast("double"), F.lit(2.0)))
    chi = k / n * squares - n
    z_chi = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high = F.transform("_at", lambda v: v > F.col("_k") / 2)
    pairs = F.arrays_zip(F.slice(high, F.lit(1), F.size(high) - 1).alias("a"), F.slice(high, F.lit(2), F.size(high) - 1).alias("b"))
    runs = 1 + F.size(F.filter(pairs, lambda p: p["a"] != p["b"])).cast("double")
    z_runs = (runs - (n + 1) / 2) / F.sqrt((n - 1) / 4)
    centred = F.transform("_at", lambda v: v - (F.col("_k") + 1) / 2)

    def serial(far: int) -> Column:
        """Correlation with the character ``far`` on, as a normal score."""
        count = F.greatest(F.size(centred) - far, F.lit(0))
        products = F.zip_with(F.slice(centred, F.lit(1), count), F.slice(centred, F.lit(1 + far), count), lambda a, b: a * b)
        return F.when(count > 0, F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v) / F.sqrt(count.cast("double")) / ((k * k - 1) / 12)).otherwise(F.lit(0.0))

    names = reduce(lambda rest, a: F.when(F.col("_alphabet") == a[1], F.lit(a[0])).otherwise(rest), ALPHABETS, F.lit(None).cast("string"))
    df = df.withColumn("encoding", names).withColumn("p_chi", 2 * _upper_tail(F.abs(z_chi)))
    df = df.withColumn("p_runs", 2 * _upper_tail(F.abs(z_runs)))
    df = df.withColumn("p_serial", F.when(n.isNotNull(), F.least(F.lit(1.0), 4 * _upper_tail(F.greatest(F.abs(serial(1)), F.abs(serial(2)))))))
    df = df.withColumn("p", F.when(n.isNotNull(), F.least(F.lit(1.0), 3 * F.least("p_chi", "p_runs", "p_serial"))))
    return df.drop("_alphabet", "_chars", "_n", "_k", "_at")


def not_random_limits(tested: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """(length_class, bin_limit): bins of p from bin_limit up are rejected as not random.

    p-values are counted in tenths of a decade, 0 to 300, so the step-up rule needs
    a few hundred counts a class, however many strings there are.
    """
    counts = tested.groupBy("length_class", "p_bin").agg(F.count("*").alias("n"))
    upward = Window.partitionBy("length_class").orderBy(F.col("p_bin").desc())
    counts = counts.withColumn("rejected", F.sum("n").over(upward)).withColumn(
        "tested", F.sum("n").over(Window.partitionBy("length_class")))
    edge = F.pow(F.lit(10.0), -F.col("p_bin") / 10)
    return counts.filter(edge <= rate * F.col("rejected") / F.col("tested")).groupBy("length_class").agg(
        F.min("p_bin").alias("bin_limit"))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): every row (row, doc_id), and row, kind, start, end of every span."""
    docs = common.text_rows(df, id_col, text_col)
    hits = F.array(*[_found(F.col("text"), *k) for k in (*BASE, RANDOM)])
    docs = common.keep(docs.select("row", "doc_id", F.flatten(F.filter(hits, lambda h: h.isNotNull())).alias("hits")), "secret-hits")
    each = docs.filter(F.size("hits") > 0).select("row", F.posexplode("hits").alias("pos", "hit")).select("row", "pos", "hit.*")
    ahead = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(ahead)).withColumn("start", F.col("end") - F.col("len"))
    each = common.keep(each.filter("long_enough").select("row", "kind", "start", "end", "value"), "secret-spans")

    base = each.filter(F.col("kind") != "random")
    tokens = each.filter((F.col("kind") == "random") & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    size_class = reduce(lambda rest, top: F.when(F.length("value") < top, F.lit(top)).otherwise(rest), reversed(LENGTH_CLASSES), F.lit(0))
    tested = battery(tokens).filter("p is not null").withColumn("length_class", size_class)
    tested = tested.withColumn("p_bin", F.least(F.lit(300), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-300))) * 10)).cast("int"))
    tested = common.keep(tested.select("row", "kind", "start", "end", "length_class", "p_bin", "encoding", "p"), "secret-tests")
    limits = F.broadcast(not_random_limits(tested))  # a row per class of length
    random = tested.join(limits, "length_class", "left").filter("bin_limit is null or p_bin < bin_limit")
    return docs.select("row", "doc_id"), base.select("row", "kind", "start", "end").union(random.select("row", "kind", "start", "end"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, counts of base kinds, and its spans in order."""
    rows, found = spans(df, id_col, text_col)
    order = reduce(lambda rest, i: F.when(F.col("kind") == KINDS[i], F.lit(i)).otherwise(rest), range(len(KINDS)), F.lit(0))
    found = found.select("row", F.struct("start", order.alias("kind_order"), "end", "kind").alias("span"))
    found = found.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return rows.join(found, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = scan(common.table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    shown = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(shown(base), 256).alias("base_sha256"),
                        shown(F.col("spans")).alias("spans"), of("random").alias("n_random"))
