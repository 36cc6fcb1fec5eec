"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document.  Expectation-
maximisation over the counts of vote patterns (3 ** labellers at most, whatever the
corpus) estimates how each labeller votes on good and on bad documents, and so the
probability of good for every pattern.  These posterior labels of a bounded sample
train a logistic scorer over hashed features, which then scores every document.

The sample is the ``SAMPLE`` documents with the least hash of id and text; its
features and the training live in one task of bounded size, and only the weights
reach the driver.

Toxicity has a scorer of its own, fitted on labelled documents: pieces of words (whole
words and their first six and four letters) that are far more frequent in toxic
documents than in others are markers, and a document's score is the log-likelihood
ratio of its words, those without a marker sharing one small negative weight.  So
insults are learned in whatever language the labels cover, and a long text is not
toxic for one chance hit.  A bounded sample a class is counted; the markers that
reach the driver are bounded by it.

Edge cases: null text counts as empty, and an empty text gets a bad vote; rows
that repeat are scored alike; other columns pass through, except that a column
named like an output is replaced; a very long text is measured whole, in one row's memory;
an empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from math import exp, log2
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Documents whose posterior labels train the scorer, at most.
SAMPLE = 6000
#: Buckets of hashed features.
BUCKETS = 2048
ROUNDS = 200
STEPS = 300
THRESHOLD = 0.5
ENDS = tuple(".!?:;\"')…”")
SYMBOLS = re.compile(r"[#$%&*@^~<>{}\\=+_]")
LETTERS = re.compile(r"[^\W\d_]+")
RUNS = re.compile(r"(.)\1+")

#: Words that insult, and phrases that threaten, in the corpus's four languages.
INSULTS = (
    "idiots? morons? stupid imbeciles? losers? scum scumbags? trash worthless pathetic disgusting clowns? dumbass(?:es)? asshole?s? bastards? bitch(?:es)? "
    "fuck\\w* shit shitty retard(?:s|ed)? vermin filth degenerates? "
    "idiote[ns]? dummkopf abschaum arschloch missgeburt wertlos erbärmlich connards? connasses? salauds? ordures? débiles? crétins? enculés? "
    "idiotas? imbécil(?:es)? estúpid[oa]s? basura escoria asqueros[oa]s? patétic[oa]s? cabr[oó]n(?:es)? gilipollas").split()
THREATS = (r"kill yourself", r"(?:i|we)(?: will|'ll| am going to| are going to) (?:kill|hurt|find|beat) (?:you|them|him|her)", r"(?:you|they) (?:deserve to|should|must) die",
           r"ich bringe dich um", r"je vais te tuer", r"te voy a matar")
#: Insults in a text that make it toxic; a threat does alone.
ABUSE = 2
#: Labelled documents of a class, toxic or not, that the toxicity scorer counts, at most.
TOXIC_SAMPLE = 3000
#: A marker's least toxic documents, log-likelihood ratio and score of the two shares' difference.
MARKER = (4, 3.0, 5.0)
#: Least log-likelihood ratio of a toxic document.
TOXIC_LEAST = 8.0
#: Stands for every word without a marker.
PLAIN = ""

LABELLERS = ("content", "shouting", "separators", "stutter", "variety", "lines", "word_length", "sentences", "dominance", "symbols")


def measures(text: str) -> dict[str, float]:
    """What the labellers and the scorer look at."""
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    letters = sum(map(len, LETTERS.findall(text)))
    return {
        "n": len(words), "upper": sum(map(str.isupper, words)) / n, "marks": text.count("!") / n,
        "bars": (text.count("|") + text.count("\t")) / n, "same": sum(map(str.__eq__, words, words[1:])) / n,
        "distinct": len(counts) / n, "top": max(counts.values(), default=0) / n,
        "repeated_lines": 1 - len(set(lines)) / max(1, len(lines)), "length": sum(map(len, words)) / n,
        "ended": sum(x.endswith(ENDS) for x in lines) / max(1, len(lines)), "letters": letters / max(1, len(text)),
        "stops": text.count(".") / n, "symbols": len(SYMBOLS.findall(text)) / n, "_counts": counts,
    }


def votes(m: dict[str, float]) -> str:
    """One letter a labeller: g good, b bad, - nothing."""
    say = lambda bad, good: "b" if bad else "g" if good else "-"
    long = m["n"] >= 30
    return "".join((
        say(m["n"] == 0 or m["letters"] < (0.6 if long else 0.25), m["letters"] > 0.7),
        say(m["marks"] > 0.3 or (m["upper"] > 0.5 and m["n"] > 5), m["marks"] < 0.05 and m["upper"] < 0.2),
        say(m["bars"] > 0.15, m["bars"] < 0.01),
        say(m["same"] > 0.15, long and m["same"] < 0.05),
        say(long and m["distinct"] < 0.2, long and m["distinct"] > 0.45),
        say(m["n"] and m["repeated_lines"] > 0.4, long and m["repeated_lines"] < 0.1),
        say(m["n"] > 5 and not 2.5 <= m["length"] <= 11, long and 3.5 <= m["length"] <= 7),
        say(long and m["ended"] < 0.1, m["ended"] > 0.5 and m["stops"] > 0.01),
        say(long and m["top"] > 0.25, long and m["top"] < 0.15),
        say(m["n"] > 5 and m["symbols"] > 0.5, m["symbols"] < 0.1),
    ))


def em(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """P(good) of every vote pattern, and each labeller's P(b or g | bad, good, voted) as 2 x 2 rows.

    Starts from the share of good among votes cast, so the first class stays bad.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, {}
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([["bg-".index(c) for c in k] for k in keys])
    cast = np.array([[k.count("b"), k.count("g")] for k in keys], float)
    good = np.where(cast[:, 0] > 0, 0.5 * cast[:, 1] / np.maximum(cast.sum(axis=1), 1), 0.95)
    for _ in range(rounds):
        q = np.stack([1 - good, good]) * n
        prior = np.clip(q.sum(axis=1) / n.sum(), 1e-3, 1)
        rates = np.stack([[np.bincount(v[:, j], q[c], 3)[:2] + 1.0 for j in range(v.shape[1])] for c in range(2)])
        rates /= rates.sum(axis=2, keepdims=True)
        said = np.concatenate([np.log(rates), np.zeros((2, v.shape[1], 1))], axis=2)  # no vote says nothing
        logs = np.log(prior)[:, None] + sum(said[:, j][:, v[:, j]] for j in range(v.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return dict(zip(keys, good.tolist(), strict=True)), {name: rates[:, j] for j, name in enumerate(LABELLERS)}


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


class Known(dict):
    """Values by word, worked out when first asked for; it starts anew when it has grown large."""

    def __init__(self, of: Callable, most: int = 200_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        value = self[word] = self.of(word)
        return value

    def dot(self, counts: Counter, damped: dict) -> float:
        """Sum of value times damped count over the words of a text."""
        if len(self) > self.most:
            self.clear()
        return sum(map(mul, map(self.__getitem__, counts), map(damped.__getitem__, counts.values())))


def _log_count(n: int) -> float:
    return log2(1 + n)


def _kind(code: int) -> str:
    c = chr(code)
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


#: What each character counts as in a word's shape, and the bucket of a word of such characters, runs taken as one.
KINDS = Known(_kind)
SHAPES = Known(lambda kinds: _bucket("s " + RUNS.sub(r"\1", kinds)))


def _word_buckets(word: str) -> tuple[int, int]:
    """The buckets of a word and of its shape."""
    if len(SHAPES) > SHAPES.most:
        SHAPES.clear()
    return _bucket("w " + word.lower()), SHAPES[word.translate(KINDS)]


class Features:
    """Hashed features of a text: words, their shapes, and measures in steps."""

    def __init__(self):
        self.known = Known(_word_buckets)

    def sparse(self, m: dict[str, float]) -> Iterator[tuple[int, float]]:
        """(bucket, value) pairs; values of equal buckets add up."""
        n = max(1, m["n"])
        if len(self.known) > self.known.most:
            self.known.clear()
        for w, c in m["_counts"].items():
            at = self.known[w]
            yield at[0], 0.3 * c / n
            yield at[1], c / n
        yield from self.steps(m)

    @staticmethod
    def steps(m: dict[str, float]) -> Iterator[tuple[int, float]]:
        """The pairs of the measures."""
        for name, value in m.items():
            if name not in ("_counts", "n", "length"):
                yield _bucket(f"m {name} {min(10, int(10 * value))}"), 0.5
        yield _bucket(f"m n {min(12, m['n'].bit_length())}"), 0.3
        yield _bucket(f"m length {min(15, int(m['length']))}"), 0.3

    def of(self, m: dict[str, float]) -> np.ndarray:
        x = np.zeros(BUCKETS, np.float32)
        for at, value in self.sparse(m):
            x[at] += value
        return x


class Scorer:
    """A text's score by trained weights; what a word adds is looked up once."""

    def __init__(self, weights: list[float]):
        *self.weights, self.bias = weights
        self.known = Known(self._word)
        self.plain = Known(float)

    def _word(self, word: str) -> float:
        own, shape = _word_buckets(word)
        return 0.3 * self.weights[own] + self.weights[shape]

    def of(self, m: dict[str, float]) -> float:
        words = self.known.dot(m["_counts"], self.plain) / max(1, m["n"])
        z = self.bias + words + sum(self.weights[at] * x for at, x in Features.steps(m))
        return 1 / (1 + exp(-max(-500.0, min(500.0, z))))


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Weights of a logistic scorer (the last is the bias), classes weighed alike, by Adam."""
    w = np.zeros(x.shape[1] + 1)
    if not len(x):
        return w
    share = np.clip(y.mean(), 0.01, 0.99)
    weigh = y / share + (1 - y) / (1 - share)
    a, b = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w[:-1].astype(np.float32) + w[-1])))
        g = (weigh * (p - y) / len(y)).astype(np.float32)
        grad = np.append(x.T @ g, g.sum()) + 1e-5 * w
        a, b = 0.9 * a + 0.1 * grad, 0.999 * b + 0.001 * grad**2
        w -= 0.05 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return w


def _voted(df: DataFrame, text_col: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [votes(measures(t.as_py())) for t in b["_text"]]
            yield pa.RecordBatch.from_arrays([b["_order"], pa.array(found, pa.string())], ["_order", "votes"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.xxhash64(text).alias("_order"), text.alias("_text")).mapInArrow(each, "_order long, votes string")


def fit(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray]:
    """Posteriors by vote pattern, and the scorer's weights."""
    voted = common.keep(_voted(df, text_col), "votes")
    patterns = {r["votes"]: r["count"] for r in voted.groupBy("votes").count().collect()}  # 3 ** labellers rows at most
    posterior, _ = em(patterns)
    edge = voted.select("_order").distinct().orderBy("_order").limit(sample).agg(F.max("_order")).first()[0]
    if edge is None:
        return posterior, np.zeros(BUCKETS + 1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, x, y = Features(), [], []
        for b in batches:
            for t in b["_text"]:
                m = measures(t.as_py())
                x.append(features.of(m))
                y.append(posterior.get(votes(m), 0.5))
        w = train(np.stack(x) if x else np.zeros((0, BUCKETS), np.float32), np.array(y))
        yield pa.RecordBatch.from_pydict({"weights": [w.tolist()]})

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = df.select(text.alias("_text")).filter(F.xxhash64("_text") <= edge).groupBy(F.xxhash64("_text").alias("_order")).agg(F.min("_text").alias("_text"))
    return posterior, np.array(chosen.orderBy("_order").coalesce(1).mapInArrow(learn, "weights array<double>").first()[0])


def _pieces(word: str) -> Iterator[str]:
    """A lower-case word, and its beginnings where it is longer."""
    yield word
    for k in (6, 4):
        if len(word) > k:
            yield word[:k] + "-"


def _pieces_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece, and for ``PLAIN`` in all: documents and words (damped counts) of either class."""
    found: dict[str, list[float]] = {}

    def out() -> pa.RecordBatch:
        columns = list(zip(*found.values(), strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *[pa.array(c, pa.float64()) for c in columns]], ["piece", "d0", "d1", "m0", "m1"])

    for b in batches:
        for text, y in zip(b["_text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            own: Counter[str] = Counter()
            for token, n in Counter(text.split()).items():
                for word in LETTERS.findall(token.lower()):
                    own[PLAIN] += log2(1 + n)
                    for piece in _pieces(word):
                        own[piece] += log2(1 + n)
            own[PLAIN] += 0  # a document without words counts as one
            for piece, mass in own.items():
                row = found.setdefault(piece, [0.0] * 4)
                row[y] += 1
                row[2 + y] += mass
            if len(found) > 300_000:
                yield out()
                found.clear()
    yield out()


def fit_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = TOXIC_SAMPLE) -> dict[str, float]:
    """Markers of toxicity with their log-likelihood ratios, and that of other words under ``PLAIN``.

    ``labels`` has doc_id and toxic (0, 1 or null; of several the greatest counts).  Without labels
    of both classes there are no markers.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter("toxic in (0, 1)")
    hashed = df.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_order")).join(said, "_id")
    hashed = common.keep(hashed.groupBy("_order").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    least = [hashed.filter(F.col("toxic") == y).orderBy("_order").limit(sample) for y in (0, 1)]
    chosen = common.keep(df.select(F.xxhash64(text).alias("_order"), text.alias("_text")).join(F.broadcast(least[0].union(least[1])), "_order")  # 2 * sample rows
                         .groupBy("_order", "toxic").agg(F.min("_text").alias("_text")).select("_text", "toxic"), "toxic-sample")
    counted = common.keep(chosen.mapInArrow(_pieces_counted, "piece string, d0 double, d1 double, m0 double, m1 double").groupBy("piece").agg(
        *[F.sum(c).alias(c) for c in ("d0", "d1", "m0", "m1")]), "toxic-pieces")
    total = counted.filter(F.col("piece") == PLAIN).first()
    if total is None or not all(total[c] for c in ("d0", "d1", "m0", "m1")):
        return {}
    n0, n1, all0, all1 = (total[c] for c in ("d0", "d1", "m0", "m1"))
    seen, ratio, score = MARKER
    share = (F.col("d0") + F.col("d1")) / (n0 + n1)
    weight = F.log((F.col("m1") + 0.5 * all1 / (all0 + all1)) / all1) - F.log((F.col("m0") + 0.5 * all0 / (all0 + all1)) / all0)
    apart = (F.col("d1") / n1 - F.col("d0") / n0) / F.sqrt(share * (1 - share + 1e-9) * (1 / n0 + 1 / n1))
    found = counted.filter((F.col("piece") != PLAIN) & (F.col("d1") >= seen)).select("piece", weight.alias("weight"), apart.alias("apart"))
    markers = {r["piece"]: r["weight"] for r in found.filter((F.col("weight") >= ratio) & (F.col("apart") >= score)).collect()}  # bounded by the sample

    words = counted.filter((F.col("piece") != PLAIN) & ~F.col("piece").endswith("-"))
    parts = F.array("piece", *[F.when(F.length("piece") > k, F.concat(F.substring("piece", 1, k), F.lit("-"))) for k in (6, 4)])
    names = counted.sparkSession.createDataFrame([(sorted(markers),)], "markers array<string>")
    hit = words.join(F.broadcast(names)).filter(F.arrays_overlap(F.array_compact(parts), "markers")).agg(  # one row
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("m0", "m1")]).first()
    markers[PLAIN] = float(np.log((all1 - hit["m1"] + 1) / (all1 + 1)) - np.log((all0 - hit["m0"] + 1) / (all0 + 1)))
    return markers


class Toxicity:
    """The log-likelihood ratio of a text's words, by markers."""

    def __init__(self, markers: dict[str, float]):
        self.markers, self.plain = {k: v for k, v in markers.items() if k != PLAIN}, markers.get(PLAIN, 0.0)
        self.heads = {p.removesuffix("-")[:3] for p in self.markers}
        self.known, self.damped = Known(self._token), Known(_log_count)

    def _token(self, token: str) -> float:
        low = token.lower()
        return sum(map(self._of_word, (low,) if low.isalpha() else LETTERS.findall(low)))

    def _of_word(self, word: str) -> float:
        """The greatest weight of its markers; a word has none if no marker begins like it."""
        if word[:3] not in self.heads:
            return self.plain
        get, n = self.markers.get, len(word)
        found = get(word), get(word[:6] + "-") if n > 6 else None, get(word[:4] + "-") if n > 4 else None
        return self.plain if found == (None, None, None) else max(x for x in found if x is not None)

    def of(self, counts: Counter) -> float:
        return self.known.dot(counts, self.damped) if self.markers else 0.0


def classify(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, markers: dict[str, float] | None = None) -> DataFrame:
    """``df`` with p_weak (posterior of its votes), p_quality (score) and keep; with ``markers`` (of ``fit_toxic``) also toxicity."""
    posterior, weights = fit(df, text_col, sample)
    added = [("p_weak", T.DoubleType()), ("p_quality", T.DoubleType()), ("keep", T.BooleanType())]
    if markers is not None:
        added.append(("toxicity", T.DoubleType()))
    passed = [f for f in df.schema.fields if f.name.lower() not in {n for n, _ in added}]
    held = "text"
    while held in {f.name.lower() for f in passed}:
        held += "_"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, toxicity = Scorer(weights.tolist()), Toxicity(markers or {})
        for b in batches:
            weak, p, abuse = [], [], []
            for t in b[held]:
                m = measures(t.as_py())
                weak.append(posterior.get(votes(m), 0.5))
                p.append(scorer.of(m))
                abuse.append(toxicity.of(m["_counts"]))
            columns = [b[f.name] for f in passed] + [pa.array(weak), pa.array(p), pa.array([x >= threshold for x in p], pa.bool_())]
            if markers is not None:
                columns.append(pa.array(abuse, pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in passed] + [n for n, _ in added])

    schema = T.StructType(passed + [T.StructField(n, t) for n, t in added])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(*[F.col(f"`{f.name}`") for f in passed], text.alias(held)).mapInArrow(score, schema)


def toxic(text: Column) -> Column:
    """Whether a text insults ``ABUSE`` times or threatens; null text does not."""
    text = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    whole = lambda words: r"(?<![\p{L}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{N}])"
    return (F.regexp_count(text, F.lit(whole(INSULTS))) >= ABUSE) | F.regexp_like(text, F.lit(whole(THREATS)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak posterior, score and decision for every document."""
    return classify(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "p_weak", "p_quality", "keep")
