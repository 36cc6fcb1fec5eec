import random
import re
from collections import Counter

import numpy as np

from lodestone.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, rank long, words int, phrase string, chunk long"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, low=2, high=3, least=10, top=2000, within=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, high + 1) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if low <= len(p) and a >= least:
            score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang, p] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = []
    for lang in n:
        own = {p: v for (x, p), v in found.items() if x == lang}
        kept = {p: v for p, v in own.items() if not any(len(q) > len(p) and inside(p, q) and 100 * u[0] >= within * v[0] for q, u in own.items())}
        order = sorted(kept, key=lambda p: (-kept[p][4], -kept[p][0], " ".join(p).encode()))[:top]
        out += [(lang, i + 1, " ".join(p), *kept[p]) for i, p in enumerate(order)]
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(rng, n):
    words = ["Alpha", "béta", "gamma", "d'elta", "EPS", "ünd\x1cx", "zed\x85"]
    join = lambda: rng.choices([" ", "\t", "  ", ", ", "\n", ". ", "\r\n"], [20, 2, 2, 2, 1, 1, 1])[0]
    return ["".join(rng.choice(words) + join() for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(co, "CHUNK_BYTES", 900)
    rng = random.Random(3)
    rows = [(t, rng.choice(["en", "en", "en", "", "de", None])) for t in texts(rng, 150)]
    rows += [(None, "en"), ("", None), ("...", "fr"), ("one two " * 9, "only nine"), ("one two " * 10, "ten"), (" \t", "de")]
    df = spark.createDataFrame([(i, *r, 1, 1, "x", 5) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert len(want) > 40 and plain(co.op11_collocations(spark, str(tmp_path))) == want
    for top, within, least in ((3, 90, 4), (50, 20, 2)):
        assert plain(co.phrases(df, top=top, within=within, least=least)) == brute(rows, least=least, top=top, within=within)


def test_a_very_long_text_and_copies(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("a b c d e f g h".split()) for _ in range(400_000))
    rows = [(long, "en")] + [("hot words here", "en")] * 500
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert plain(co.phrases(df)) == brute(rows)


def test_slices_count_each_start_once():
    rng = random.Random(1)
    own = {"x": [t.encode() for t in texts(rng, 30)]}
    whole = Counter()
    for size in (7, 50, 10**6):
        got = Counter()
        for lang, words, starts in co.slices(own, 3, size):
            for k, _, at in co.places(*co.numbered(words), lang, 3, starts, 300):
                got.update((k, x) for x in at.tolist())
        whole = whole or got
        assert got == whole and sum(whole.values()) > 500


def test_summaries_keep_all_frequent_keys():
    rng = np.random.default_rng(7)
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(1, 9)):
            keys = np.unique(rng.zipf(1.3, 300).clip(max=2**32 - 1).astype(np.uint32))
            parts.append((keys, rng.integers(1, 4, len(keys))))
        again = [co.unpack(co.pack(*p)) for p in parts]
        assert all(dict(zip(*map(np.ndarray.tolist, a))) == dict(zip(*map(np.ndarray.tolist, b))) for a, b in zip(parts, again))
        true = Counter()
        for k, c in parts:
            true.update(dict(zip(k.tolist(), c.tolist())))
        least = 5
        capacity = 1 + sum(true.values()) // least
        keys, counts, off = co.merge(again, capacity)
        assert len(keys) <= capacity and off < least and (np.diff(keys.astype(np.int64)) > 0).all()
        got = dict(zip(keys.tolist(), counts.tolist()))
        assert all(got.get(k, 0) <= n <= got.get(k, 0) + off for k, n in true.items())
        assert {k for k, n in true.items() if n >= least} <= {k for k, n in got.items() if n + off >= least}


def test_scores_beyond_64_bits(spark, monkeypatch):
    grams = spark.createDataFrame([("en", 0, "", 10**13), ("en", 1, "a", 9 * 10**12), ("en", 1, "b", 7 * 10**12), ("en", 2, "a b", 6 * 10**12 + 1)], "lang string, words int, phrase string, f long")
    monkeypatch.setattr(co, "frequent", lambda *a: grams)
    (r,) = plain(co.phrases(grams, "phrase"))
    a, left, right = 6 * 10**12 + 1, 9 * 10**12, 7 * 10**12
    assert r == ("en", 1, "a b", a, left, right, 10**13, 1000000 * a * a // (left * right))


def test_empty_table(spark):
    assert co.phrases(spark.createDataFrame([], SCHEMA)).collect() == []
    assert co.phrases(spark.createDataFrame([(1, None, None, 1, 1, "x", 1)], SCHEMA)).collect() == []
