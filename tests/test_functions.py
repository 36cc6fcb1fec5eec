import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import language, minhash, text, url
from lodestone.functions import textquality as tq
from lodestone.operators import cursor as cu
from lodestone.operators import langid
from lodestone.operators import vectors as vec
from lodestone.operators.policy import PRESETS, Policy
from lodestone.sources import config

PROSE = ("The committee met on Tuesday to review the proposal that had been put forward. It was agreed that the work should go on with the same team. "
         "Members of the board asked to have the figures in writing, and the chair said that they would be sent to all by Friday. ") * 3


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("r")).first()["r"]


def keys(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return [r["k"] for r in df.select("i", url.canonical_key(F.col("u")).alias("k")).orderBy("i").collect()]


def test_spellings_of_a_page_share_a_key(spark):
    same = ["https://example.com/a", "http://www.example.com/a/", "https://EXAMPLE.com:443/a#top", "http://m.example.com/a?utm_source=x&fbclid=1", "http://u:p@example.com/./b/../a", "https://example.com/a/index.html"]
    assert set(keys(spark, same)) == {"http://example.com/a"}
    assert len(set(keys(spark, ["http://a.com/x?b=2&a=1", "http://a.com/x?a=1&b=2"]))) == 1
    assert keys(spark, ["http://a.com/fr/x", "http://a.com/en/x"])[0] != keys(spark, ["http://a.com/en/x"])[0]
    assert keys(spark, ["not a url", "", None, "://x", "http://"]) == [None] * 5
    assert keys(spark, ["ftp://Host.org/file", "http://[2001:db8::1]/x"]) == ["ftp://host.org", "http://[2001:db8::1]/x"]


def test_url_classes_and_shape(spark):
    want = {"http://a.com/cat.png": "image", "http://a.com/p.JPEG": "image", "http://a.com/c.mp4": "media", "http://a.com/d.tar.gz": "archive", "http://a.com/r.pdf": "binary_document", "http://a.com/x": "page", "nope": "page"}
    for u, k in want.items():
        assert one(spark, url.url_class, u) == k
    assert one(spark, url.path_depth, "https://a.com/x/y/z") == 3 and one(spark, url.path_depth, "https://a.com/") == 0
    assert one(spark, url.has_query, "https://a.com/x?a=1") and not one(spark, url.has_query, "https://a.com/x")
    live = one(spark, url.archive_edition_of, "https://x.org/archives/spr2011/entries/ethics/")
    assert live == "http://x.org/entries/ethics"
    assert one(spark, url.archive_edition_of, "https://a.com/archive/") is None and one(spark, url.archive_edition_of, "https://a.com/archives/tag/rust") is None


def measured(spark, value):
    return tq.evaluate(tq.measure(spark.createDataFrame([(value,)], "text string"))).first()


def test_quality_measures_and_gates(spark):
    assert measured(spark, PROSE)["gates"] == [] or "short_lines" not in measured(spark, PROSE)["gates"]
    nav = measured(spark, "Home\nAbout\nContact\nLogin\nCart")
    assert {"short_lines", "word_count_low"} <= set(nav["gates"])
    assert "dup_lines" in measured(spark, "a line that repeats itself again\n" * 20)["gates"]
    assert "repeated_ngrams" in measured(spark, "buy now cheap " * 40)["gates"]
    assert measured(spark, "")["gates"] == [] and measured(spark, None)["word_count"] == 0
    assert "alpha_words" in measured(spark, "123 456 789 " * 10)["gates"]
    assert measured(spark, "Lorem Ipsum dolor")["has_boilerplate_marker"]
    half = tq.ngram_measures([chr(0x100 + i) for i in range(50)] + ["a", "b", "c", "d", "e"] * 10)
    assert 0.3 < half["dup5"] < 0.75


def test_minhash_golden_values(spark):
    assert minhash.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert minhash.fnv1a(b"the quick brown fox jumps") == 5772498422487578343
    a, b = minhash.coefficients()
    assert (int(a[0]), int(b[0])) == (11127205314907480301, 8388272814721621707)
    assert (int(a[127]), int(b[127])) == (12367347545408310443, 14479438044738261297)
    shingles = one(spark, minhash.shingle_text, "The quick brown fox jumps over the lazy dog in the garden")
    assert len(shingles) == 8
    sig = minhash.signature(minhash.fnv1a_many(shingles), a, b)
    assert [int(x) for x in sig[:3]] == [3041288694559397895, 1773653230286253318, 1140828446091005751] and int(sig[127]) == 1640936944374758793
    bands = minhash.fnv1a_words(sig.reshape(16, 8))
    assert [int(bands[0]), int(bands[1]), int(bands[15])] == [8725378841726166294, 16957511548005491004, 3321664127858387129]
    assert one(spark, minhash.shingle_text, "Hello world") == ["hello world"] and one(spark, minhash.shingle_text, " ... ") == []


ODD = ["", " ... ", "--", "one", "a b c d e", "a b c d e f", "«Été»  l'Ünder-Strich\t(…) 3½ x²\n\n-- ÀÇ! 𝐀?! b 𝐀", "😀 a😀 😀b a😀b", "\u00a0a\u00a0b\u2028 c", "ΑΣ ΣΑ", "e\u0301 \u0301e", "!" * 50_000 + " a", "a" + "-" * 50_000 + "b c", "\x0b a\x0cb \x1f c"]


def test_signed_words_are_those_of_the_shingles(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "v string")
    rows = df.select(minhash.shingle_text(F.col("v")).alias("s"), minhash.plain_words(F.col("v")).alias("w")).collect()
    assert all((r["w"] == "") == (r["s"] == []) for r in rows)
    some = [r for r in rows if r["w"]]
    hashes = minhash.shingle_hashes(pa.array(["no", *(r["w"] for r in some)]).slice(1))
    assert [h.tolist() for h in hashes] == [[minhash.fnv1a(x.encode()) for x in r["s"]] if len(r["s"][0]) < 999 else h.tolist() for r, h in zip(some, hashes)]
    a, b = minhash.coefficients()
    assert (minhash.signatures(hashes, a, b)[3] == minhash.signature(hashes[3], a, b)).all()
    for x, y in (("a b c d e f", "a b c d e f"), ("a b c d e f", "a b c d e g"), ("a", "a"), ("a b", "b a"), ("", "")):
        own, other = ({tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))} if t else set() for t in (x, y))
        assert minhash.verified_jaccard(x, y) == (len(own & other) / len(own | other) if own | other else 0.0)


def test_bare_text_holds_the_bare_words(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "v string")
    for r in df.select(tq.bare(tq.words_of(F.col("v"))).alias("words"), tq.bare_text(F.col("v")).alias("text")).collect():
        assert r["text"] == " ".join(r["words"])


def test_ngrams_of_many_texts_are_those_of_each(spark):
    docs = [[], ["a"], ["", "a", ""], ["a", "b"] * 30, ["ö"] * 12, [*"abcdefghij"] * 2, [*"abcdefghijk"]]
    together = tq.ngram_shares([w for d in docs for w in d], [len(d) for d in docs])
    assert together.tolist() == [list(tq.ngram_measures(d).values()) for d in docs]
    assert together[3].tolist() == [1.0, min(1.0, 29 * 3 / 60), min(1.0, 29 * 4 / 60), 1.0, 1.0] and together[5].tolist() == [0.2, 0.3, 0.4, 1.0, 1.0]


def test_a_filter_on_measures_does_not_measure_again(spark):
    found = tq.evaluate(tq.measure(spark.createDataFrame([("x",)], "text string"))).filter("is_candidate")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_language(spark):
    german = "Der Hund und die Katze sind nicht mit dem Auto von der Stadt in die Berge gefahren, und das ist auch nicht zu ändern. " * 3
    assert one(spark, language.detect, german)["code"] == "deu"
    assert one(spark, language.detect, PROSE)["code"] == "eng"
    assert one(spark, language.detect, "too short") is None


def test_trigram_ranks_are_by_count_then_by_trigram():
    profiles = {"x": {"aaa": 1, "aab": 2, "baa": 3}, "y": {"baa": 1}}
    for text in ("", "ab", "aaaabaa", " der hund und die katze ", "abcabcabd" * 20):
        for ranks in (1, 5, 300):
            assert langid.distances(text, profiles, ranks) == brute(text, profiles, ranks)


def brute(text, profiles, ranks):
    grams = [text[i : i + 3] for i in range(len(text) - 2)]
    own = sorted(set(grams), key=lambda g: (-grams.count(g), g))[:ranks]
    return sorted((sum(abs(p[g] - i) if g in p else ranks for i, g in enumerate(own, 1)), lang) for lang, p in profiles.items())


def test_cursors_and_parsers():
    c = cu.Cursor("chunks_desc", None, "x")
    assert cu.Cursor.decode(c.encode(), "chunks_desc") == c
    for bad in (c.encode()[:-2], "e30"):
        with pytest.raises(ValueError):
            cu.Cursor.decode(bad, "chunks_desc")
    with pytest.raises(ValueError):
        cu.Cursor.decode(c.encode(), "id_asc")
    assert cu.parse_chunk_range("2..5") == (2, 5) and cu.parse_chunk_range("..5") == (None, 5) and cu.parse_chunk_range("3") == (3, 3)
    with pytest.raises(ValueError):
        cu.parse_chunk_range("5..2")
    assert cu.parse_sort("chunks:asc") == "chunks_asc" and cu.parse_sort("id") == "id_asc"
    assert cu.offset_of(3, 25) == 50
    with pytest.raises(ValueError):
        cu.offset_of(2000, 50)


def test_small_text_functions(spark):
    assert one(spark, lambda c: text.truncate_utf8(c, 4), "aéé") == "aé" and one(spark, lambda c: text.truncate_utf8(c, 50), "aéé") == "aéé"
    assert one(spark, text.extract_answer, '{"answer": "3"}') == "3" and one(spark, text.extract_answer, ' "yes" ') == "yes"
    assert one(spark, text.sanitize, "a\n<<<DOCUMENT>>>\n<|x") == "a\n[redacted marker]\n< |x"
    assert one(spark, lambda c: text.thousands(c.cast("long")), "1738163") == "1,738,163"
    assert one(spark, lambda c: text.fuzzy_score(c, "ab"), "a-b") > one(spark, lambda c: text.fuzzy_score(c, "ab"), "xaxb")
    assert one(spark, lambda c: text.fuzzy_score(c, "zz"), "abc") is None


def test_policies_and_configuration():
    assert PRESETS["standard"].digest() != PRESETS["aggressive"].digest()
    with pytest.raises(ValueError):
        Policy(near_auto=0.5, near_review=0.8)
    with pytest.raises(KeyError):
        config.load(tq.Gates, "nonsense: 1")
    g = config.load(tq.Gates, "min_words: 20")
    assert g.min_words == 20 and config.load(tq.Gates, config.dump(g)) == g


def test_half_floats(spark):
    v = [0.1, -2.5, 70000.0, 1e-8]
    got = spark.createDataFrame([(v,)], "v array<float>").select(vec.f16_unpack(vec.f16_pack(F.col("v"))).alias("r")).first()["r"]
    assert np.allclose(got, np.clip(np.array(v), -65504, 65504).astype(np.float16).astype(np.float32))


def test_a_query_string_of_any_length_counts_whole(spark):
    long = "http://a.org/p?" + "&".join(f"k{i:06d}=v" for i in range(150_000))
    same, other, marked = one(spark, url.canonical_key, long), one(spark, url.canonical_key, long + "&z=1"), one(spark, url.canonical_key, long + "&utm_x=1")
    assert same == long and other == long + "&z=1" and marked == long
    assert one(spark, url.canonical_key, "http://a.org/p??b=1&a=2") == "http://a.org/p??b=1&a=2"
