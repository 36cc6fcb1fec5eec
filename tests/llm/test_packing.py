import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


def test_encoder_equals_tokenizer():
    t = Tokenizer.from_file(PATH)
    texts = ["", " ", "a b", "  two  spaces ", "tab\t x\n y", "end ", "don't we'll it's 's 'S", "é  ü　x 12 3,4 ... !!!", "<|endoftext|> x",
             "a\n\nb \n c", "x\x1c y\x85 z", " lead", "\n lead", "many     spaces here", "日本 語 テスト🙂 🙂🙂"]
    rng = random.Random(2)
    texts += ["".join(rng.choices(" \n\taé'sX1.,- ", k=rng.randint(1, 60))) for _ in range(400)]
    e = packing.Encoder(PATH)
    for x in texts * 2:
        assert e.encode(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)


def check(pieces, texts, window=1024):
    t = Tokenizer.from_file(PATH)
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += window - at
    assert padding < window


def test_pieces_cover_and_fill(spark, tmp_path):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma,", "delta.", "x", "tionnd"]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 1500))) for i in range(120)}
    texts |= {200: None, 201: "", 202: " ".join(rng.choices(words, k=60_000))}
    texts |= {300 + i: "same words again " * 100 for i in range(150)}
    rows = [(i, x, 1, "s") for i, x in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n int, row string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    check(packing.op9_packing(spark, str(tmp_path)).collect(), texts)


def test_empty_table_and_one_row(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert packing.op9_packing(spark, str(tmp_path)).collect() == []
    one = packing.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH).collect()
    assert [(r["start"], r["length"], r["offset"]) for r in one] == [(0, 1, 0)]


def test_solve_uses_what_is_there():
    rng = random.Random(1)
    histogram = {r: rng.randint(1, 50) for r in rng.sample(range(1, 1024), 700)}
    counts, left = packing.solve(histogram, 1024)
    used = dict.fromkeys(histogram, 0)
    for parts, times in counts:
        assert sum(parts) == 1024 and times > 0
        for p in parts:
            used[p] += times
    assert all(used[r] + left[r] == histogram[r] and left[r] >= 0 for r in histogram)
    assert sum(left.values()) < 0.3 * sum(histogram.values())
