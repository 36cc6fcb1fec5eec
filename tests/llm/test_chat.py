import itertools
import random

import numpy as np

from lodestone.llm import chat


def brute_cost(roles):
    """Least cost over all ways to place every turn, by search over whole sequences."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            if s != chat.START:
                k = c + chat.MERGE + (0 if s == r else chat.RELABEL)
                new[s] = min(new.get(s, 1 << 30), k)
            for n in range(5):
                for way in itertools.product((1, 2, 3), repeat=n):
                    seq, ok = s, True
                    for t in way:
                        ok, seq = ok and t in chat.NEXT[seq], t
                    if ok:
                        for t in chat.NEXT[seq]:
                            k = c + chat.INSERT * n + (0 if t == r else chat.RELABEL)
                            new[t] = min(new.get(t, 1 << 30), k)
        best = new
    return min(c + chat.INSERT * len(chat.CLOSING[s]) for s, c in best.items())


def cost_of(rows):
    total = 0
    for r in rows:
        total += chat.MERGE if r["action"].startswith("merge") else 0
        total += chat.RELABEL if r["action"].endswith("relabel") else 0
        total += chat.INSERT * len([x for x in r["inserted"].split(",") if x])
    return total


def legal(text):
    roles = [x.split("\n", 1)[0] for x in text.split("<|im_start|>")[1:]]
    if roles and roles[0] == "system":
        roles = roles[1:]
    return roles == ["user", "assistant"] * (len(roles) // 2) and roles and text.count("<|im_end|>") == text.count("<|im_start|>")


def convs():
    rng = random.Random(9)
    names = ["system", "user", "assistant", "tool", None]
    found = {i: [rng.choice(names) for _ in range(rng.randint(1, 7))] for i in range(60)}
    found[100] = [rng.choice(names[:3]) for _ in range(900)]
    found[None] = ["user", "user"]
    return found


def rows_of(found):
    return [(c, i, r, f"t{i} <|im_end|>" if i % 3 else None, "x", 1) for c, rs in found.items() for i, r in enumerate(rs)]


def test_cheapest_and_legal_with_small_chunks(spark):
    found = convs()
    df = spark.createDataFrame(rows_of(found), "conv_id long, turn long, role string, text string, segment string, place int").repartition(3)
    for bits in (3, 15):
        got = {}
        for r in chat.format_chat(df, chunk_bits=bits).collect():
            got.setdefault(r["conv_id"], []).append(r)
        assert set(got) == set(found)
        for c, rs in found.items():
            rows = sorted(got[c], key=lambda r: r["place"])
            assert [r["role"] for r in rows] == rs
            assert cost_of(rows) == brute_cost([chat.role_code(r) for r in rs]), rs
            assert legal("".join(r["segment"] for r in rows)), rows


def test_chunks_are_bounded_by_bytes(spark):
    """Turns of a megabyte in one conversation: few share a chunk, and the repair is the same."""
    from pyspark.sql import functions as F

    roles = ["user", "user", "assistant", "tool", "assistant", "system", "user"] * 2
    df = spark.createDataFrame([(7, i, r) for i, r in enumerate(roles)] + [(8, 0, "user")] * 40, "conv_id long, turn long, role string")
    df = df.withColumn("text", F.when(F.col("conv_id") == 7, F.expr("repeat('wörds ', 150000)")).otherwise(F.lit("same")))
    small, large = (sorted((r["conv_id"], r["place"], r["action"], r["new_role"], r["inserted"], len(r["segment"])) for r in chat.format_chat(df, chunk_bytes=n).collect())
                    for n in (2_200_000, 1 << 40))
    assert small == large and [r[1] for r in small] == [*range(1, 15), *range(1, 41)]
    assert cost_of([{"action": r[2], "inserted": r[4]} for r in small if r[0] == 7]) == brute_cost([chat.role_code(r) for r in roles])


def test_chunk_numbers():
    import pyarrow as pa

    class Part:
        partitionId = staticmethod(lambda: 2)  # noqa: N815

    old, chat.TaskContext = chat.TaskContext, type("Context", (), {"get": staticmethod(lambda: Part)})
    try:
        texts = [["a" * 5, "b" * 5, "c" * 30], ["d", "e", "f", "g"]]
        got = list(chat._chunks((pa.RecordBatch.from_pydict({"text": t}) for t in texts), 3, 10))
    finally:
        chat.TaskContext = old
    base = 2 << 33
    assert [c - base for b in got for c in b["chunk"].to_pylist()] == [0, 0, 1, 2, 2, 2, 3]
    assert [c - base for b in got for c in b["place"].to_pylist()] == list(range(7))


def test_kept_conversation_and_render(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.format_chat(df)).first()["chat"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"


def test_composition():
    rng = random.Random(1)
    roles = [rng.randint(0, 3) for _ in range(40)]
    a, b = chat.compose(roles[:17]), chat.compose(roles[17:])
    assert np.array_equal((a[:, :, None] + b[None]).min(axis=1).clip(max=chat.FAR), chat.compose(roles))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert chat.op5_chat_format(spark, str(tmp_path)).collect() == []
