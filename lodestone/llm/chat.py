"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn,
ending with the assistant.  Every input turn may keep its role, take another, or be
merged into the turn before it; empty turns may be inserted.  Dynamic programming
over the automaton's states (the role of the last turn) finds the cheapest repair;
of equal costs, the earlier entry of ``ACTIONS`` and then the smaller state wins.
The repaired sequence is rendered in ChatML, one segment per input turn; the
segments of a conversation, joined in order, are its text.

Costs compose: the turns of a stretch act as one (min, +) matrix over the states.
So the sorted turns are cut into chunks of bounded size, each chunk sums up its
part of a conversation in one matrix, the few matrices of a conversation that
crosses chunks fix the states at the cuts, and each chunk then repairs its own
turns.  A conversation that holds a third of all turns spreads over many tasks.

Edge cases: unknown and null roles may become any role at the price of a relabel;
null text is empty; null conv_id is a conversation of its own; turns are ordered by
turn (nulls first), role and text, so repeated rows are repeated turns; markers of
the format inside a text are broken up.  A very long conversation is cut into chunks by
turns and by bytes; a very long turn stays whole, alone in its chunk if need be, so a task holds
``CHUNK_BYTES`` of text or one turn.  Turns that are equal in all are dealt out by their place in the
input, so they too spread over many tasks.  Extra columns are ignored, whatever their names.  An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ACTIONS = ("keep", "merge", "relabel", "merge_relabel")
RELABEL, MERGE, INSERT = 2, 1, 3
#: Turns in a chunk, at most, as a power of two.
CHUNK_BITS = 15
#: Bytes of text in a chunk of more than one turn, at most.
CHUNK_BYTES = 32 << 20
FAR = 1 << 40


def _paths() -> dict[tuple[int, int], list[int]]:
    """The empty turns to insert so that the second state's turn may follow the first state."""
    found = {}
    for s in range(4):
        ways: list[tuple[int, list[int]]] = [(s, [])]
        for at, inserted in ways:
            for t in NEXT[at]:
                if (s, t) not in found:
                    found[s, t] = inserted
                    ways.append((t, [*inserted, t]))
    return found


PATHS = _paths()


def steps(role: int) -> list[list[tuple[int, int, list[int]] | None]]:
    """[from][to] -> (cost, action, inserted) of the cheapest way to place a turn; role 0: unknown."""
    table: list[list[tuple[int, int, list[int]] | None]] = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            ways = []
            if (s, t) in PATHS:
                own = t == role
                ways.append((INSERT * len(PATHS[s, t]) + (0 if own else RELABEL), 0 if own else 2, PATHS[s, t]))
            if s == t:
                own = t == role
                ways.append((MERGE + (0 if own else RELABEL), 1 if own else 3, []))
            table[s][t] = min(ways, key=lambda w: w[:2]) if ways else None
    return table


STEPS = [steps(r) for r in range(4)]
COST = np.array([[[w[0] if w else FAR for w in row] for row in table] for table in STEPS])
#: What must be appended after the last state: nothing, user and assistant, assistant, nothing.
CLOSING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
END = np.array([INSERT * len(CLOSING[s]) for s in range(4)])


def role_code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def compose(roles: list[int]) -> np.ndarray:
    """The (min, +) matrix of a stretch of turns."""
    m = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        m = np.minimum(FAR, (m[:, :, None] + COST[r][None, :, :]).min(axis=1))
    return m


def best_states(matrices: list[np.ndarray], entry: int, exit_cost: np.ndarray) -> list[int]:
    """The states after each matrix on the cheapest way from ``entry``; least state of equals."""
    costs = np.where(np.arange(4) == entry, 0, FAR)
    back = []
    for m in matrices:
        ways = costs[:, None] + m
        back.append(ways.argmin(axis=0))
        costs = np.minimum(FAR, ways.min(axis=0))
    states = [int((costs + exit_cost).argmin())]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


def _open(role: int, text: str, first: bool) -> str:
    return ("" if first else "<|im_end|>\n") + f"<|im_start|>{ROLES[role - 1]}\n{text}"


def repair(roles: list[int], texts: list[str], entry: int, leave: int, last: bool) -> Iterator[tuple[str, str, str, str]]:
    """(action, new role, inserted roles, segment) of each turn between two known states."""
    states = best_states([COST[r] for r in roles], entry, np.where(np.arange(4) == leave, 0, FAR * 4))
    at = entry
    for i, (r, text, to) in enumerate(zip(roles, texts, states, strict=True)):
        _, action, inserted = STEPS[r][at][to]
        text = text.replace("<|im_", "< |im_")
        if ACTIONS[action].startswith("merge"):
            segment = "\n\n" + text
        else:
            segment, before = "", at
            for t in inserted:
                segment += _open(t, "", before == START)
                before = t
            segment += _open(to, text, before == START)
        added = [ROLES[t - 1] for t in inserted]
        if last and i == len(roles) - 1:
            for t in CLOSING[to]:
                segment += _open(t, "", False)
                added.append("then " + ROLES[t - 1])
            segment += "<|im_end|>\n"
        yield ACTIONS[action], ROLES[to - 1], ",".join(added), segment
        at = to


def _stretches(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, from sorted batches."""
    own: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if own and any(r[k] != own[0][k] for k in keys):
                yield own
                own = []
            own.append(r)
    if own:
        yield own


def _chunks(batches: Iterator[pa.RecordBatch], most: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Number the turns of a sorted partition, and cut them into chunks by turns and by bytes of text."""
    first = TaskContext.get().partitionId() << 33
    place = chunk = turns = held = 0
    for b in batches:
        chunks = []
        for size in pc.binary_length(b["text"]).to_pylist():
            if turns == most or (turns and held + size > limit):
                chunk, turns, held = chunk + 1, 0, 0
            turns, held = turns + 1, held + size
            chunks.append(first + chunk)
        places = np.arange(first + place, first + place + len(chunks))
        place += len(chunks)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64()), pa.array(chunks, pa.int64())], [*b.schema.names, "place", "chunk"])


def format_chat(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                chunk_bits: int = CHUNK_BITS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per turn: conv_id, turn, role, place (from 1 in its conversation), action, new_role, inserted, segment."""
    turns = df.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Bounds are sampled, so no texts; equal turns differ by their place in the input.
    turns = turns.withColumn("hash", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "role", "hash", "copy")
    turns = turns.sortWithinPartitions("conv_id", "turn", "role", "hash", "text").drop("hash", "copy").mapInArrow(
        lambda batches: _chunks(batches, 1 << chunk_bits, chunk_bytes), "conv_id long, turn long, role string, text string, place long, chunk long")
    turns = turns.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    turns = common.keep(turns, "turns")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _stretches(batches, ("chunk", "conv")):
            m = compose([role_code(r["role"]) for r in own])
            yield pa.RecordBatch.from_pydict({"conv": [own[0]["conv"]], "chunk": [own[0]["chunk"]], "turns": [len(own)], "matrix": [m.ravel().tolist()]})

    matrices = turns.select("conv", "chunk", "place", "role").repartition("chunk").sortWithinPartitions("chunk", "place").mapInArrow(
        sums, "conv string, chunk long, turns long, matrix array<long>")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _stretches(batches, ("conv",)):
            found = best_states([np.array(r["matrix"]).reshape(4, 4) for r in own], START, END)
            yield pa.RecordBatch.from_pydict({
                "conv": [r["conv"] for r in own], "chunk": [r["chunk"] for r in own], "enters": pa.array([START, *found[:-1]], pa.int32()),
                "leaves": pa.array(found, pa.int32()), "before": pa.array([0, *accumulate(r["turns"] for r in own[:-1])], pa.int64()), "last": [i == len(own) - 1 for i in range(len(own))]})

    cuts = matrices.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(
        states, "conv string, chunk long, enters int, leaves int, before long, last boolean")
    cuts = common.keep(cuts, "turn-states")

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _stretches(batches, ("conv", "chunk")):
            first = own[0]
            found = list(repair([role_code(r["role"]) for r in own], [r["text"] for r in own], first["enters"], first["leaves"], first["last"]))
            columns = {c: pa.array([r[c] for r in own], t) for c, t in (("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()))}
            columns["place"] = pa.array([first["before"] + 1 + i for i in range(len(own))], pa.int64())
            columns |= {c: pa.array([f[i] for f in found], pa.string()) for i, c in enumerate(("action", "new_role", "inserted", "segment"))}
            yield pa.RecordBatch.from_pydict(columns)

    ready = turns.join(cuts, ["conv", "chunk"]).sortWithinPartitions("conv", "chunk", "place")
    return ready.select("conv", "chunk", "place", "conv_id", "turn", "role", "text", "enters", "leaves", "before", "last").mapInArrow(
        repaired, "conv_id long, turn long, role string, place long, action string, new_role string, inserted string, segment string")


def render(segments: DataFrame) -> DataFrame:
    """(conv_id, chat): the segments of each conversation joined; for conversations that fit a row."""
    return segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "segment"))).alias("s")).select(
        "conv_id", F.array_join(F.col("s.segment"), "").alias("chat"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired and rendered turns of every conversation."""
    found = format_chat(common.table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", F.col("place").cast("int").alias("place"), "role", "action", "new_role", "inserted", "segment")
