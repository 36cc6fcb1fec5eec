"""Tables that change together: folders written once, and a manifest that names the current ones.

A table lies in buckets by a hash of its keys.  A commit writes new folders for the buckets
it changes, of any number of tables, and then puts down the next manifest, one small file:
readers see the state before or after, never a part.  A manifest also holds the last batch of
each writer, so a batch that is played again after it was committed changes nothing, and notes
(cursors, phases) that move with the data they belong to.  A failure before the manifest
leaves folders that no manifest names; ``clean`` removes those.

Two writers that start from one manifest want the same file; the second gets ``Conflict``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 32


class Conflict(RuntimeError):
    """Another writer has committed since this one read the state."""


@dataclass
class Change:
    """What a commit does to one table: its rows in ``buckets`` (all, if None) are replaced by those of ``rows``, or ``rows`` are added."""

    rows: DataFrame
    keys: list[str]
    buckets: set[int] | None = None
    append: bool = False


@dataclass
class State:
    number: int = 0
    tables: dict[str, dict[str, Any]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict[str, Any] = field(default_factory=dict)


class Tables:
    """The tables under one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- state ------------------------------------------------------------------------------------------------------

    def _path(self, *parts: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._path(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def state(self) -> State:
        """The latest manifest that is whole."""
        for name in reversed(self._names("manifests")):
            fs, at = self._path("manifests", name)
            stream = fs.open(at)
            try:
                return State(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            except ValueError:  # a writer died while it wrote this file
                continue
            finally:
                stream.close()
        return State()

    def _put(self, state: State) -> None:
        fs, at = self._path("manifests", f"{state.number:012d}.json")
        if fs.exists(at):
            raise Conflict(f"manifest {state.number} is there already")
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(state.__dict__).encode()))
        out.close()

    # --- reading ----------------------------------------------------------------------------------------------------

    def bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *keys: str) -> set[int]:
        """The buckets that rows with these keys lie in: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.bucket(*keys)).distinct().collect()}

    def has(self, name: str) -> bool:
        return name in self.state().tables

    def read(self, name: str, buckets: Iterable[int] | None = None, state: State | None = None) -> DataFrame:
        """The table, or only the files of some of its buckets."""
        table = (state or self.state()).tables[name]
        schema = StructType.fromJson(table["schema"])
        wanted = table["parts"] if buckets is None else {str(b) for b in buckets} & set(table["parts"])
        paths = sorted(f"{self.root}/{p}" for b in wanted for p in table["parts"][b])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- writing ----------------------------------------------------------------------------------------------------

    def commit(self, changes: dict[str, Change], batch: tuple[str, int] | None = None, notes: dict[str, Any] | None = None, state: State | None = None) -> bool:
        """All changes or none; False, and nothing done, if this writer has committed the batch (writer, number) before."""
        state = state or self.state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return False
        tables = {k: {"schema": t["schema"], "parts": dict(t["parts"])} for k, t in state.tables.items()}
        for name, change in changes.items():
            folder = f"{name}/{uuid.uuid4().hex}"
            schema = change.rows.schema
            change.rows.withColumn("_bucket", self.bucket(*change.keys)).repartition("_bucket").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
            written = {n.removeprefix("_bucket="): [f"{folder}/{n}"] for n in self._names(folder) if n.startswith("_bucket=")}
            parts = tables.get(name, {"parts": {}})["parts"]
            if change.append:
                written = {b: parts.get(b, []) + p for b, p in written.items()}
                parts = {**parts, **written}
            elif change.buckets is None:
                parts = written
            else:
                if stray := set(written) - {str(b) for b in change.buckets}:
                    raise ValueError(f"rows of {name} outside of the buckets to be replaced: {sorted(stray)[:5]}")
                parts = {b: p for b, p in parts.items() if int(b) not in change.buckets} | written
            tables[name] = {"schema": json.loads(schema.json()), "parts": parts}
        newest = max([state.number, *(int(n.removesuffix(".json")) for n in self._names("manifests")[-1:] if not self._whole(n))])
        self._put(State(newest + 1, tables, state.batches | ({batch[0]: batch[1]} if batch else {}), state.notes | (notes or {})))
        return True

    def _whole(self, name: str) -> bool:
        return self.state().number >= int(name.removesuffix(".json"))

    def upsert(self, name: str, new: DataFrame, keys: list[str], order: list[str], batch: tuple[str, int] | None = None) -> bool:
        """Rows of ``new`` by their keys; of several with one key, stored or new, the greatest by ``order`` and then by all columns stays.

        Only buckets that ``new`` touches are read and written.  Batches may come in any order.
        """
        state = self.state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return False
        hit = self.touched(new, *keys)
        columns = new.columns
        rows = self.read(name, hit, state).select(*columns).unionByName(new) if name in state.tables else new
        rest = [c for c in columns if c not in keys and c not in order]
        last = F.max(F.struct(*order, *rest)).alias("_last")
        merged = rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in columns])
        return self.commit({name: Change(merged, keys, hit)}, batch, state=state)

    def clean(self, keep: int = 1) -> int:
        """Remove manifests but the last ``keep`` and all folders that those do not name; how many folders went.  No writer may be at work."""
        names = self._names("manifests")
        for n in names[:-keep]:
            fs, at = self._path("manifests", n)
            fs.delete(at, False)
        live: set[str] = set()
        for n in names[-keep:]:
            fs, at = self._path("manifests", n)
            stream = fs.open(at)
            try:
                kept = State(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            except ValueError:
                continue
            finally:
                stream.close()
            live |= {p for t in kept.tables.values() for ps in t["parts"].values() for p in ps}
        gone = 0
        for table in self._names():
            if table == "manifests":
                continue
            for folder in self._names(table):
                parts = [p for p in self._names(table, folder) if p.startswith("_bucket=")]
                dead = [p for p in parts if f"{table}/{folder}/{p}" not in live]
                for p in [f"{folder}/{p}" for p in dead] if len(dead) < len(parts) else [folder]:
                    fs, at = self._path(table, p)
                    fs.delete(at, True)
                    gone += 1
        return gone


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
