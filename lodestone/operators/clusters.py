"""Clusters of near duplicates: representatives and membership, never all pairs of a group.

Documents with one signature have one representative.  In every band bucket all
representatives are held against the bucket's first and last, which joins a group of near
copies with twice as many comparisons as it has members.  What is then left are buckets in
which several clusters meet.  Their members are dealt into parts, a large cluster into parts
of its own, and only parts of unlike clusters are compared, in bounded cells that return links
between clusters.  So all pairs that could join two clusters are looked at, and pairs inside one are
not.  Work grows with the square only of texts that share a band and are not alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import minhash as mh
from lodestone.sources.scratch import keep

from .components import components
from .duplicates import STORE_SIMILARITY

#: Representatives on one side of a cell, about.
PART = 256


def sig_key(sig: Column) -> Column:
    """The name of a signature: equal for equal ones."""
    return F.sha2(F.array_join(sig, ","), 256)


def similar(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach ``least``; ``sigs``: (id, sig).  Both ends may be hubs: plain tables are joined."""
    side = lambda n: sigs.select(F.col("id").alias(n), F.col("sig").alias(f"sig_{n}"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", mh.estimated_jaccard(F.col("sig_a"), F.col("sig_b")).alias("similarity"))
    return scored.filter(F.col("similarity") >= least)


def _crossing(met: DataFrame, least: float) -> DataFrame:
    """(a, b): clusters joined by a pair within the cells (cell, side, cluster, sig)."""
    def links(side: np.ndarray, clusters: np.ndarray, sigs: np.ndarray, same: bool) -> set[tuple[str, str]]:
        left, right = np.nonzero(side == 0)[0], np.nonzero(side == (0 if same else 1))[0]
        found = set()
        for i in left.tolist():
            other = right[clusters[right] != clusters[i]]
            alike = ((sigs[other] == sigs[i]) & (sigs[other] != -1)).mean(axis=1) >= least
            found |= {(clusters[i], c) for c in np.unique(clusters[other[alike]])}
        return {(max(p), min(p)) for p in found}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []

        def done() -> pa.RecordBatch:
            found = links(np.array([r[1] for r in own]), np.array([r[2] for r in own], object), np.array([r[3] for r in own], np.int64), own[0][4])
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.string()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for r in zip(*(b[c].to_pylist() for c in ("cell", "side", "cluster", "sig", "same")), strict=True):
                if own and r[0] != own[0][0]:
                    yield done()
                    own = []
                own.append(r)
        if own:
            yield done()

    return met.select("cell", "side", "cluster", "sig", "same").repartition("cell").sortWithinPartitions("cell").mapInArrow(each, "a string, b string").distinct()


def near_clusters(signed: DataFrame, least: float = STORE_SIMILARITY, part: int = PART) -> DataFrame:
    """(document_id, representative, cluster_id, cluster_size) of (id, sig, bands): clusters under links of at least ``least``.

    ``representative`` is the first document with the same signature, ``cluster_id`` the first
    of all that are connected; a document without links is a cluster of its own.
    """
    keyed = keep(signed.select("id", "sig", "bands", sig_key(F.col("sig")).alias("key")), "cluster-signatures")
    firsts = keep(keyed.groupBy("key").agg(F.min("id").alias("rep")), "cluster-firsts")
    reps = keep(keyed.join(firsts, "key").filter("id = rep").dropDuplicates(["id"]).select("id", "sig", "bands"), "cluster-representatives")

    banded = reps.select("id", F.posexplode("bands").alias("band", "hash"))
    ends = banded.groupBy("band", "hash").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last")
    banded = keep(banded.join(keep(ends, "cluster-ends"), ["band", "hash"]), "cluster-bands")
    star = banded.select("id", F.explode(F.array("first", "last")).alias("end")).filter("id <> end").select(F.greatest("id", "end").alias("a"), F.least("id", "end").alias("b")).distinct()
    roots = components(similar(keep(star, "cluster-stars"), reps, least))

    named = banded.join(keep(roots, "cluster-roots"), F.col("id") == F.col("node"), "left").select("band", "hash", "id", F.coalesce("root", "id").alias("cluster"))
    mixed = named.groupBy("band", "hash").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).filter("low <> high").select("band", "hash")
    named = keep(named.join(mixed, ["band", "hash"]), "cluster-mixed")
    sizes = named.groupBy("band", "hash", "cluster").count()
    shared = sizes.filter(F.col("count") < part).groupBy("band", "hash").agg(F.sum("count").alias("n")).select("band", "hash", F.lit("").alias("own"), "n")
    parts = sizes.filter(F.col("count") >= part).select("band", "hash", F.col("cluster").alias("own"), F.col("count").alias("n")).union(shared)
    parts = keep(parts.withColumn("parts", F.ceil(F.col("n") / part).cast("int")).drop("n"), "cluster-parts")
    placed = named.join(parts.filter("own <> ''").withColumnsRenamed({"parts": "p", "own": "cluster"}), ["band", "hash", "cluster"], "left")
    placed = placed.join(parts.filter("own = ''").withColumnsRenamed({"parts": "q"}).drop("own"), ["band", "hash"], "left")
    # A cluster's members go to its own parts, or to those that small clusters share; a cluster stays whole there.
    placed = placed.select("band", "hash", "id", "cluster", F.when(F.col("p").isNotNull(), F.col("cluster")).otherwise("").alias("own"),
                           F.when(F.col("p").isNotNull(), F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.pmod(F.xxhash64("cluster"), F.col("q"))).cast("int").alias("i"))
    one = parts.select("band", "hash", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    x, y = one.withColumnsRenamed({"own": "own0", "i": "i0"}), one.withColumnsRenamed({"own": "own1", "i": "i1"})
    after = (F.col("own0") < F.col("own1")) | ((F.col("own0") == "") & (F.col("own1") == "") & (F.col("i0") <= F.col("i1")))
    cells = x.join(y, ["band", "hash"]).filter(after).withColumn("cell", F.xxhash64("band", "hash", "own0", "i0", "own1", "i1"))  # parts of one bucket, not its members
    cells = keep(cells.withColumn("same", (F.col("own0") == F.col("own1")) & (F.col("i0") == F.col("i1"))), "cluster-cells")
    side = lambda n: cells.select("band", "hash", F.col(f"own{n}").alias("own"), F.col(f"i{n}").alias("i"), "cell", "same", F.lit(n).alias("side"))
    met = placed.join(side(0).union(side(1).filter("not same")), ["band", "hash", "own", "i"]).select("cell", "side", "same", "cluster", "id")
    crossing = _crossing(met.join(reps.select("id", "sig"), "id"), least)

    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(crossing)
    final = keep(components(keep(joined, "cluster-joined")), "cluster-final")
    members = keyed.select("id", "key").join(firsts, "key").join(final, F.col("rep") == F.col("node"), "left")
    members = keep(members.select(F.col("id").alias("document_id"), F.col("rep").alias("representative"), F.coalesce("root", "rep").alias("cluster_id")), "cluster-members")
    counts = keep(members.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")), "cluster-sizes")
    return members.join(counts, "cluster_id").select("document_id", "representative", "cluster_id", "cluster_size")
