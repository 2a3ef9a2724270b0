"""Centroid clustering (Lloyd's rounds) with heap-ordered bounds, exact in whole numbers.

A vector is kept if it has the right number of components, none of them null, NaN or infinite; each component x becomes
floor(scale * x).  The first centroids are the kept rows with the smallest sha256 of "seed:id".  Every round assigns all
vectors to the nearest centroid and then moves each centroid that has vectors to the floor of their mean.

Vectors lie in blocks, one row each, in a table bucketed by block.  Of each vector the block's state knows the centroid
and a key: how much nearer that centroid is than the next one, plus the drift that the centroid had gathered when the
key was made.  A centroid's drift grows each round by its own step and the longest step of another one, so as long as a
key is above it no other centroid can have become nearer.  Each block keeps one heap of keys per centroid; only what
has fallen to the drift is popped and compared with all centroids in 64-bit arithmetic.  Keys are floating-point
numbers, made smaller and drifts larger than any rounding error, so they decide only what need not be looked at.

A round joins blocks and states bucket by bucket, without a shuffle, and writes the new states (12 bytes a vector); each
task adds up what moved: k * (dims + 1) whole numbers, and their sums are all that comes to the driver.

Defined results: no kept vector gives no rows; fewer kept rows than k give so many centroids; repeated rows are separate
vectors; rows that share an id are ordered by their components where they compete for a start; a null id counts as an
empty one there and stays null; further columns are ignored; a component of 2^27 or more after scaling is an error, for
distances would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabulon.llm.shared import Buckets, shuffle_width, stored, tidy

BLOCK_ROWS = 1024  # vectors of a block, on average
LARGEST = 1 << 27
SLACK = 1e-12  # rounding errors of roots and sums, relative; many times what they can be

STATE = "slot long, sizes binary, keys binary, rows binary, moved array<bigint>, scanned long"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x array<int>) of the kept rows."""
    x = F.col(vector_col)

    def whole(v: Column) -> Column:
        out = F.floor(v.cast("double") * scale)
        return F.when(F.abs(out) < LARGEST, out).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).cast("int")

    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return df.filter(x.isNotNull() & (F.size(x) == dims) & sound).select(F.col(id_col).alias("vec_id"), F.transform(x, whole).alias("x"))


def _pack(batches):
    """Rows in order of their slot become one row a slot."""
    held: list[pa.RecordBatch] = []

    def block():
        table = pa.Table.from_batches(held)
        flat = pa.concat_arrays([c.flatten() for c in table.column("x").chunks])
        ids = pa.concat_arrays(table.column("vec_id").chunks)
        return pa.RecordBatch.from_arrays([table.column("slot").chunk(0).slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([flat.to_numpy().astype("<i4").tobytes()], pa.binary())], names=["slot", "ids", "x"])

    for batch in batches:
        slot = batch.column("slot").to_numpy()
        cut = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])).tolist() if len(slot) else []
        for lo, hi in zip(cut, [*cut[1:], len(slot)], strict=True):
            if held and held[-1].column("slot")[0].as_py() != slot[lo]:
                yield block()
                held.clear()
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield block()


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


class Heaps:
    """One heap per centroid of (key, row of the block)."""

    def __init__(self, heaps: list[list[tuple[float, int]]]):
        self.heaps = heaps

    @classmethod
    def unpacked(cls, sizes: bytes, keys: bytes, rows: bytes) -> Heaps:
        pairs = list(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(rows, "<i4").tolist(), strict=True))
        cut = np.cumsum([0, *np.frombuffer(sizes, "<i4").tolist()]).tolist()
        return cls([pairs[a:z] for a, z in zip(cut, cut[1:], strict=False)])

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """In the order of the heaps' own lists, so that they are heaps again when read."""
        pairs = [p for h in self.heaps for p in h]
        return np.array([len(h) for h in self.heaps], "<i4").tobytes(), np.array([p[0] for p in pairs], "<f8").tobytes(), np.array([p[1] for p in pairs], "<i4").tobytes()

    def expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of all whose key the drift has reached; they leave their heaps."""
        rows, owners = [], []
        for c, (heap, reached) in enumerate(zip(self.heaps, drift.tolist(), strict=True)):
            while heap and heap[0][0] <= reached:
                rows.append(heapq.heappop(heap)[1])
                owners.append(c)
        return np.array(rows, np.int64), np.array(owners, np.int64)

    def add(self, rows: np.ndarray, owners: np.ndarray, keys: np.ndarray) -> None:
        for row, c, key in zip(rows.tolist(), owners.tolist(), keys.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (key, row))

    def owner(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int64)
        for c, heap in enumerate(self.heaps):
            out[[p[1] for p in heap]] = c
        return out


def reassigned(x: np.ndarray, heaps: Heaps | None, centroids: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, int]:
    """New heaps, what each centroid gains in components and in vectors, and how many vectors were compared.  Without
    heaps all are compared and gained."""
    k, dims = centroids.shape
    if heaps is None:
        heaps = Heaps([[] for _ in range(k)])
        rows, before = np.arange(len(x)), np.full(len(x), -1)
    else:
        rows, before = heaps.expired(drift)
    own = x[rows].astype(np.int64)
    d = distances(own, centroids)
    near = d.argmin(1)  # of equally near ones the smallest number
    first = np.sqrt(np.take_along_axis(d, near[:, None], 1)[:, 0].astype(np.float64))
    np.put_along_axis(d, near[:, None], np.iinfo(np.int64).max, 1)
    second = np.sqrt(d.min(1).astype(np.float64)) if k > 1 else np.full(len(rows), np.inf)
    key = second - first + drift[near]
    key -= SLACK * (1 + np.where(np.isfinite(second), second, 0) + first + drift[near])
    heaps.add(rows, near, key)
    gained = np.zeros((k, dims + 1), np.int64)
    for c in range(k):
        to, off = (near == c) & (before != c), (before == c) & (near != c)
        gained[c, :dims] = own[to].sum(0) - own[off].sum(0)
        gained[c, dims] = int(to.sum()) - int(off.sum())
    return heaps, gained, len(rows)


def _rounds(centroids: np.ndarray, drift: np.ndarray):
    dims = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], "<i4").reshape(-1, dims)
                heaps = Heaps.unpacked(row["sizes"], row["keys"], row["rows"]) if "keys" in row else None
                heaps, gained, n = reassigned(x, heaps, centroids, drift)
                out.append((row["slot"], *heaps.packed(), gained.ravel().tolist(), n))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=["slot", "sizes", "keys", "rows", "moved", "scanned"])

    return assign


def _total(batches):
    """What a task's blocks gain together."""
    total = None
    for batch in batches:
        moved = batch.column("moved")
        for part in [moved.flatten().to_numpy().reshape(len(moved), -1).sum(0)] if len(moved) else []:
            total = part if total is None else total + part
    at = np.flatnonzero(total) if total is not None else np.empty(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at] if len(at) else at, pa.int64())], names=["at", "v"])


def _members(centroids: np.ndarray):
    def members(batches):
        for batch in batches:
            for at, row in enumerate(batch.select(["x", "sizes", "keys", "rows"]).to_pylist()):
                x = np.frombuffer(row["x"], "<i4").reshape(-1, centroids.shape[1]).astype(np.int64)
                owner = Heaps.unpacked(row["sizes"], row["keys"], row["rows"]).owner(len(x))
                far = ((x - centroids[owner]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(at, 1).flatten(), pa.array(owner, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    return members


def _moved(centroids: list[list[int]], sums: list[list[int]]) -> list[list[int]]:
    """Each centroid's floor of the mean; one without vectors stays."""
    return [[s // total[-1] for s in total[:-1]] if total[-1] else old for old, total in zip(centroids, sums, strict=True)]


def _steps_of(old: list[list[int]], new: list[list[int]]) -> np.ndarray:
    """How much the drift of each centroid grows: its own step and the longest one of the others, rounded up."""
    own = [math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) * (1 + SLACK) for x, y in zip(old, new, strict=True)]
    return np.array([x + max([0.0, *own[:c], *own[c + 1 :]]) for c, x in enumerate(own)])


@tidy
def cluster_vectors(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector after `rounds` rounds and
    one more assignment.  Distances are squared; inertia is their sum."""
    spark, kept = df.sparkSession, whole_vectors(df, id_col, vector_col, dims, scale)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    seen = Observation()
    named = kept.observe(seen, F.count(F.lit(1)).alias("n")).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "x")
    centroids = [r["x"] for r in named.orderBy("h", "x").limit(k).collect()]
    n = shuffle_width(spark)
    slots = max(n, math.ceil(seen.get["n"] / BLOCK_ROWS))
    with Buckets(spark, n, "slot") as buckets:
        # the input's partition takes part, so that copies of one row are dealt out too
        dealt = kept.withColumn("slot", F.pmod(F.xxhash64("vec_id", "x", F.spark_partition_id()), F.lit(slots)))
        packed = dealt.repartition(n, "slot").sortWithinPartitions("slot").select("slot", "vec_id", "x").mapInArrow(_pack, f"slot long, ids array<{id_type}>, x binary")
        blocks, states = buckets.stored(packed, "blocks"), None
        sums = [[0] * (dims + 1) for _ in centroids]
        drift = np.zeros(len(centroids))
        for r in range(rounds + 1 if centroids else 0):
            rows = spark.table(blocks).select("slot", "x")
            if states:
                rows = rows.join(spark.table(states).select("slot", "sizes", "keys", "rows").hint("merge"), "slot")
            before, states = states, buckets.stored(rows.mapInArrow(_rounds(np.array(centroids, np.int64), drift), STATE), "states")
            if before:
                buckets.drop(before)
            if r < rounds:
                gained = spark.table(states).select("moved").mapInArrow(_total, "at int, v long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
                for row in gained.collect():  # k * (dims + 1) numbers
                    sums[row["at"] // (dims + 1)][row["at"] % (dims + 1)] += int(row["v"])
                old, centroids = centroids, _moved(centroids, sums)
                drift = drift + _steps_of(old, centroids)
        if not centroids:
            return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
        joined = spark.table(blocks).join(spark.table(states).select("slot", "sizes", "keys", "rows").hint("merge"), "slot")
        members = stored(joined.mapInArrow(_members(np.array(centroids, np.int64)), f"vec_id {id_type}, cluster int, distance long"), "members")
        inertia = {r["cluster"]: int(r["total"]) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
        about = [(c, own, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, own in inertia.items()]
        clusters = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return members.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
