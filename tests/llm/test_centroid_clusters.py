import hashlib
import math

import numpy as np

from tabulon.llm import centroid_clusters as cc
from tabulon.llm import shared

COLUMNS = "vec_id long, embedding array<float>, label int, slot string, x string, cluster string"


def plainly(rows, k, rounds, dims):
    """The contract, read straight."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(x) for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        near = [nearest(x)[1] for _, x in kept]
        for n in range(len(centroids)):
            own = [x for (_, x), m in zip(kept, near, strict=True) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [nearest(x) for _, x in kept]
    total = {n: sum(d for d, m in last if m == n) for n in range(len(centroids))}
    return sorted((str(i), n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, last, strict=True))


def clusters(df, **how):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in cc.cluster_vectors(df, **how).collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(3 * (i % 4), 0.7, 3)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, 2.0]), (63, [1.0, None, 2.0]), (64, [float("nan"), 1.0, 1.0]), (65, [1.0, float("inf"), 1.0]), (66, [1.0, float("-inf"), 1.0])]
    rows += [(70, [0.0, 0.0, 0.0])] * 9 + [(None, [1.0, 1.0, -1.0]), (None, [2.0, -0.5, 0.25]), (5, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, "z", "z", "z") for r in rows], COLUMNS)
    for k in (1, 3, 8):
        assert clusters(df, k=k, rounds=4, dims=3) == plainly(rows, k, 4, 3)
    few = df.filter("vec_id < 3")
    assert clusters(few, k=8, rounds=2, dims=3) == plainly(rows[:3], 8, 2, 3)
    none = cc.cluster_vectors(df.limit(0), dims=3)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(20)] + [(30, [0.5, 0.0])]
    df = spark.createDataFrame([(*r, 1, "z", "z", "z") for r in rows], COLUMNS)
    assert clusters(df, k=8, rounds=3, dims=2) == plainly(rows, 8, 3, 2)


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [2.0**27, 0.0])], "vec_id long, embedding array<double>")
    try:
        cc.cluster_vectors(df, dims=2)
    except Exception as e:
        assert "too large" in str(e)
    else:
        raise AssertionError("not refused")


def test_heaps_spare_comparisons_and_change_nothing():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * (rng.normal(size=(3000, 8)) + 5 * rng.integers(0, 3, (3000, 1)))).astype(np.int64)
    centroids = [list(map(int, c)) for c in x[:6]]
    heaps, sums, drift, compared = None, [[0] * 9 for _ in range(6)], np.zeros(6), []
    for _ in range(15):
        if heaps:
            heaps = cc.Heaps.unpacked(*heaps.packed())
        heaps, gained, n = cc.reassigned(x, heaps, np.array(centroids), drift)
        compared.append(n)
        owner = heaps.owner(len(x))
        assert (owner == cc.distances(x, np.array(centroids)).argmin(1)).all()
        sums = [[a + int(b) for a, b in zip(s, g, strict=True)] for s, g in zip(sums, gained, strict=True)]
        assert all(s == [*x[owner == c].sum(0).tolist(), int((owner == c).sum())] for c, s in enumerate(sums))
        old, centroids = centroids, cc._moved(centroids, sums)
        drift = drift + cc._steps_of(old, centroids)
    assert compared[0] == 3000 and sum(compared[1:]) < 0.5 * 14 * 3000


def test_rounds_join_without_a_shuffle(spark, tmp_path):
    with shared.Buckets(spark, 4, "slot") as buckets:
        a = spark.range(100).selectExpr("id AS slot", "id AS x").repartition(4, "slot")
        one, two = buckets.stored(a, "one"), buckets.stored(a, "two")
        joined = spark.table(one).join(spark.table(two).selectExpr("slot", "x AS y").hint("merge"), "slot")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100 and "Exchange" not in plan
    assert not spark.catalog.tableExists(one) and not buckets.paths
