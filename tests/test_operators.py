"""Operators against brute force, on inputs that the tables do not hold."""

import collections
import itertools
import random

import numpy as np

from tabulon.operators import joins, search
from tabulon.plans.registry import QUERIES


def test_close_spellings_of_all_parts(spark, tmp_path):
    rows = [(1, "lamp a", "Brand#11"), (401, "lamb a", "Brand#11"), (9000, "limbo a", "Brand#12"), (9001, "zebra a", "Brand#12")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a, r.b, r.distance) for r in QUERIES["j30_all_close_spellings"](spark, str(tmp_path)).collect()}

    def distance(a, b):
        last = list(range(len(b) + 1))
        for k, x in enumerate(a):
            row = [k + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
            last = row
        return last[-1]

    words = sorted({n.split()[0] + b[6:7] for _, n, b in rows})
    want = {(a, b, distance(a, b)) for a, b in itertools.combinations(words, 2) if distance(a, b) <= 2}
    assert got == want and len(want) > 0


def test_nearest_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    got = {(r["query"], r.place): r.id for r in search.nearest(df, df.filter("id % 2 = 0"), "id", "v", 3, 7).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 60, 2):
        for place, k in enumerate(sorted((k for k in range(60) if k != q), key=lambda k: (-round(float(u[q] @ u[k]), 9), k))[:3]):
            want[q, place + 1] = k
    assert got == want


def test_together_in_large_groups(spark):
    dice = random.Random(1)
    rows = [("hot", k) for k in range(1500)] + [(f"g{g}", dice.randrange(1600)) for g in range(20) for _ in range(30)] + [(None, 1), (None, 2), ("g0", None)]
    got = {(r.a, r.b): r.n for r in joins.together(spark.createDataFrame(rows, "g string, i long"), "g", "i", 2).collect()}
    groups = collections.defaultdict(set)
    for g, i in rows:
        if g is not None and i is not None:
            groups[g].add(i)
    n = collections.Counter(p for items in groups.values() for p in itertools.combinations(sorted(items), 2))
    assert got == {p: c for p, c in n.items() if c >= 2} and got


def test_ancestors_of_a_deep_chain(spark):
    edges = [(k, k + 1) for k in range(150)] + [(0, 1), (900, 901), (901, 902), (902, 900)]
    got = {(r.node, r.ancestor): r.steps for r in joins.ancestors(spark.createDataFrame(edges, "n long, p long"), "n", "p").collect()}
    want = {(a, b): b - a for a in range(151) for b in range(a + 1, 151)}
    want |= {(900 + a, 900 + b): (b - a) % 3 for a in range(3) for b in range(3) if a != b}
    assert got == want
