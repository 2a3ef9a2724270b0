"""Keys that hold very much, and the bands and signals of statistics, against plain readings."""

import datetime
import math
import random

from pyspark.sql import functions as F

from tabulon.operators import joins, ranking, series, statistics


def test_first_on_or_after_of_one_hot_key(spark):
    dice, day = random.Random(1), datetime.date(2024, 1, 1)
    left = [(k, "hot" if k % 5 else "cold", day + datetime.timedelta(dice.randint(0, 900))) for k in range(3000)] + [(9001, None, day), (9002, "hot", None), (9003, "none", day)]
    events = [("hot", day + datetime.timedelta(dice.randint(0, 880))) for _ in range(3000)] + [("cold", day), ("cold", day + datetime.timedelta(500)), ("cold", None), (None, day)]
    a, e = spark.createDataFrame(left, "id long, k string, at date"), spark.createDataFrame(events, "k string, ev date")
    got = {r.id: r["first"] for r in joins.first_on_or_after(a, e, "k", "at", "ev", "first").collect()}
    for i, k, at in left:
        if k is not None and at is not None:
            assert got[i] == min((d for x, d in events if x == k and d is not None and d >= at), default=None)
    assert len(got) == len(left)
    plan = joins.first_on_or_after(a, e, "k", "at", "ev", "first")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (k" not in plan  # dates do not meet events in a join on the key


def test_close_spellings_with_a_part_that_all_share(spark):
    dice = random.Random(2)
    words = sorted({"common" + "".join(dice.choice("abcd") for _ in range(4)) for _ in range(150)} | {"other", "otter", "x", "y"})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i, *row[1:]] if False else _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    want = {(a, b, d) for k, a in enumerate(words) for b in words[k + 1 :] if (d := distance(a, b)) <= 2}
    df = spark.createDataFrame([(w,) for w in words] * 2, "w string")
    for share in (7, 1000):
        assert {tuple(r) for r in joins.close_spellings(df, "w", 2, share).collect()} == want


def test_nearest_ranks(spark):
    dice = random.Random(3)
    rows = [(dice.choice("ab"), dice.randint(0, 30)) for _ in range(500)] + [("c", 7), ("d", None)]
    got = {r.g: (r.x, r.y, r.z) for r in ranking.nearest_ranks(spark.createDataFrame(rows, "g string, v int"), ["g"], "v", {"x": 0.0, "y": 0.3, "z": 1.0}).collect()}
    for g in "abc":
        v = sorted(v for k, v in rows if k == g)
        assert got[g] == tuple(v[max(1, math.ceil(p * len(v) - 1e-9)) - 1] for p in (0.0, 0.3, 1.0))
    assert "d" not in got


def test_survival_band_and_signals(spark):
    rows = [(0, 1, True), (0, 2, True), (0, 2, True), (0, 3, False), (0, 4, True), (0, 5, False)]
    got = statistics.kaplan_meier(spark.createDataFrame([("g", *r) for r in rows], "g string, a int, z int, e boolean"), ["g"], "a", "z", "e").orderBy("t").collect()
    assert [(r.t, r.at_risk, r.events) for r in got] == [(1, 6, 1), (2, 5, 2), (4, 2, 1)] and [round(r.survival, 12) for r in got] == [round(5 / 6, 12), 0.5, 0.25]
    assert abs(got[0].low - 5 / 6 * math.exp(-1.959964 * math.sqrt(1 / 30))) < 1e-6 and got[0].high == 1
    cases = [(1100, 1000, 1.1, "steady"), (1300, 1000, 1.1, "rising"), (2000, 1000, 1.1, "sharp"), (800, 1000, 1.1, "falling"), (40, 10, 1.0, "low"), (300, 5, 1.0, "new"), (None, 10, 1.0, "low")]
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "n int, r int, p int, c double").coalesce(1)
    out = {r.n: r.s for r in df.select("n", statistics.signal(F.col("r"), F.col("p"), F.col("c")).alias("s")).collect()}
    assert [out[k].signal for k in range(len(cases))] == [c[3] for c in cases] and abs(out[2].ratio - 2000 / 1100) < 1e-12


def test_largest_drop(spark):
    rows = [("a", 1, 10), ("b", 1, 10), ("a", 2, 12), ("b", 2, 9), ("a", 3, 5), ("b", 3, 9), ("c", 3, 1), ("a", 4, 20), ("b", 4, 1), ("c", 4, 1), ("a", 5, None), ("b", 5, 14)]
    got = series.largest_drop(spark.createDataFrame(rows, "k string, t int, v int"), "k", "t", "v").collect()
    assert [tuple(r) for r in got] == [(4, 5, 8, "b", -13)]
    assert series.largest_drop(spark.createDataFrame(rows[:4], "k string, t int, v int"), "k", "t", "v").count() == 0


def test_cited_paths(spark):
    nodes = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 9), ("c", 0, 1), ("c", 1, 2), ("d", 0, 1), ("d", 1, 2), ("e", 0, 1), ("e", 1, 2), ("f", 0, 1), ("f", 1, 2), ("f", 2, 3)], "path string, pos int, node int")
    edges = spark.createDataFrame([("a", 0, 1, 2, "cites", True), ("a", 1, 3, 2, "amends", True), ("c", 0, 1, 3, "cites", True), ("d", 0, 1, 2, "cites", None), ("f", 0, 1, 2, "cites", True), ("f", 0, 2, 3, "cites", True)], "path string, pos int, src int, dst int, kind string, visible boolean")
    got = {r.path: (r.nodes, r.problem, r.shown) for r in joins.cited_paths(nodes, edges).collect()}
    assert got == {"a": (3, None, "1 cites>2 amends<3"), "b": (1, None, "9"), "c": (2, "disconnected", None), "d": (2, "hidden", None), "e": (2, "count", None), "f": (3, "count", None)}


def test_reported_facts(spark):
    d = datetime.date
    rows = [("x", "A", d(2023, 1, 1), d(2023, 12, 31), 10.0, "10-K", d(2024, 2, 1)), ("x", "A", d(2023, 1, 1), d(2023, 12, 31), 11.0, "10-K/A", d(2024, 5, 1)), ("x", "B", d(2023, 1, 1), d(2023, 12, 31), 5.0, "10-K", d(2024, 2, 1)), ("x", "A", d(2022, 1, 3), d(2023, 1, 1), 7.0, "10-K", d(2023, 2, 1)),
            ("x", "A", d(2023, 10, 1), d(2023, 12, 31), 3.0, "10-Q", d(2024, 2, 1)), ("x", "A", d(2023, 1, 1), d(2023, 6, 30), 4.0, "10-Q", d(2023, 8, 1)), ("x", "A", None, d(2023, 12, 31), 1.0, "10-K", d(2024, 2, 1)), ("x", "A", d(2023, 1, 1), d(2023, 12, 31), 99.0, "8-K", d(2025, 1, 1)), ("x", "Z", None, d(2020, 1, 1), 1.0, "10-K", d(2020, 2, 1)), ("x", "A", d(2021, 1, 1), d(2021, 12, 31), None, "10-K", d(2022, 1, 1))]
    df = spark.createDataFrame(rows, "k string, concept string, start date, end date, value double, form string, filed date")
    got = sorted((r.grain, str(r.start), r.fiscal_year, r.concept, r.value) for r in series.reported(df, ["k"], ["A", "B"]).collect())
    assert got == sorted([("annual", "2023-01-01", 2023, "A", 11.0), ("annual", "2022-01-03", 2022, "A", 7.0), ("quarterly", "2023-10-01", 2023, "A", 3.0), ("annual", "None", 2023, "A", 1.0), ("quarterly", "None", 2023, "A", 1.0)])
    assert {r.concept for r in series.reported(df, ["k"], ["B", "A"]).filter("grain = 'annual' AND start = '2023-01-01'").collect()} == {"B"}
