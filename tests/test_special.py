"""Special functions, interest, months, docket dates and nearest rows against closed forms and plain readings."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import dates, special, text
from tabulon.operators import calculators, search, statistics


def values(spark, f, rows):
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"c{k} double" for k in range(len(rows[0]))))
    return [r[0] for r in df.coalesce(1).select(f(*[F.col(c) for c in df.columns])).collect()]


def test_distributions(spark):
    x = [0.5, 1, 5, 0.3, 10.5, 100, 1e6]
    assert values(spark, special.log_gamma, [(v,) for v in x]) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)
    x = [-3, -0.5, 0, 0.5, 1.9, 2, 2.01, 3, 5, 10]
    assert values(spark, special.erfc, [(v,) for v in x]) == pytest.approx([math.erfc(v) for v in x], rel=1e-12)
    p = [0.975, 0.5, 0.005, 1e-10, 0.999]
    assert values(spark, special.normal_quantile, [(v,) for v in p]) == pytest.approx([1.959963984540054, 0, -2.5758293035489, -6.361340902404056, 3.090232306167813], abs=1e-12)
    assert values(spark, special.normal_quantile, [(0,), (1,), (-1,)]) == [None] * 3
    beta = [(0.3, 1, 1), (0.5, 2, 2), (0.2, 2, 3), (0, 1, 2), (1, 1, 2), (0.9, 5, 2), (0.999, 1, 4)]
    assert values(spark, special.incomplete_beta, beta) == pytest.approx([0.3, 0.5, 0.1808, 0, 1, 6 * 0.9**5 - 5 * 0.9**6, 1 - 0.001**4], abs=1e-12)
    t = [(2.262157, 9), (3.249836, 9), (1.959964, 1e7), (0, 5), (12.70620474, 1), (2.008559112, 50), (2.228138852, 10)]
    assert values(spark, special.t_two_sided, t) == pytest.approx([0.05, 0.01, 0.05, 1, 0.05, 0.05, 0.05], abs=1e-6)
    assert values(spark, statistics.correlation_p, [(1, 5), (-1, 5), (0, 5), (0.5, 2)]) == [0, 0, 1, None]


def test_whole_months(spark):
    rows = [("2024-01-31", "2024-02-29"), ("2024-01-31", "2024-03-31"), ("2024-01-30", "2024-02-29"), ("2024-02-29", "2025-02-28"), ("2024-05-05", "2024-05-04"), ("2024-05-05", "2024-05-05"), (None, "2024-05-05")]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    assert [r[0] for r in df.select(dates.whole_months_between(F.to_date("a"), F.to_date("b"))).collect()] == [0, 2, 0, 11, None, 0, None]


def test_interest_by_days_of_each_year(spark):
    def plainly(p, rate, start, end, basis):
        def anniversary(n):
            year = start.year + n
            day = 28 if (start.month, start.day) == (2, 29) and not (year % 4 == 0 and (year % 100 or year % 400 == 0)) else start.day
            return datetime.date(year, start.month, day)

        if end < start:
            return None
        balance, n = p, 1
        while anniversary(n - 1) < end:
            to = min(anniversary(n), end)
            balance *= 1 + rate * (to - anniversary(n - 1)).days / (basis or (anniversary(n) - anniversary(n - 1)).days)
            n += 1
        return balance - p

    dice, day = random.Random(3), datetime.date(1999, 12, 1)
    rows = [(100.0, day + datetime.timedelta(dice.randint(0, 2000)), day + datetime.timedelta(dice.randint(0, 5000))) for _ in range(150)]
    rows += [(100.0, datetime.date(2004, 2, 29), datetime.date(y, m, d)) for y, m, d in ((2005, 2, 28), (2005, 3, 1), (2008, 2, 28), (2008, 2, 29), (2004, 2, 29), (2016, 2, 29))]
    df = spark.createDataFrame(rows, "p double, a date, z date").coalesce(1)
    for basis in (365, None):
        got = [r[0] for r in df.select(calculators.compounded_interest(F.col("p"), F.lit(0.05), F.col("a"), F.col("z"), basis)).collect()]
        want = [plainly(p, 0.05, a, z, basis) for p, a, z in rows]
        assert [g is None for g in got] == [w is None for w in want]
        assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], abs=1e-9)


ENTRIES = {
    "Jury Selection set for 2/3/2027 08:00 AM in Courtroom 4. Jury Trial set for 2/8/2027 08:00 AM.": [("Jury Selection", "set for", "2027-02-03", "08:00 AM", False), ("Jury Trial", "set for", "2027-02-08", "08:00 AM.", False)],
    "CLERK'S NOTICE. Jury Trial set for 8/20/2026, is hereby VACATED and continued to 8/24/2026.": [("Jury Trial", "set for", "2026-08-20", None, True), ("Jury Trial", "continued to", "2026-08-24", None, False)],
    "Hearing set for 1/5/2027, Jury Trial set for 2/8/2027 is vacated": [("Hearing", "set for", "2027-01-05", None, False), ("Hearing", "set for", "2027-02-08", None, True)],
    "Signed by Judge A on 5/21/2026. (Filed on 5/21/2026)": [],
    "Hearing set for 2/30/2027.": [],
    "Hearing set for 2/30/2027, is vacated; and the  Reply   due  by 3/1/2027, at 5:00 p.m. Order vacated.": [("Reply", "due by", "2027-03-01", "5:00 p.m.", False)],
    "set for 1/1/2027": [(None, "set for", "2027-01-01", None, False)],
    "It is ordered that and the X: Y) Conference is set for 1/1/1899 and continued to 1/2/2027": [("Conference is set for 1/1/1899 and", "continued to", "2027-01-02", None, False)],
}


def test_docket_dates(spark):
    df = spark.createDataFrame([(k, e) for k, e in enumerate([*ENTRIES, None, ""])], "k int, e string").coalesce(1)
    got = {r.k: r.d for r in df.select("k", text.docket_dates("e").alias("d")).collect()}
    for k, want in enumerate([*ENTRIES.values(), None, []]):
        assert (got[k] if got[k] is None else [(d.label, d.phrase, str(d.date), d.time, d.vacated) for d in got[k]]) == want
    assert got[1][0].snippet == "Jury Trial set for 8/20/2026, is hereby VACATED and continued to 8/24/2026." and got[0][1].printed == "2/8/2027"


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).round(1)
    x[200:230] = x[0]  # many equal rows
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(300), x, strict=True)]
    df = spark.createDataFrame([*rows, (900, None), (None, [1.0] * 5)], "id long, v array<float>")
    monkeypatch.setattr(search, "ROW_BLOCK", 40)
    got = sorted(tuple(r) for r in search.nearest(df, df.filter("id % 7 = 0"), "id", "v", 4, 11).select("query", "place", "id", "score").collect())
    unit = {i: np.float32(r).astype(float) / np.linalg.norm(np.float32(r).astype(float)) for i, r in rows}
    want = []
    for q in (i for i in unit if i % 7 == 0):
        near = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q)[:4]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, sorted(want), strict=True))
    assert search.nearest(df, df.limit(0), "id", "v", 4).count() == 0
