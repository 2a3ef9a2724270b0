"""Broken records over many splits, spelling tries, survey shares and aligned series against plain readings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tabulon.operators import aggregates, citations, series
from tabulon.sources import files


def in_order(text, tabs, at):
    """The rule, line after line: (kind, cells)."""
    out, held = [], None
    for line in text.split("\r\n"):
        n = line.count("\t")
        if held is None:
            if n == tabs:
                out.append(("whole", line.split("\t")))
            elif n > tabs:
                f = line.split("\t")
                out.append(("merged", f[:at] + ["\t".join(f[at : len(f) - (tabs - at)])] + f[len(f) - (tabs - at) :]))
            elif line:
                held = line
        elif n == tabs:
            out.append(("fragment", []))
            held = None
        else:
            held += line
            if held.count("\t") == tabs:
                out.append(("rejoined", held.split("\t")))
                held = None
            elif held.count("\t") > tabs:
                out.append(("fragment", []))
                held = None
    return out + ([("fragment", [])] if held is not None else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_records_broken_at_split_bounds(spark, tmp_path, seed):
    dice = random.Random(seed)
    lines = [dice.choice(["1\tsome text\t3\t4", "2\ta\ttab\t3\t4", "3\tstart of", " more text", "\t3\t4", "", "x\ty", "4\tlf\nin it\t3\t4", "é\t\t", "5\t" + "long " * 40 + "\t3\t4"]) for _ in range(4000)]
    path = str(tmp_path / "t.tsv")
    with open(path, "wb") as f:
        f.write("\r\n".join(["id\ttext\tc\td", *lines]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4096", "100000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows, counts = files.read_repaired_tsv(spark, path, ["id", "text", "c", "d"], "text", header=True)
            want = in_order("\r\n".join(lines), 3, 1)
            assert sorted(tuple(r) for r in rows.collect()) == sorted(tuple(c) for k, c in want if k != "fragment")
            assert {r.kind: r.n for r in counts.collect()} == {k: sum(x == k for x, _ in want) for k in {x for x, _ in want}}
        assert spark.read.text(path).rdd.getNumPartitions() < 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_trie_finds_what_a_plain_alternation_finds():
    dice = random.Random(3)
    for _ in range(300):
        bank = ["".join(dice.choices(["F.", "S.", "Supp.", " ", "2d", "3d", "a", "b", "App'x", "W. Va."], k=dice.randint(1, 4))).strip() or "F." for _ in range(dice.randint(1, 12))]
        plain = [re.compile("".join(citations.letters_of(s))) for s in bank]
        trie = re.compile(citations.trie_pattern(bank))
        for _ in range(30):
            text = "".join(dice.choices(["F.", "S.", "Supp.", " ", "2d", "3d", "a", "b", "App’x", "W.", "Va."], k=dice.randint(0, 6)))
            longest = max((m.end() for p in plain if (m := p.match(text))), default=-1)
            got = trie.match(text)
            assert (got.end() if got else -1) == longest, (bank, text)


def test_texts_without_an_anchor_are_skipped_and_hold_no_citation(spark):
    texts = ["No digit at all in U.S.C. or F. Supp.", "M.D.L. No. and Pub. L.", "Id. and U.S. Const. art. II", "28 U.S.C. § 5", "٣ F.3d ١٢", None, ""]
    got = citations.located(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t").collect()
    assert sorted((r.id, r.start, r.end) for r in got) == sorted((k, a, z) for k, t in enumerate(texts) for _, _, a, z in citations.citations_in(t or "")) and {r.id for r in got} == {2, 3, 4}


def test_survey_share_by_residuals(spark):
    dice = random.Random(6)
    rows = [(dice.choice("ab"), dice.randint(0, 3), dice.randint(0, 6), dice.choice([1.5, 2.0, 7.25]), dice.choice([True, False, None])) for _ in range(400)] + [("c", 9, 1, 2.0, True), ("d", 0, 1, 0.0, True)]
    df = spark.createDataFrame(rows, "dom string, st long, psu long, w double, hit boolean")
    got = {r.dom: r for r in aggregates.survey_ratio(df, ["dom"], "st", "psu", "w", F.col("hit")).collect()}
    units = {s: {(r[1], r[2]) for r in rows if r[1] == s} for s in {r[1] for r in rows}}
    for dom in "ab":
        own = [r for r in rows if r[0] == dom]
        x, y = sum(r[3] for r in own), sum(r[3] for r in own if r[4])
        var = rvar = 0.0
        for held in units.values():
            m = len(held)
            t = [sum(r[3] for r in own if (r[1], r[2]) == u) for u in held]
            z = [sum(r[3] * ((1 if r[4] else 0) - y / x) for r in own if (r[1], r[2]) == u) for u in held]
            if m > 1:
                var += m / (m - 1) * sum((v - sum(t) / m) ** 2 for v in t)
                rvar += m / (m - 1) * sum((v - sum(z) / m) ** 2 for v in z)
        r = got[dom]
        assert (r.n, r.total, r.part) == (len(own), pytest.approx(x), pytest.approx(y))
        assert (r.share, r.variance, r.share_variance) == (pytest.approx(y / x), pytest.approx(var), pytest.approx(rvar / x**2))
    assert got["c"].share == 1 and got["c"].share_variance == 0 and got["d"].share is None


def test_aligned_series(spark):
    def points(i, kind, values, partial=()):
        return [(i, int(i[1:]), kind, x, v, x in partial) for x, v in values.items()]

    p = points("s1", "year", {2000: 5.0, 2001: None, 2002: 7.0, 2003: 8.0, 2004: 9.0, 2006: 1.0}) + points("s2", "year", {1999: 1.0, 2000: 2.0, 2002: 0.0, 2003: 4.0, 2004: 5.0, 2005: 6.0}, {2005}) + points("s3", "fiscal", {2000: 1.0, 2001: 1.0}) + points("s4", "year", {2003: 3.0, 2004: 2.0})
    df = spark.createDataFrame(p, "id string, nth long, kind string, x long, value double, partial boolean")
    none = spark.createDataFrame([], "id string, x long")
    rows, fates = series.aligned(df, none)
    got = {(r.id, r.x): (r.value, r.common) for r in rows.collect()}
    assert {r.id: r.fate for r in fates.collect()} == {"s1": "used", "s2": "used", "s3": "left out", "s4": "used"}
    assert {x for _, x in got} == {2000, 2001, 2002, 2003, 2004} and len(got) == 15  # 2005 is unfinished, 2006 has one series
    assert got["s1", 2001] == (None, False) and got["s4", 2000] == (None, False) and got["s2", 2003] == (4.0, True) and {x for (_, x), v in got.items() if v[1]} == {2003}
    cut = series.aligned(df, spark.createDataFrame([("s1", 2001), ("s1", 2003), ("s2", 1990)], "id string, x long"))[0].collect()
    assert cut == [] or {r.x for r in cut} == {2003, 2004}
    assert series.aligned(df.filter("id in ('s1', 's3')"), none)[0].count() == 0
    assert series.aligned(df.limit(0), none)[0].count() == 0
