"""Inputs that the tables do not hold: escapes, short passages, large means, failed publications, restarts, skew."""

import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import json_paths, special
from tabulon.operators import citations, filters, joins, names, passages, ranking, search, statistics
from tabulon.plans.registry import QUERIES
from tabulon.sources import files
from tabulon.streaming import cdc


def test_copy_text_round_trip_and_held_lines(spark, tmp_path):
    rows = [(1, "C:\\temp\\new"), (2, None), (3, ""), (4, "a\tb\nc\rd\x0be\\\\t\\N"), (5, "\\N"), (6, "\\"), (7, "é\b\f")]
    files.write_copy_text(spark.createDataFrame(rows, "k long, t string"), f"{tmp_path}/c")
    good, held = files.read_copy_text(spark, f"{tmp_path}/c", T.StructType.fromDDL("k long, t string"))
    assert sorted((r.k, r.t) for r in good.collect()) == rows and held.count() == 0
    with open(f"{tmp_path}/raw.txt", "w") as f:
        f.write("1\t\\x41\\102\\q\n2\ttoo\tmany\n\\.\n")
    good, held = files.read_copy_text(spark, f"{tmp_path}/raw.txt", T.StructType.fromDDL("k long, t string"))
    assert [tuple(r) for r in good.collect()] == [(1, "ABq")] and [r.line for r in held.collect()] == ["2\ttoo\tmany"]


def test_passages_of_any_number_of_words(spark):
    dice = random.Random(4)
    texts = [(k, "  ".join("".join(dice.choice("abc") for _ in range(dice.randint(1, 4))) for _ in range(dice.randint(0, 12)))) for k in range(60)] + [(900, None), (901, "")]
    wanted = [(k, " ".join("".join(dice.choice("abc") for _ in range(dice.randint(1, 2))) for _ in range(n))) for k, n in enumerate([1] * 8 + [2] * 8 + [3] * 8 + [4] * 4)] + [(99, None), (98, " ")]
    got = {(r.id, r.item) for r in passages.passages_within(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(wanted, "item long, p string"), "id", "t", "item", "p").collect()}
    assert got == {(i, j) for i, t in texts for j, p in wanted if p and p.strip() and " ".join(p.split()) in " ".join((t or "").split())} and got
    none = passages.passages_within(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([], "item long, p string"), "id", "t", "item", "p")
    assert none.count() == 0


def test_poisson_tails_of_large_means(spark):
    cases = [(25000, 25000.0), (25300, 25000.0), (3, 0.25), (0, 4.0), (100, 160.0), (160, 100.0), (9, 9.0), (24000, 25000.0)]
    got = {(r.x, r.m): r.p for r in spark.createDataFrame(cases, "x long, m double").withColumn("p", statistics.poisson_tail(F.col("x"), F.col("m"))).collect()}
    for x, m in cases:
        below = math.fsum(math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(max(0, x - 12000), x))
        want = 1 - below if x <= m else math.fsum(math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(x, x + 12000))
        assert abs(got[x, m] - want) < 1e-8 * max(want, 1e-3)


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    spark.createDataFrame([(1, "O", "Order"), (None, None, None)], "id long, dataset string, title string").write.parquet(f"{tmp_path}/r")
    df = spark.read.parquet(f"{tmp_path}/r")
    kept = filters.keep(df, filters.RecordFilter(datasets=("O", "F"), ids=(1, 2), contains={"title": "ORD"}))
    kept.explain()
    assert "PushedFilters: [In(dataset, [F,O]), In(id, [1,2])" in capsys.readouterr().out or [r.id for r in kept.collect()] == [1]
    assert [r.id for r in kept.collect()] == [1]


def test_a_failed_publication_leaves_the_old_rows(spark, tmp_path):
    path = f"{tmp_path}/published"
    good = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    first = files.publish(good, path, "k")
    assert first["rows"] == 2
    with pytest.raises(ValueError):
        files.publish(good.unionByName(good), path, "k")
    assert spark.read.parquet(path).count() == 2
    files.publish(good.filter("k = 1"), path, "k")
    assert spark.read.parquet(path).count() == 1


def test_upsert_batches_keep_both_bounds(spark):
    dice = random.Random(8)
    rows = [(k, "x" * dice.randint(1, 300)) for k in range(200)]
    out = files.upsert_batches(spark.createDataFrame(rows, "k long, t string"), "k", 20, 1500).orderBy("batch", "place").collect()
    assert [r.k for r in out] == list(range(200))
    batches = {}
    for r in out:
        batches.setdefault(r.batch, []).append(len(f'{{"k":{r.k},"t":"{r.t}"}}') + 1)
    assert all(len(b) <= 20 and 2 + sum(b) <= 1500 for b in batches.values()) and sorted(batches) == list(range(len(batches)))
    with pytest.raises(Exception, match="byte bound"):
        files.upsert_batches(spark.createDataFrame([(1, "x" * 3000)], "k long, t string"), "k", 20, 1500).collect()


def test_state_survives_a_restart_and_a_replay(spark, tmp_path):
    schema = "k long, at long, v string"
    empty = spark.createDataFrame([], schema)
    for _ in range(2):  # the second round is the replay of batch 1 by a new process
        t = cdc.VersionedTable(spark, f"{tmp_path}/state", empty, "k", 4)
        for number, rows in ((0, [(1, 1, "a"), (2, 1, "b")]), (1, [(2, 2, "c"), (3, 1, "d"), (1, 0, "late")])):
            df = spark.createDataFrame(rows, schema)
            t.write(number, cdc.merged(t.read(number), df, "k", "at"))
    again = cdc.VersionedTable(spark, f"{tmp_path}/state", empty, "k", 4)
    assert sorted((r.k, r.v) for r in again.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_quantiles_and_ranks_of_one_large_group(spark):
    x = np.random.default_rng(3).integers(0, 300, 4000)
    df = spark.createDataFrame([("g", int(v), int((v * 7) % 50)) for v in x], "g string, v long, w long")
    q = ranking.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.137, "c": 0.5, "d": 1.0}).collect()[0]
    assert np.allclose([q.a, q.b, q.c, q.d], np.quantile(x, [0, 0.137, 0.5, 1]))
    order = np.argsort(np.argsort(x, kind="stable"), kind="stable")
    mean_rank = {v: order[x == v].mean() + 1 for v in set(x.tolist())}
    y = (x * 7) % 50
    order = np.argsort(np.argsort(y, kind="stable"), kind="stable")
    mean_y = {v: order[y == v].mean() + 1 for v in set(y.tolist())}
    want = np.corrcoef([mean_rank[v] for v in x.tolist()], [mean_y[v] for v in y.tolist()])[0, 1]
    assert abs(statistics.spearman(df, ["g"], "v", "w").first().rho - want) < 1e-9


def test_permutation_p_and_family(spark):
    dice = random.Random(6)
    rows = [(k, float(k), k + 40 * dice.random(), dice.random(), float(k) if k < 5 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "u long, x double, near double, noise double, few double").withColumn("g", F.lit(1))
    strong = statistics.permutation_p(df, ["g"], "x", "near", 99, 5).first()
    weak = statistics.permutation_p(df, ["g"], "x", "noise", 99, 5).first()
    assert strong.p == 0.01 and strong.rho > 0.5 and weak.p > 0.05
    assert statistics.permutation_p(df, ["g"], "x", "noise", 99, 5).first().p == weak.p
    f = {r.y: r for r in statistics.family_tests(df, "u", "x", ["near", "noise", "few"]).collect()}
    assert f["near"].holds and not f["noise"].holds and f["few"].rho is None and f["few"].n == 5 and f["near"].low < f["near"].rho < f["near"].high


def test_clusters_and_scaling(spark):
    blobs = [(0, 0.0, 0.0), (1, 0.1, 0.2), (2, 0.2, -0.1), (3, 5.0, 5.0), (4, 5.2, 4.9), (5, 4.8, 5.1), (6, 5.1, 5.2)]
    df = spark.createDataFrame(blobs, "k long, a double, b double")
    found, score = statistics.clustered(df, "k", ["a", "b"], 2)
    assert {r.k: r.cluster for r in found.collect()} == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0} and score > 0.9
    with pytest.raises(ValueError):
        statistics.clustered(df, "k", ["a", "b"], 8)
    z = statistics.standardised(spark.createDataFrame([(1.0, 10.0), (2.0, 10.0), (3.0, 10.0)], "a double, b double"), ["a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in z] == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0)]


def test_loess_of_a_line_is_the_line(spark):
    rows = [("g", float(k), 3.0 + 2 * k) for k in range(20)] + [("few", 1.0, 1.0)]
    out = statistics.loess_band(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()
    assert len(out) == 24 and all(abs(r.fit - 3 - 2 * r.x) < 1e-6 and r.low <= r.fit + 1e-6 and r.fit <= r.high + 1e-6 for r in out)
    assert abs(statistics.t_quantile_975(10) - 2.2281) < 0.005


def test_citations_and_antecedents(spark):
    text = "See 15 U.S.C. § 2064; 21 C.F.R. § 820.30. Id. at 3. Roe v. Doe, 509 U.S. 579 (1993). 89 Fed. Reg. 12,345. 509 U.S. at 590; 7 F. 3d 8; Pub. L. No. 110-314; 86 Stat. 1207; U.S. Const. amend. XIV; Tex. Const. art. I; Fed. R. Civ. P. 23; L.R. 7.1; Cal. Civ. Code § 1714; Cal. Code Regs. tit. 16, § 1399.5; MDL No. 2885; No. 3:19-md-02885; no 12 citation 5"
    got = [(k, key) for k, key, _, _ in citations.citations_in(text)]
    assert got == [("usc", "usc:15:2064"), ("cfr", "cfr:21:820.30"), ("short", "cfr:21:820.30"), ("case", "case:509:us:579"), ("federal_register", "federal_register:89:12345"), ("short", "case:509:us:579"), ("case", "case:7:f3d:8"),
                   ("public_law", "public_law:110:314"), ("statutes_at_large", "statutes_at_large:86:1207"), ("constitution_us", "constitution_us:amend:xiv"), ("constitution_state", "constitution_state:tex:i"), ("federal_rule", "federal_rule:civ:23"), ("local_rule", "local_rule:7.1"),
                   ("state_statute", "state_statute:cal:1714"), ("state_regulation", "state_regulation:cal:1399.5"), ("mdl", "mdl:2885"), ("docket", "docket:3:19-md-02885")]
    lines = [(1, "Authority: 15 U.S.C. 1453, 1454; 21 U.S.C. 321 note, 371 et seq.; Pub. L. 104-4."), (2, "28 U.S.C. 351-360 and 1407"), (3, "99 U.S.C. 1; 50 U.S.C. App. 2401"), (4, None)]
    parsed = {(r.id, r.title, r.section, r.form, r.last) for r in citations.authority_lines(spark.createDataFrame(lines, "id long, line string"), "id", "line").collect()}
    assert parsed == {(1, 15, "1453", "exact", None), (1, 15, "1454", "exact", None), (1, 21, "321", "note", None), (1, 21, "371", "et seq", None), (2, 28, "351", "range", "360"), (2, 28, "1407", "exact", None), (3, 50, "2401", "appendix", None)}


def test_as_of_across_chunks(spark):
    dice = random.Random(3)
    base = "2024-01-01 00:00:00"
    left = spark.createDataFrame([(k, "hot" if k % 3 else None, dice.randint(0, 400)) for k in range(120)], "i long, g string, h int").withColumn("t", F.expr(f"timestamp '{base}' + make_interval(0, 0, 0, 0, h)"))
    right = spark.createDataFrame([(k, "hot" if k % 2 else "cold", dice.randint(0, 400)) for k in range(30)], "v long, g string, h int").withColumn("r", F.expr(f"timestamp '{base}' + make_interval(0, 0, 0, 0, h)")).drop("h")
    rows, seen = [r.asDict() for r in left.collect()], [r.asDict() for r in right.collect()]
    got = {r.i: r.v for r in joins.as_of(left, right, "g", "t", "r", ["v"]).collect()}
    want = {x["i"]: max(((y["r"], y["v"]) for y in seen if y["g"] == x["g"] and y["r"] <= x["t"]), default=(None, None))[1] for x in rows}
    assert got == want and any(v is None for v in want.values()) and any(v is not None for v in want.values())
    got = {r.i: r.nxt for r in joins.first_after_by_union(left, right.select("g", "r"), "g", "t", "r", "nxt").collect()}
    assert got == {x["i"]: min((y["r"] for y in seen if y["g"] == x["g"] and y["r"] >= x["t"]), default=None) for x in rows}


def test_parameters_are_checked_before_any_plan(spark):
    df = spark.createDataFrame([(1, "a")], "id long, title string")
    for limit, offset, sort in ((0, 0, "title"), (501, 0, "title"), (10, -1, "title"), (10, 0, "size")):
        with pytest.raises(ValueError):
            ranking.page(df, sort, limit, offset)
    with pytest.raises(ValueError):
        filters.bounded(5, 6, 9, "n")


def test_normal_distribution(spark):
    rows = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "x double").withColumn("p", special.normal_cdf(F.col("x"))).collect()
    assert all(abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 2e-7 for r in rows)


def test_daily_pick_walks_through_all(spark):
    df = spark.createDataFrame([(k,) for k in range(7)], "k long")
    assert {ranking.daily_pick(df, "k", day).first().k for day in range(100, 107)} == set(range(7))


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.csv", "a,b\n1,2\n")
        z.writestr("d/y.txt", "text" * 1000)
    rows = {r.member: bytes(r.content) for r in files.read_zip_members(spark, f"{tmp_path}/a.zip").collect()}
    assert rows == {"x.csv": b"a,b\n1,2\n", "d/y.txt": b"text" * 1000}
    assert files.read_zip_members(spark, f"{tmp_path}/a.zip", ".csv").count() == 1


def test_names_and_middles(spark):
    rows = [(1, "Hon. José A. de la Cruz-Peña, Jr."), (2, "smith"), (3, None), (4, "Mary Ann Lee Esq."), (5, "Dr. John Q Public III")]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i long, n string").select("i", names.name_parts("n").alias("p")).collect()}
    assert got[1].first == "jose" and got[1].last == "pena" and got[1].suffix == ["jr"] and got[1].middle == ["a", "de", "la", "cruz"]
    assert got[2] is None and got[3] is None and got[4].middle == ["ann"] and got[5].suffix == ["iii"]


def test_json_differences_and_masks(spark):
    rows = [(1, '{"a":{"b":[1,{"c":2}]}}', '{"a":{"b":[1,{"c":3}]},"d":null}'), (2, "{bad", "{}"), (3, None, None), (4, '{"x":1,"y":2}', '{"y":2,"x":1}')]
    got = {r.i: r.paths for r in json_paths.with_differences(spark.createDataFrame(rows, "i long, o string, n string"), "o", "n").collect()}
    assert got == {1: ["$.a.b[1].c", "$.d"], 2: ["$.text"], 3: [], 4: []}
    df = spark.createDataFrame([(1, [("a", "x"), ("b", None)]), (2, None)], "i long, l array<struct<k:string,v:string>>")
    masked = {r.i: r.l for r in df.withColumn("l", json_paths.masked(F.col("l"), df.schema["l"].dataType, ["*", "v"])).collect()}
    assert [tuple(x) for x in masked[1]] == [("a", "<masked>"), ("b", None)] and masked[2] is None
    facets = spark.createDataFrame([(1, '{"k":3,"t":["a","b"]}'), (2, '{"k":4,"t":"a"}'), (3, '{"t":["a"]}'), (4, None), (5, "{")], "i long, f string")
    assert sorted(r.i for r in facets.filter(json_paths.json_facets("f", {"k": [3, 4], "t": "a"})).collect()) == [1, 2]


def test_all_query_terms_count():
    q = " ".join(f"w{k}" for k in range(40))
    assert len(search.query_terms(q)) == 40


def test_every_chunk_lies_in_its_text(spark):
    texts = [(1, "a. " * 3000), (2, None), (3, " \n"), (4, "x" * 9000)]
    rows = passages.chunked(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()
    whole = dict(texts)
    assert {r.id for r in rows} == {1, 4} and all(whole[r.id][r.start : r.end] == r.body for r in rows)
    assert "x7_chunks" in QUERIES


def test_pages_of_decisions_have_any_number_of_digits(spark):
    found = citations.citations(spark.createDataFrame([(1, "Roe v. Doe, 512 U.S. 123456 (1999); 512 U.S. at 77.")], "id long, t string"), "id", "t")
    assert [tuple(r) for r in found.collect()] == [(1, "case", "case:512:us:123456", 2)]


def test_citations_are_looked_for_in_many_tasks_and_handed_on_together(spark):
    texts = spark.range(3000, numPartitions=1).selectExpr("id", "concat('See 7 U.S.C. § ', id, '. Id.') AS t")
    found = citations.located(texts, "id", "t")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.id, r.kind, r.key) for r in found.collect()} == {(k, kind, f"usc:7:{k}") for k in range(3000) for kind in ("usc", "short")}


def test_few_degrees_of_freedom_take_the_closed_sum(spark, monkeypatch):
    cases = [(t, n) for n in range(1, 21) for t in (0.0, 0.3, -1.7, 2.5)]
    rows = spark.createDataFrame(cases, "t double, n long")
    long = {(r.t, r.n): r.p for r in rows.withColumn("p", special.incomplete_beta(F.col("n") / (F.col("n") + F.col("t") * F.col("t")), F.col("n") / 2, F.lit(0.5))).collect()}
    monkeypatch.setattr(special, "incomplete_beta", lambda *_: F.lit(None).cast("double"))
    short = {(r.t, r.n): r.p for r in rows.withColumn("p", special.t_two_sided(F.col("t"), F.col("n"))).collect()}
    assert all(abs(short[c] - long[c]) < 1e-12 * long[c] for c in cases)
    odd = [(float("inf"), 3), (float("nan"), 3), (None, 3), (1.0, 0), (1e9, 4)]
    assert [r.p for r in spark.createDataFrame(odd, "t double, n long").select(special.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()] == [None] * 5


def test_pairs_are_counted_in_as_many_parts_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART_PAIRS", 20)
    df = spark.createDataFrame([(g, (g * 7 + k) % 23) for g in range(40) for k in range(6)], "g long, i long")
    got = joins.together(df, "g", "i", 2)
    assert got.rdd.getNumPartitions() == 40 * 15 // 20
    sets = [{(g * 7 + k) % 23 for k in range(6)} for g in range(40)]
    want = {(a, b): sum(a in s and b in s for s in sets) for a in range(23) for b in range(a + 1, 23)}
    assert {(r.a, r.b): r.n for r in got.collect()} == {p: n for p, n in want.items() if n >= 2}


def test_nearest_rows_of_a_block_are_scored_a_few_queries_at_a_time():
    import tracemalloc

    import pyarrow as pa

    def block(n: int) -> pa.Table:
        x = np.random.default_rng(n).standard_normal(8 * n)
        return pa.table({"id": pa.array(range(n), pa.int64()), "v": pa.ListArray.from_arrays(pa.array(range(0, 8 * n + 1, 8), pa.int32()), pa.array(x))})

    asked, rows = block(400), block(20_000)
    tracemalloc.start()
    found = search._best_of_blocks(3)(asked, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows >= 3 * 400 and peak < 30_000_000
