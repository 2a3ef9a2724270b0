"""Claims by several at once, and clean-ups that are checked and taken back."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tabulon.sources import scratch
from tabulon.streaming import cdc


def test_only_one_of_many_puts_a_file(spark, tmp_path):
    path = str(tmp_path / "once")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: scratch.put_if_absent(spark, path, f"writer {k}"), range(16)))
    assert sum(won) == 1 and scratch.text_of(spark, path) == f"writer {won.index(True)}"
    assert scratch.children(spark, str(tmp_path)) == ["once"]


def test_claims_at_once_hold_every_item_once(spark, tmp_path):
    items = spark.range(60).select("id", (F.col("id") % 7).alias("age")).cache()
    queue = cdc.WorkQueue(spark, str(tmp_path / "q"))
    with ThreadPoolExecutor(4) as pool:
        claims = list(pool.map(lambda k: [r.id for r in queue.claim(items, "id", ["age"], f"w{k}", "2026-01-01 00:00:00", 30, 10).collect()], range(4)))
    taken = [i for c in claims for i in c]
    assert len(taken) == len(set(taken)) == 40
    assert set(taken) == set(sorted(range(60), key=lambda i: (i % 7, i))[:40])
    assert len(scratch.children(spark, str(tmp_path / "q" / "rounds"))) == 4 == len(scratch.children(spark, str(tmp_path / "q" / "rows")))
    queue.finish(spark.createDataFrame([(i,) for i in claims[0]], "id long"), "w0")
    again = {r.id for r in queue.claim(items, "id", ["age"], "late", "2026-01-01 01:00:00", 30, 100).collect()}
    assert again == set(range(60)) - set(claims[0])  # leases have run out; what is done stays done


def test_cleanup_restores_only_what_is_untouched(spark, tmp_path):
    rows = [(k, "p" if k < 10 else "f" if k < 20 else "o", float(k), None if k % 4 else "x") for k in range(30)]
    df = spark.createDataFrame(rows, "id long, kind string, price double, note string")
    run = cdc.Cleanup(spark, str(tmp_path / "c"), "id")
    assert run.plan(df, "a", F.col("kind") == "p", "why").count() == 10
    run.plan(df, "b", F.col("kind") == "f", "why", {"note": F.lit("new")})
    moved = df.withColumn("price", F.when(F.col("id") == 3, -1.0).otherwise(F.col("price"))).filter("id <> 4")
    one = run.apply(moved, "a")
    assert {r.id for r in one.collect()} == {3, *range(10, 30)}
    assert tuple(run.verify(moved, one, "a").first()) == (10, 8, 0, 2, True)
    assert not run.verify(moved, one.filter("id <> 25"), "a").first().complete
    assert not run.verify(moved, one.withColumn("price", F.col("price") + 1), "a").first().complete
    two = run.apply(one, "b")
    assert {r.id for r in two.filter("note = 'new'").collect()} == set(range(10, 20))
    assert tuple(run.verify(one, two, "b").first()) == (10, 0, 10, 0, True)
    with pytest.raises(ValueError):
        run.apply(two, "b")
    later = two.filter("id <> 12").withColumn("price", F.when(F.col("id") == 15, 99.0).otherwise(F.col("price"))).unionByName(spark.createDataFrame([(7, "q", 7.5, "back")], df.schema))
    back = {r.id: tuple(r) for r in run.rollback(run.rollback(later, "b"), "a").collect()}
    want = {r[0]: r for r in rows}
    assert 12 not in back and 4 not in back  # removed by others
    assert back[15] == (15, "f", 99.0, "new") and back[7] == (7, "q", 7.5, "back") and back[3] == (3, "p", -1.0, None)
    assert all(back[k] == want[k] for k in back if k not in (15, 7, 3))
