"""Window, analytic and time-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.functions.dates import exact_anniversary, fiscal_year, month_index, whole_months_between
from tabulon.operators import intervals, series
from tabulon.plans.registry import register
from tabulon.sources.tables import table


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, month, v): orders of each priority and month."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("month")).agg(F.count("*").alias("v"))


_M = "m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS v FROM orders GROUP BY 1, 2)"
_Y = "y AS (SELECT o_custkey % 40 AS k, year(o_orderdate)::INT AS y, count(*) AS v FROM orders GROUP BY 1, 2)"


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("k"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("v"))


@register("w1_survivor", "SELECT text, doc_id, n FROM (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS r, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE r = 1 AND n > 1")
def w1_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best and number are aggregated by a digest, so copies of one text never meet in one task; the text is joined back."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    best = F.min(F.struct(F.coalesce(-F.col("n_chars"), F.lit(1)).alias("o"), "doc_id")).alias("b")
    g = d.groupBy(F.sha2("text", 256).alias("h")).agg(best, F.count("*").alias("n")).filter("n > 1").select(F.col("b.doc_id").alias("doc_id"), "n")
    return d.join(g, "doc_id").select("text", "doc_id", "n")


@register("w3_dense_dates", "SELECT DISTINCT o_custkey % 100 AS g, o_orderdate::DATE AS d, dense_rank() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderdate::DATE) - 1 AS i FROM orders", dates=("d",))
def w3_dense_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("g"), F.to_date("o_orderdate").alias("d")).distinct()
    return o.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("d")) - 1)


@register("w4_adjacent", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def w4_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("b", before).filter(~F.col("event_type").eqNullSafe(F.col("b"))).select("event_id")


@register("w5_rank_z", "WITH s AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT k, rank() OVER (ORDER BY v DESC) AS place, round((v - avg(v) OVER ()) / stddev_pop(v) OVER (), 6) AS z, abs((v - avg(v) OVER ()) / stddev_pop(v) OVER ()) > 2 AS outlier FROM s")
def w5_rank_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("v"))
    facts = s.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))  # one row
    z = (F.col("v") - F.col("m")) / F.col("sd")
    return s.crossJoin(F.broadcast(facts)).select("k", F.rank().over(Window.orderBy(F.desc("v"))).alias("place"), F.round(z, 6).alias("z"), (F.abs(z) > 2).alias("outlier"))


@register("w6_consecutive", f"WITH {_M}, p AS (SELECT *, dense_rank() OVER (ORDER BY month) AS seq FROM m WHERE v > 20) SELECT a.k, a.month, a.v - b.v AS delta FROM p a JOIN p b ON a.k = b.k AND a.seq = b.seq + 1", dates=("month",))
def w6_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between neighbouring reports, for units that both list."""
    m = _monthly(spark, sf_dir).filter("v > 20")
    seq = m.select("month").distinct().withColumn("seq", F.row_number().over(Window.orderBy("month")))  # one row per report
    p = m.join(seq, "month")
    b = p.select("k", (F.col("seq") + 1).alias("seq"), F.col("v").alias("b"))
    return p.join(b, ["k", "seq"]).select("k", "month", (F.col("v") - F.col("b")).alias("delta"))


@register("w7_lag_change", f"WITH {_M} SELECT a.k, a.month, a.v, b.v AS before, a.v - b.v AS change, CASE WHEN b.v > 0 THEN round(100.0 * (a.v - b.v) / b.v, 6) END AS pct FROM m a LEFT JOIN m b ON a.k = b.k AND b.month = a.month - INTERVAL 12 MONTH", dates=("month",))
def w7_lag_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.lag_change(_monthly(spark, sf_dir), ["k"], "month", "v", 12).withColumn("pct", F.round("pct", 6))


@register("w8_runs", "WITH t AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM t GROUP BY user_id, event_type, g HAVING count(*) >= 3")
def w8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").filter("length >= 3")


@register("w9_peak", f"WITH {_M} SELECT k, v AS value, month AS at FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, month) AS r FROM m) WHERE r = 1", dates=("at",))
def w9_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).groupBy("k").agg(series.peak("v", "month").alias("p")).select("k", F.col("p.value").alias("value"), F.col("p.at").alias("at"))


@register("w10_series_window", f"""WITH {_M}, e AS (SELECT k, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM m GROUP BY 1), s AS (SELECT e.k, min(e.month) AS a, list(coalesce(v, 0) ORDER BY e.month) AS vals FROM e LEFT JOIN m ON m.k = e.k AND m.month = e.month GROUP BY 1)
    SELECT k, list_sum(vals[n - 11 : n])::BIGINT AS recent, list_sum(vals[n - 23 : n - 12])::BIGINT AS before, md5(array_to_string(list_transform(vals, lambda x: x::VARCHAR), ',')) AS digest
    FROM (SELECT *, (year(DATE '1999-06-01') - year(a)) * 12 + month(DATE '1999-06-01') - month(a) + 1 AS n FROM s)""")
def w10_series_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = series.densified(_monthly(spark, sf_dir), ["k"], "month", "v", 0)
    s = dense.groupBy("k").agg(F.min("month").alias("a"), F.transform(F.sort_array(F.collect_list(F.struct("month", "v"))), lambda x: x["v"]).alias("vals"))
    recent, before = series.recent_and_before("vals", F.col("a"), F.lit("1999-06-01").cast("date"), 12)
    return s.select("k", recent.alias("recent"), before.alias("before"), F.md5(F.array_join(F.transform("vals", lambda x: x.cast("string")), ",")).alias("digest"))


@register("w11_unit_windows", """SELECT p_brand, count(*) FILTER (m > 23985 - 12) AS recent, count(*) FILTER (m <= 23985 - 12) AS baseline, count(*) FILTER (m > 23985 - 12 AND l_returnflag = 'R') AS recent_severe FROM
    (SELECT p_brand, l_returnflag, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE m > 23985 - 24 AND m <= 23985 GROUP BY 1""")
def w11_unit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = 1998 * 12 + 9  # October 1998
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "l_returnflag", month_index("l_shipdate").alias("m"))
    now = F.col("m") > end - 12
    return l.filter(F.col("m").between(end - 23, end)).groupBy("p_brand").agg(F.count_if(now).alias("recent"), F.count_if(~now).alias("baseline"), F.count_if(now & (F.col("l_returnflag") == "R")).alias("recent_severe"))


@register("w14_rising", f"WITH {_Y} SELECT k, sum(v) FILTER (y > 1998)::BIGINT AS recent, sum(v) FILTER (y <= 1998)::BIGINT AS prior, round(sum(v) FILTER (y > 1998) / sum(v) FILTER (y <= 1998), 6) AS ratio FROM y WHERE y BETWEEN 1997 AND 2000 GROUP BY 1 HAVING count(v) = 4")
def w14_rising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.rising(_yearly(spark, sf_dir), ["k"], "y", "v", F.lit(2000), 2).withColumn("ratio", F.round("ratio", 6))


@register("w15_event_window", """WITH e AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT e.user_id, count(*) FILTER (v.ts < t) AS before, count(*) FILTER (v.ts >= t) AS after FROM e JOIN events v ON v.user_id = e.user_id AND v.ts >= t - INTERVAL 3 DAY AND v.ts < t + INTERVAL 3 DAY GROUP BY 1""")
def w15_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events")
    e = v.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("t"))
    near = v.join(e, "user_id").filter("ts >= t - INTERVAL 3 DAYS AND ts < t + INTERVAL 3 DAYS")
    return near.groupBy("user_id").agg(F.count_if(F.col("ts") < F.col("t")).alias("before"), F.count_if(F.col("ts") >= F.col("t")).alias("after"))


@register("w16_buckets", "SELECT event_type AS k, date_trunc('week', d)::DATE AS bucket, CASE WHEN count(v) = count(*) THEN sum(v)::BIGINT END AS value, count(*) AS days FROM (SELECT event_type, ts::DATE AS d, CASE WHEN count(*) % 7 > 0 THEN count(*) END AS v FROM events GROUP BY 1, 2) GROUP BY 1, 2", dates=("bucket",))
def w16_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("k"), F.to_date("ts").alias("d")).agg(F.when(F.count("*") % 7 > 0, F.count("*")).alias("v"))
    return series.complete_buckets(d, ["k"], "d", "v", "week")


@register("w17_periods", "SELECT event_type, count(*) FILTER (d > DATE '2024-01-20') AS now, count(*) FILTER (d <= DATE '2024-01-20') AS before FROM (SELECT event_type, ts::DATE AS d FROM events) WHERE d > DATE '2024-01-10' AND d <= DATE '2024-01-30' GROUP BY 1")
def w17_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("ts")
    cut, first, last = (F.lit(x).cast("date") for x in ("2024-01-20", "2024-01-10", "2024-01-30"))
    return table(spark, sf_dir, "events").filter((d > first) & (d <= last)).groupBy("event_type").agg(F.count_if(d > cut).alias("now"), F.count_if(d <= cut).alias("before"))


@register("w18_densify", f"WITH {_M}, f AS (SELECT k, month, v FROM m WHERE v > 25), s AS (SELECT k, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM f GROUP BY k) SELECT s.k, s.month, f.v FROM s LEFT JOIN f ON f.k = s.k AND f.month = s.month", dates=("month",))
def w18_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.densified(_monthly(spark, sf_dir).filter("v > 25"), ["k"], "month", "v")


@register("w19_fiscal_years", "SELECT year(o_orderdate + INTERVAL 3 MONTH)::INT AS fy, count(*) AS n, make_date(year(o_orderdate + INTERVAL 3 MONTH)::INT - 1, 10, 1) < (SELECT min(o_orderdate)::DATE FROM orders) OR make_date(year(o_orderdate + INTERVAL 3 MONTH)::INT, 9, 30) > (SELECT max(o_orderdate)::DATE FROM orders) AS partial FROM orders GROUP BY 1, 3")
def w19_fiscal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    span = o.agg(F.min("d").alias("a"), F.max("d").alias("z"))  # one row
    g = o.groupBy(fiscal_year("d").alias("fy")).agg(F.count("*").alias("n"), F.min("d").alias("d")).crossJoin(F.broadcast(span))
    return g.select("fy", "n", series.fiscal_partial(F.col("d"), F.col("a"), F.col("z")).alias("partial"))


@register("w20_cohorts", f"WITH {_Y}, s AS (SELECT k, min(y) AS s FROM y WHERE v >= 55 GROUP BY 1) SELECT y.k, y - s AS \"offset\", v AS value FROM y JOIN s USING (k) WHERE y - s BETWEEN 0 AND 4")
def w20_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cohorts(_yearly(spark, sf_dir).withColumnRenamed("v", "value"), ["k"], "y", "value", 55, 4)


@register("w21_cohort_median", f"WITH {_Y}, s AS (SELECT k, min(y) AS s FROM y WHERE v >= 50 GROUP BY 1) SELECT y - s AS \"offset\", median(v) AS med, count(*) AS n FROM y JOIN s USING (k) WHERE y - s BETWEEN 0 AND 4 GROUP BY 1")
def w21_cohort_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = series.cohorts(_yearly(spark, sf_dir), ["k"], "y", "v", 50, 4)
    return c.groupBy("offset").agg(F.median("v").alias("med"), F.count("*").alias("n"))


@register("w22_index_to_peak", f"WITH {_M} SELECT k, month, round(v / max(v) OVER (PARTITION BY k), 6) AS of_peak FROM m", dates=("month",))
def w22_index_to_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).select("k", "month", F.round(F.col("v") / F.max("v").over(Window.partitionBy("k")), 6).alias("of_peak"))


@register("w23_latest_complete", f"WITH {_M}, c AS (SELECT * FROM m WHERE month < (SELECT max(month) FROM m)) SELECT a.k, a.month, a.v, a.v - b.v AS change FROM c a LEFT JOIN m b ON a.k = b.k AND b.month = a.month - INTERVAL 12 MONTH WHERE a.month = (SELECT max(month) FROM c)", dates=("month",))
def w23_latest_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _monthly(spark, sf_dir)
    last = m.agg(F.max("month").alias("last"))  # one row: the running month is partial
    latest = m.crossJoin(F.broadcast(last)).filter("month = add_months(last, -1)").drop("last")
    before = m.select("k", F.add_months("month", 12).alias("month"), F.col("v").alias("b"))
    return latest.join(before, ["k", "month"], "left").select("k", "month", "v", (F.col("v") - F.col("b")).alias("change"))


@register("w24_flows", """WITH d AS (SELECT DISTINCT year(o_orderdate)::INT AS y, o_custkey AS u FROM orders), p AS (SELECT DISTINCT y FROM d WHERE y > (SELECT min(y) FROM d))
    SELECT p.y, (SELECT count(*) FROM d a WHERE a.y = p.y AND NOT EXISTS (SELECT 1 FROM d b WHERE b.y = p.y - 1 AND b.u = a.u)) AS entered,
    (SELECT count(*) FROM d a WHERE a.y = p.y - 1 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.y = p.y AND b.u = a.u)) AS "left", (SELECT count(*) FROM d a JOIN d b ON a.u = b.u AND b.y = a.y - 1 WHERE a.y = p.y) AS stayed FROM p""")
def w24_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), "o_custkey")
    return series.snapshot_flows(o, "y", "o_custkey")


@register("w26_leaders", f"WITH {_M}, r AS (SELECT month, k, row_number() OVER (PARTITION BY month ORDER BY v DESC, k) AS r FROM m), l AS (SELECT month, k AS leader FROM r WHERE r = 1) SELECT month, leader, lag(leader) OVER (ORDER BY month) IS NOT NULL AND leader <> lag(leader) OVER (ORDER BY month) AS changed FROM l", dates=("month",))
def w26_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.leaders(_monthly(spark, sf_dir), "month", "k", "v")


@register("w27_drawdown", f"WITH {_M}, f AS (SELECT k, max(v) OVER (PARTITION BY k ORDER BY month ROWS UNBOUNDED PRECEDING) - v AS f FROM m) SELECT k, max(f) AS \"drop\" FROM f GROUP BY 1")
def w27_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.drawdown(_monthly(spark, sf_dir), ["k"], "month", "v")


@register("w27_largest_drop", f"""WITH {_M}, t AS (SELECT month, sum(v) AS v FROM m GROUP BY 1), h AS (SELECT month, v, max(v) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS high FROM t),
    f AS (SELECT (SELECT min(month) FROM t WHERE t.v = h.high) AS a, month AS z, high - v AS d FROM h WHERE high > v ORDER BY d DESC, z LIMIT 1)
    SELECT a AS "from", z AS "to", d::BIGINT AS "drop", p.k AS member, (p.v - q.v)::BIGINT AS member_drop FROM f JOIN m p ON p.month = a JOIN m q ON q.month = z AND q.k = p.k ORDER BY member_drop DESC, member LIMIT 1""", dates=("from", "to"))
def w27_largest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fall of all series together, and the one that fell most between its two ends."""
    d = series.largest_drop(_monthly(spark, sf_dir), "k", "month", "v")
    return d.withColumns({c: F.col(c).cast("long") for c in ("drop", "member_drop")})


@register("w28_trailing_mean", f"WITH {_M} SELECT k, month, CASE WHEN count(v) OVER w = 5 THEN round(avg(v) OVER w, 6) END AS mean FROM m WINDOW w AS (PARTITION BY k ORDER BY month ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", dates=("month",))
def w28_trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).select("k", "month", F.round(series.trailing_mean("v", ["k"], "month", 5), 6).alias("mean"))


@register("w29_editions", "SELECT l_orderkey AS k, first(l_returnflag ORDER BY l_shipdate DESC, l_linenumber, l_returnflag DESC) AS picked, count(DISTINCT l_returnflag) AS known FROM lineitem GROUP BY 1")
def w29_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest edition wins, the alternatives are counted."""
    best = F.max(F.struct("l_shipdate", (-F.col("l_linenumber")).alias("o"), "l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(best.alias("b"), F.countDistinct("l_returnflag").alias("known")).select("k", F.col("b.l_returnflag").alias("picked"), "known")


@register("w30_coverage_break", f"WITH {_M}, z AS (SELECT k, month, CASE WHEN month < DATE '1997-01-01' THEN v // 8 ELSE v END AS v FROM m), b AS (SELECT *, lag(v) OVER w AS before, max(v) OVER (PARTITION BY k ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM z WINDOW w AS (PARTITION BY k ORDER BY month)) SELECT k, min(month) AS month FROM b WHERE v >= 5 * before AND high <= v / 5.0 GROUP BY 1", dates=("month",))
def w30_coverage_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _monthly(spark, sf_dir).withColumn("v", F.when(F.col("month") < F.lit("1997-01-01").cast("date"), F.floor(F.col("v") / 8)).otherwise(F.col("v")))
    return series.coverage_break(m, ["k"], "month", "v")


@register("w32_median_support", "SELECT o_orderpriority AS k, year(o_orderdate)::INT AS y, CASE WHEN count(*) >= 420 THEN round(median(o_totalprice), 4) END AS med FROM orders GROUP BY 1, 2")
def w32_median_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y")).agg(F.when(F.count("*") >= 420, F.round(F.median("o_totalprice"), 4)).alias("med"))


@register("w33_deadlines", "SELECT o_orderstatus AS agency, CASE WHEN d < 0 THEN 'closed' WHEN d > 730 THEN 'open-ended' WHEN d <= 30 THEN '30' WHEN d <= 60 THEN '60' WHEN d <= 90 THEN '90' ELSE 'later' END AS due, count(*) AS n FROM (SELECT o_orderstatus, date_diff('day', DATE '1998-06-01', o_orderdate::DATE) AS d FROM orders) GROUP BY 1, 2")
def w33_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.datediff(F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date"))
    due = F.when(d < 0, "closed").when(d > 730, "open-ended").when(d <= 30, "30").when(d <= 60, "60").when(d <= 90, "90").otherwise("later")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("agency"), due.alias("due")).agg(F.count("*").alias("n"))


@register("w35_days_to_close", "SELECT o_orderpriority AS k, round(median(date_diff('day', o_orderdate::DATE, s)), 4) AS med, count(*) AS n FROM orders JOIN (SELECT l_orderkey, max(l_shipdate)::DATE AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE s >= o_orderdate::DATE GROUP BY 1")
def w35_days_to_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("s"))
    o = table(spark, sf_dir, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("days", F.datediff("s", F.to_date("o_orderdate"))).filter("days >= 0")
    return o.groupBy(F.col("o_orderpriority").alias("k")).agg(F.round(F.median("days"), 4).alias("med"), F.count("*").alias("n"))


@register("w36_blend", f"WITH {_M}, n AS (SELECT *, lead(v) OVER (PARTITION BY k ORDER BY month) AS nxt FROM m) SELECT k, month, round(v + 0.25 * (nxt - v), 6) AS quarter_way FROM n WHERE nxt IS NOT NULL", dates=("month",))
def w36_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    nxt = F.lead("v").over(Window.partitionBy("k").orderBy("month"))
    return _monthly(spark, sf_dir).withColumn("nxt", nxt).filter("nxt is not null").select("k", "month", F.round(F.col("v") + 0.25 * (F.col("nxt") - F.col("v")), 6).alias("quarter_way"))


@register("w38_aligned", f"WITH {_M}, f AS (SELECT * FROM m WHERE v > 28) SELECT month, count(*) AS series, sum(v)::BIGINT AS total FROM f WHERE month BETWEEN (SELECT min(month) FROM (SELECT month FROM f GROUP BY 1 HAVING count(*) >= 2)) AND (SELECT max(month) FROM (SELECT month FROM f GROUP BY 1 HAVING count(*) >= 2)) GROUP BY 1", dates=("month",))
def w38_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span in which at least two series are recorded at its ends."""
    g = _monthly(spark, sf_dir).filter("v > 28").groupBy("month").agg(F.count("*").alias("series"), F.sum("v").alias("total"))
    span = g.filter("series >= 2").agg(F.min("month").alias("a"), F.max("month").alias("z"))  # one row
    return g.crossJoin(F.broadcast(span)).filter("month between a and z").drop("a", "z")


_TRENDS = """p AS (SELECT r AS id, r AS nth, CASE WHEN r % 5 = 4 THEN 'fiscal' ELSE 'year' END AS kind, y AS x, CASE WHEN (y + r) % 4 > 0 OR r > 5 THEN n END AS value, y = 2001 AND r % 2 = 0 AS partial FROM (SELECT c_nationkey AS r, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)), m AS (SELECT DISTINCT id, 1990 + id % 7 AS x FROM p WHERE id % 3 = 0 UNION ALL SELECT DISTINCT id, 1989 FROM p)"""


@register("w38_aligned_trends", f"""WITH {_TRENDS}, k AS (SELECT kind FROM (SELECT DISTINCT id, nth, kind FROM p) GROUP BY kind ORDER BY count(*) DESC, min(nth) LIMIT 1), u AS (SELECT DISTINCT id FROM p WHERE kind = (SELECT kind FROM k)),
    q AS (SELECT id, x, value FROM p JOIN u USING (id) WHERE NOT partial AND x >= (SELECT max(m.x) FROM m WHERE m.id = p.id)), c AS (SELECT x, count(value) AS known, count(*) FILTER (value > 0) AS positive FROM q GROUP BY x),
    s AS (SELECT x, positive FROM c WHERE x BETWEEN (SELECT min(x) FROM c WHERE known >= 2) AND (SELECT max(x) FROM c WHERE known >= 2) AND (SELECT count(*) FROM c WHERE known >= 2) >= 3)
    SELECT id, s.x, value, s.x = coalesce((SELECT min(x) FROM s WHERE positive = (SELECT count(*) FROM u)), (SELECT min(x) FROM s)) AS common FROM u CROSS JOIN s LEFT JOIN q USING (id, x)""")
def w38_aligned_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly orders by nation: some by fiscal year, some with a change of what is counted, the last year unfinished for some."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("id"), F.year("o_orderdate").alias("x")).agg(F.count("*").alias("n"))
    p = o.select("id", F.col("id").alias("nth"), F.when(F.col("id") % 5 == 4, "fiscal").otherwise("year").alias("kind"), "x", F.when(((F.col("x") + F.col("id")) % 4 > 0) | (F.col("id") > 5), F.col("n")).alias("value"), ((F.col("x") == 2001) & (F.col("id") % 2 == 0)).alias("partial"))
    ids = p.select("id").distinct()
    markers = ids.filter("id % 3 = 0").select("id", (1990 + F.col("id") % 7).alias("x")).unionByName(ids.select("id", F.lit(1989).cast("long").alias("x")))
    return series.aligned(p, markers)[0]


@register("w39_national_share", f"WITH {_M}, t AS (SELECT month, sum(v) AS t FROM m GROUP BY 1) SELECT k, month, CASE WHEN t > 0 THEN round(v / t, 6) END AS share FROM m JOIN t USING (month)", dates=("month",))
def w39_national_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _monthly(spark, sf_dir)
    t = m.groupBy("month").agg(F.sum("v").alias("t"))
    return m.join(t, "month").select("k", "month", F.when(F.col("t") > 0, F.round(F.col("v") / F.col("t"), 6)).alias("share"))


@register("w40_latest_filed", "SELECT l_partkey AS concept, year(l_shipdate)::INT AS y, last(l_extendedprice ORDER BY l_orderkey * 100 + l_linenumber, l_extendedprice) AS fact FROM lineitem GROUP BY 1, 2")
def w40_latest_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("concept"), F.year("l_shipdate").alias("y")).agg(F.max(F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"), "l_extendedprice"))["l_extendedprice"].alias("fact"))


@register("w40_reported", """WITH f AS (SELECT o_custkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS concept, CASE WHEN o_orderkey % 5 > 0 THEN e - (CASE WHEN o_orderkey % 5 < 3 THEN 339 + o_orderkey % 43 ELSE 79 + o_orderkey % 23 END)::INT END AS start, e AS "end", o_totalprice AS value,
      CASE o_orderkey % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '10-K/A' ELSE '8-K' END AS form, o_orderdate::DATE AS filed FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN make_date(year(o_orderdate)::INT, 1, 1 + (o_orderkey % 12)::INT) ELSE make_date(year(o_orderdate)::INT, 12, 31) END AS e FROM orders)),
    g AS (SELECT *, 'annual' AS grain FROM f WHERE replace(form, '/A', '') = '10-K' AND (start IS NULL OR "end" - start BETWEEN 340 AND 380) UNION ALL SELECT *, 'quarterly' FROM f WHERE replace(form, '/A', '') IN ('10-K', '10-Q') AND (start IS NULL OR "end" - start BETWEEN 80 AND 100)),
    r AS (SELECT *, row_number() OVER (PARTITION BY k, grain, start, "end" ORDER BY concept = 'B' DESC, filed DESC, value DESC) AS r FROM g WHERE concept <> 'C')
    SELECT k, grain, start, "end", (year("end") - (month("end") = 1 AND day("end") <= 7)::INT)::INT AS fiscal_year, concept, value, form, filed FROM r WHERE r = 1""", dates=("start", "end", "filed"))
def w40_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from orders: years and quarters of varying length, balances, amendments; concept B before A, C is not asked for."""
    k = F.col("o_orderkey")
    year = F.year("o_orderdate")
    end = F.when(k % 2 == 0, F.make_date(year, F.lit(1), (1 + k % 12).cast("int"))).otherwise(F.make_date(year, F.lit(12), F.lit(31)))
    span = F.when(k % 5 < 3, 339 + k % 43).otherwise(79 + k % 23).cast("int")
    f = table(spark, sf_dir, "orders").withColumn("end", end).select(F.col("o_custkey").alias("k"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "B").otherwise("C").alias("concept"), F.when(k % 5 > 0, F.date_sub("end", span)).alias("start"), "end", F.col("o_totalprice").alias("value"), F.when(k % 4 == 0, "10-K").when(k % 4 == 1, "10-Q").when(k % 4 == 2, "10-K/A").otherwise("8-K").alias("form"), F.to_date("o_orderdate").alias("filed"))
    return series.reported(f, ["k"], ["B", "A"])


@register("f11_whole_months", "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate >= TIMESTAMP '1995-01-31' THEN ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 - (day(l_shipdate) < 31)::INT)::INT END AS since, CASE WHEN l_shipdate < TIMESTAMP '2000-03-01' THEN ((2000 - year(l_shipdate)) * 12 + 2 - month(l_shipdate) - (29 < day(l_shipdate))::INT)::INT END AS until FROM lineitem")
def f11_whole_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed months of every line since the end of a month, and until the end of a February."""
    ship = F.to_date("l_shipdate")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", whole_months_between(F.lit("1995-01-31").cast("date"), ship).alias("since"), whole_months_between(ship, F.lit("2000-02-29").cast("date")).alias("until"))


@register("f12_exact_anniversary", "SELECT o_orderkey, CASE WHEN day((o_orderdate::DATE + INTERVAL 1 MONTH)::DATE) = day(o_orderdate) THEN (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE END AS due FROM orders", dates=("due",))
def f12_exact_anniversary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", exact_anniversary(F.to_date("o_orderdate"), 1).alias("due"))
