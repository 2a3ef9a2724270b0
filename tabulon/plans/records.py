"""Record queries: universal filter, guards, quarantine, sorting and paging, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import filters, intervals, ranking
from tabulon.operators.filters import RecordFilter
from tabulon.plans.registry import register
from tabulon.sources.tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: dataset, id, title, agencies (array), filed (timestamp), dates (array)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderkey").alias("id"), F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string"), "o_orderpriority").alias("title"),
        F.array("o_orderpriority", "o_orderstatus").alias("agencies"), F.col("o_orderdate").alias("filed"), F.array(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 400)).alias("dates"), F.col("o_totalprice").alias("amount"),
    )


_REC = """r AS (SELECT o_orderstatus AS dataset, o_orderkey AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
  [o_orderpriority, o_orderstatus] AS agencies, o_orderdate AS filed, [o_orderdate::DATE, o_orderdate::DATE + 400] AS dates, o_totalprice AS amount FROM orders)"""


@register("p1_corpus_query", f"WITH {_REC} SELECT id, title FROM r WHERE dataset IN ('O', 'F') AND list_has_any(agencies, ['1-URGENT', '2-HIGH']) AND contains(lower(title), 'order 1') AND filed >= TIMESTAMP '1996-01-01' AND filed < TIMESTAMP '1998-07-01' ORDER BY filed DESC, id LIMIT 50 OFFSET 10")
def p1_corpus_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = RecordFilter(datasets=("O", "F"), facets={"agencies": ("1-URGENT", "2-HIGH")}, contains={"title": "Order 1"}, ranges={"filed": ("1996-01-01", "1998-06-30")})
    return ranking.page(filters.keep(_records(spark, sf_dir), wanted), "date_desc", date="filed", limit=50, offset=10).select("id", "title")


@register("p5_id_list", f"WITH {_REC} SELECT id, dataset FROM r WHERE id IN (1, 2, 3, 5, 8, 13, 21, 34)")
def p5_id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep(_records(spark, sf_dir), RecordFilter(ids=(1, 2, 3, 5, 8, 13, 21, 34))).select("id", "dataset")


@register("p8_any_date", f"WITH {_REC} SELECT id FROM r WHERE len(list_filter(dates, lambda d: d BETWEEN DATE '1997-03-01' AND DATE '1997-03-15')) > 0")
def p8_any_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep(_records(spark, sf_dir), RecordFilter(any_date={"dates": ("1997-03-01", "1997-03-15")})).select("id")


@register("p9_free_text", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') AND contains(lower(concat_ws(' ', c_name, c_mktsegment)), '00')")
def p9_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(filters.all_terms(["c_name", "c_mktsegment"], "BUILD 00")).select("c_custkey", "c_name")


@register("p10_regex_guards", r"SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]-') AND NOT regexp_matches(o_orderpriority, '(?i)urgent')")
def p10_regex_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").filter(p.rlike("^[1-3]-") & ~p.rlike("(?i)urgent")).select("o_orderkey", "o_orderpriority")


@register("p11_is_distinct", "SELECT c_custkey FROM customer LEFT JOIN (SELECT s_suppkey, s_nationkey FROM supplier) ON s_suppkey = c_custkey WHERE s_nationkey IS DISTINCT FROM c_nationkey")
def p11_is_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.join(s, F.col("s_suppkey") == F.col("c_custkey"), "left").filter(~F.col("s_nationkey").eqNullSafe(F.col("c_nationkey"))).select("c_custkey")


@register("p13_url_allow_list", r"SELECT page_id, url LIKE 'https://%' AND regexp_matches(url, '^https://([^/?#:]+\.)?example\.(org|net)([/?#:]|$)') AS allowed FROM pages")
def p13_url_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", filters.allowed_url(F.col("url"), ("example.org", "example.net")).alias("allowed"))


@register("p14_hold_reasons", "SELECT CASE WHEN l_quantity > 45 THEN 'too many' WHEN l_discount > 0.08 THEN 'too cheap' WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'too old' END AS hold_reason, count(*) AS n FROM lineitem GROUP BY 1 HAVING hold_reason IS NOT NULL")
def p14_hold_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"too many": F.col("l_quantity") > 45, "too cheap": F.col("l_discount") > 0.08, "too old": F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp")}
    return filters.quarantine(table(spark, sf_dir, "lineitem"), rules)[1].groupBy("hold_reason").agg(F.count("*").alias("n"))


@register("p15_visible_edges", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus <> 'P' AND (l_returnflag <> 'N' OR l_discount >= 0.08)")
def p15_visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges order -> supplier: both ends exist, the source is settled, and model-made ones (N) are confident."""
    edges = table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") != "N") | (F.col("l_discount") >= 0.08))
    settled = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return edges.join(settled, edges["l_orderkey"] == settled["o_orderkey"], "left_semi").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey", "l_linenumber")


@register("p18_computed_text", "SELECT c_custkey, concat_ws(' ', nullif(c_name, ''), CASE WHEN c_acctbal > 0 THEN c_mktsegment END) AS text FROM customer")
def p18_computed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", F.nullif("c_name", F.lit("")), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))).alias("text"))


@register("p19_min_support", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 80) GROUP BY 1")
def p19_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.with_support(table(spark, sf_dir, "part"), ["p_brand"], 80).groupBy("p_brand").agg(F.count("*").alias("n"))


@register("p20_suppression", "SELECT p_size, p_brand, CASE WHEN count(*) >= 5 THEN round(avg(p_retailprice), 4) END AS mean_price FROM part GROUP BY 1, 2")
def p20_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_size", "p_brand").agg(filters.suppress_small(F.round(F.avg("p_retailprice"), 4), F.count("*")).alias("mean_price"))


@register("t1_sort_modes", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 5")
def t1_sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc_nulls_last(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), "o_orderkey").offset(5).limit(40).select("o_orderkey", "o_totalprice")


@register("t2_page_envelope", "SELECT 7 AS page, ceil(count(*) / 200.0)::BIGINT AS pages, count(*) AS total, least(6 * 200 + 1, count(*)) AS first, least(7 * 200, count(*)) AS last FROM orders")
def t2_page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.envelope(table(spark, sf_dir, "orders"), page=7, size=200)


@register("t3_keyset_page", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 777 ORDER BY o_orderkey LIMIT 100")
def t3_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.after_key(table(spark, sf_dir, "orders"), "o_orderkey", 777, 100).select("o_orderkey", "o_orderstatus")


@register("t4_insensitive_sort", "SELECT p_partkey, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
def t4_insensitive_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return ranking.numbered(ordered, ["name", "p_partkey"], "place").select("p_partkey", "place")


@register("t5_best_passage", "SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1 ORDER BY best DESC, o_custkey LIMIT 20")
def t5_best_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best")).orderBy(F.desc("best"), "o_custkey").limit(20)


@register("t7_fair_interleave", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) ORDER BY r, c_mktsegment LIMIT 60")
def t7_fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.interleave(table(spark, sf_dir, "customer"), "c_mktsegment", [F.desc("c_acctbal"), F.col("c_custkey")], 60).select("c_custkey", "c_mktsegment")


@register("t9_leaders", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_suppkey LIMIT 10")
def t9_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_suppkey").limit(10)


@register("t10_best_then_top", "SELECT l_suppkey, l_partkey, l_extendedprice, total FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey) AS r, count(*) OVER (PARTITION BY l_suppkey) AS total FROM (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2)) WHERE r <= 5")
def t10_best_then_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    return ranking.top_per_group(best, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_partkey")], 5, total="total")


@register("t11_by_month", "SELECT strftime(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY month NULLS LAST")
def t11_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")), "yyyy-MM")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.count("*").alias("n")).orderBy(F.asc_nulls_last("month"))


@register("u1_union_all", "SELECT 'c' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 's', s_nationkey, count(*) FROM supplier GROUP BY 2")
def u1_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).select(F.lit("c").alias("kind"), "nation", "n")
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).select(F.lit("s").alias("kind"), "nation", "n")
    return c.unionByName(s)


@register("u2_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@register("u3_set_algebra", "SELECT o_custkey AS k, 'only orders' AS side FROM (SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier) UNION ALL SELECT k, 'both' FROM (SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier)")
def u3_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    return a.subtract(b).withColumn("side", F.lit("only orders")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@register("u4_interval_union", """
    WITH i AS (SELECT l_suppkey AS k, l_shipdate::DATE AS s, l_shipdate::DATE + l_quantity::INT AS e FROM lineitem),
    m AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT k, min(s) AS start, max(e) AS "end", count(*) AS parts FROM g GROUP BY k, island""", dates=("start", "end",))
def u4_interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("s"), F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int")).alias("e"))
    return intervals.merged(i, ["k"], "s", "e").select("k", F.col("s").alias("start"), F.col("e").alias("end"), "parts")


@register("u5_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def u5_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
