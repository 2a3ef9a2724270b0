"""Queries that complete the families: windows, scalar functions, text checks, reliability, work queues, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.functions import text as tf
from tabulon.operators import ranking, search, statistics
from tabulon.plans.registry import register
from tabulon.sources.scratch import fresh_path
from tabulon.sources.tables import table

_M = "m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS v FROM orders GROUP BY 1, 2)"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("month")).agg(F.count("*").alias("v"))


@register("d5_hierarchy", "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def d5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are counted per nation before the small tables are joined."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    j = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.sum("n").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@register("p6_array_containment", "SELECT vec_id FROM embeddings WHERE list_contains(list_transform(embedding[1:4], lambda x: x > 0), true) AND NOT list_contains(list_transform(embedding[1:4], lambda x: x > 0), false)")
def p6_array_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    signs = F.transform(F.slice("embedding", 1, 4), lambda x: x > 0)
    return table(spark, sf_dir, "embeddings").filter(F.array_contains(signs, True) & ~F.array_contains(signs, False)).select("vec_id")


@register("w2_group_size", "SELECT doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents")
def w2_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count per group, joined back: a source may hold a third of all rows, too many for one window partition."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "s")
    return d.join(n, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "n")


@register("w12_watch", "WITH l AS (SELECT p_brand, l_orderkey, l_linestatus, l_returnflag, l_extendedprice AS price, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS m FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT p_brand, count(*) FILTER (m > 23973) AS r12, count(*) FILTER (m <= 23973) AS p12, count(*) FILTER (m > 23982) AS tail, count(*) FILTER (m > 23973 AND l_returnflag = 'R') AS partner_r12, count(*) FILTER (m <= 23973 AND l_returnflag = 'R') AS partner_p12, count(DISTINCT l_orderkey) FILTER (m > 23973) AS links, round(sum(price) FILTER (l_linestatus = 'O'), 2) AS pending FROM l WHERE m BETWEEN 23962 AND 23985 GROUP BY 1")
def w12_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per unit the last and the prior twelve months and the newest three, the same of its partner series, linked orders
    and pending sums; lines are counted per part and order before they are joined."""
    m, new, partner = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1, F.col("m") > 23973, F.col("l_returnflag") == "R"
    l = table(spark, sf_dir, "lineitem").withColumn("m", m).filter("m between 23962 and 23985")
    l = l.groupBy("l_partkey", "l_orderkey").agg(F.count_if(new).alias("r12"), F.count_if(~new).alias("p12"), F.count_if(F.col("m") > 23982).alias("tail"), F.count_if(new & partner).alias("partner_r12"), F.count_if(~new & partner).alias("partner_p12"), F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("pending"))
    j = l.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    sums = [F.sum(c).alias(c) for c in ("r12", "p12", "tail", "partner_r12", "partner_p12")]
    return j.groupBy("p_brand").agg(*sums, F.countDistinct(F.when(F.col("r12") > 0, F.col("l_orderkey"))).alias("links"), F.round(F.sum("pending"), 2).alias("pending"))


@register("w13_surges", "WITH g AS (SELECT o_custkey % 40 AS k, count(*) FILTER (year(o_orderdate) = 1999) AS a, count(*) FILTER (year(o_orderdate) = 2000 AND o_custkey % 7 > 0) AS z FROM orders GROUP BY 1), p AS (SELECT *, CASE WHEN a >= 40 THEN round(100.0 * (z - a) / a, 6) END AS pct FROM g) SELECT k, a, z, pct, row_number() OVER (ORDER BY pct DESC NULLS LAST, k) AS place FROM p")
def w13_surges(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    g = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("k")).agg(F.count_if(y == 1999).alias("a"), F.count_if((y == 2000) & (F.col("o_custkey") % 7 > 0)).alias("z"))
    g = g.withColumn("pct", F.when(F.col("a") >= 40, F.round(100.0 * (F.col("z") - F.col("a")) / F.col("a"), 6)))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("pct"), "k")))  # one row per unit


@register("w37_lagged_window", f"WITH {_M}, z AS (SELECT max(month) AS z FROM m) SELECT k, sum(v)::BIGINT AS v FROM m, z WHERE month <= z - INTERVAL 3 MONTH AND month > z - INTERVAL 15 MONTH GROUP BY 1")
def w37_lagged_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months that end three months before the newest, which are still filling up."""
    m = _monthly(spark, sf_dir)
    z = m.agg(F.max("month").alias("z"))  # one row
    return m.crossJoin(F.broadcast(z)).filter((F.col("month") <= F.add_months("z", -3)) & (F.col("month") > F.add_months("z", -15))).groupBy("k").agg(F.sum("v").alias("v"))


@register("w41_headline", f"WITH {_M}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY month DESC) AS r FROM m) SELECT k, max(v) FILTER (r = 2) AS value, max(v) FILTER (r = 2) - max(v) FILTER (r = 3) AS change, count(*) - 1 AS complete FROM r GROUP BY 1")
def w41_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest month is incomplete: the tile shows the one before and its change."""
    r = _monthly(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("month"))))
    value, before = (F.max(F.when(F.col("r") == n, F.col("v"))) for n in (2, 3))
    return r.groupBy("k").agg(value.alias("value"), (value - before).alias("change"), (F.count("*") - 1).alias("complete"))


@register("a9_percentile_filter", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25) FILTER (o_orderstatus = 'O'), 4) AS q1, round(median(o_totalprice), 4) AS med FROM orders GROUP BY 1")
def a9_percentile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus")
    med = ranking.quantiles(o, ["o_orderpriority"], "o_totalprice", {"med": 0.5})
    q1 = ranking.quantiles(o.filter("o_orderstatus = 'O'"), ["o_orderpriority"], "o_totalprice", {"q1": 0.25})
    return med.join(q1, "o_orderpriority", "left").select("o_orderpriority", F.round("q1", 4).alias("q1"), F.round("med", 4).alias("med"))


@register("a14_object_agg", """SELECT k, '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS o FROM (SELECT o_orderpriority AS k, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def a14_object_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    return g.groupBy("k").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "n"))))).alias("o"))


@register("a33_top_counts", "SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share, row_number() OVER (ORDER BY n DESC, event_type) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) QUALIFY place <= 3")
def a33_top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))  # one row
    top = g.orderBy(F.desc("n"), "event_type").limit(3)
    return top.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).alias("place"))


@register("t6_notability", "WITH s AS (SELECT c_custkey AS id, c_acctbal AS score FROM customer UNION ALL SELECT o_custkey, max(o_totalprice) / 40 FROM orders GROUP BY 1) SELECT id, round(max(score), 4) AS score FROM s GROUP BY 1 ORDER BY max(score) DESC, id LIMIT 10")
def t6_notability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest ids of two score lists; an id counts once, with its best score."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.max("o_totalprice") / 40).alias("score"))
    return a.unionByName(b).groupBy("id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "id").limit(10).select("id", F.round("s", 4).alias("score"))


@register("t8_daily_rotation", "SELECT p_partkey, (19783 + list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)) % 7 AS slot FROM part")
def t8_daily_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day number plus the 32-bit FNV-1a hash of the (ASCII) name, modulo 7."""
    chars = F.transform(F.filter(F.split("p_name", ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(chars, F.lit(2166136261), lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(4294967295)))
    return table(spark, sf_dir, "part").select("p_partkey", ((F.lit(19783) + h) % 7).alias("slot"))


@register("f3_strip_split", r"WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g') AS t FROM documents) SELECT doc_id, length(t) AS n_chars, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '[\x09-\x0D\x20]+')) END::BIGINT AS n_parts FROM s")
def f3_strip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z", "")
    s = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return s.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", r"[\x09-\x0D\x20]+"))).cast("long").alias("n_parts"))


@register("f5_title_case", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM part")
def f5_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tf.title_case("p_name").alias("title"))


@register("f5_short_names", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type || ' of ' || p_brand || ' Co.' WHEN 1 THEN p_type ELSE p_type || ', ' || p_brand END AS maker, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' and ' || p_name ELSE 'Antitrust Litigation' END AS title FROM part""")
def f5_short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from makers with corporate endings and from titles of cases."""
    maker = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_type, ' (US)  of ', p_brand, ' Co., Ltd.') WHEN 1 THEN concat(p_type, ' North America LLC') ELSE concat(p_type, ', ', p_brand, ', Inc. USA') END")
    title = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('IN RE: ', p_name, ' Marketing, Sales Practices and Products Liability Litigation (No. II)') WHEN 1 THEN concat('In re \"', p_name, ' and ', p_name, '\", Data Security Breach Litigation') ELSE 'Antitrust Litigation' END")
    return table(spark, sf_dir, "part").select("p_partkey", tf.short_maker(maker).alias("maker"), tf.short_title(title).alias("title"))


@register("f13_date_parts", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, quarter(o_orderdate)::INT AS q, isodow(o_orderdate)::INT AS weekday, strftime(make_date(year(o_orderdate)::INT, 1, 1), '%Y-%m-%d') AS year_start FROM orders")
def f13_date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "o_orderdate"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM").alias("month"), F.quarter(d).alias("q"), (F.weekday(d) + 1).alias("weekday"), F.date_format(F.make_date(F.year(d), F.lit(1), F.lit(1)), "yyyy-MM-dd").alias("year_start"))


@register("f15_clamp", "SELECT p_partkey, greatest(least(p_size, 40), 5) AS size FROM part")
def f15_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.least("p_size", F.lit(40)), F.lit(5)).alias("size"))


@register("f16_arrays", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 5) AS head, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def f16_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.aggregate(F.slice("embedding", 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(head, 5).alias("head"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@register("f21_null_cases", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal = 0 THEN 'zero' ELSE 'credit' END AS side FROM customer")
def f21_null_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("c_acctbal") < 0, "debt").when(F.col("c_acctbal") == 0, "zero").otherwise("credit")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("seg"), side.alias("side"))


@register("f22_money", "SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS price FROM orders")
def f22_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"))


@register("f23_nice_steps", "WITH m AS (SELECT c_nationkey AS k, max(c_acctbal) AS v FROM customer GROUP BY 1), p AS (SELECT k, v, power(10.0, floor(log10(v / 5))) AS p FROM m WHERE v > 0) SELECT k, p * CASE WHEN v / 5 <= p THEN 1 WHEN v / 5 <= 2 * p THEN 2 WHEN v / 5 <= 5 * p THEN 5 ELSE 10 END AS step FROM p")
def f23_nice_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least step of 1, 2 or 5 times a power of ten with which five steps reach the largest value."""
    m = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_acctbal").alias("v")).filter("v > 0")
    p, v = F.pow(F.lit(10.0), F.floor(F.log10(F.col("v") / 5))), F.col("v") / 5
    return m.select("k", (p * F.when(v <= p, 1).when(v <= 2 * p, 2).when(v <= 5 * p, 5).otherwise(10)).alias("step"))


@register("x10_related", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT q.vec_id AS query, v.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS place FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY place <= 10")
def x10_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records like each record whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).select("query", "id", "place")


@register("x22_title", r"SELECT doc_id, left(trim(regexp_extract(text, '[^\n]*[^\x09-\x0D\x20][^\n]*'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 80) AS title FROM documents")
def x22_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line that is not blank."""
    line = F.regexp_extract("text", r"[^\n]*[^\x09-\x0D\x20][^\n]*", 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.left(F.regexp_replace(line, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z", ""), F.lit(80)).alias("title"))


@register("n13b_surprise", "WITH g AS (SELECT p_brand, count(*) FILTER (p_size < 3) AS x, count(*) AS n FROM part GROUP BY 1), l AS (SELECT *, greatest(n * sum(x) OVER () / sum(n) OVER (), 0.25) AS l FROM g) SELECT p_brand, x, round(least(-log10(list_sum(list_transform(range(0, (14 * sqrt(greatest(x, l)) + 80)::BIGINT), lambda j: exp((x + j) * ln(l) - l - lgamma(x + j + 1))))), 50), 6) AS surprise FROM l")
def n13b_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-log10 P(X >= x) for a Poisson count whose mean is the brand's share of the whole."""
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") < 3).alias("x"), F.count("*").alias("n"))
    total = g.agg(F.sum("x").alias("sx"), F.sum("n").alias("sn"))  # one row
    l = g.crossJoin(F.broadcast(total)).withColumn("l", F.greatest(F.col("n") * F.col("sx") / F.col("sn"), F.lit(0.25)))
    surprise = F.least(-F.log10(statistics.poisson_tail(F.col("x"), F.col("l"))), F.lit(50.0))
    return l.select("p_brand", "x", (F.round(surprise, 6) + 0.0).alias("surprise"))  # adding 0 makes -0 a plain 0


@register("k5_json_export", "SELECT p_partkey, p_name, p_retailprice FROM part")
def k5_json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, p = fresh_path(spark, "json"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    p.write.json(path)
    return spark.read.schema(p.schema).json(path)


@register("udf1_sql_function", "SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug FROM customer")
def udf1_sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function in SQL, which the optimizer inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION slug(s STRING) RETURNS STRING RETURN lower(regexp_replace(s, '[^A-Za-z0-9]+', '-'))")
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "slug(c_name) AS slug")
