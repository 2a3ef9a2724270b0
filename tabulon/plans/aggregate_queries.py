"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators import aggregates, ranking
from tabulon.plans.registry import register
from tabulon.sources.tables import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@register("a1_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2")
def a1_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@register("a2_facet_counts", "WITH g AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1) SELECT value, n, (SELECT sum(n) FROM g)::BIGINT AS total, (SELECT count(*) FROM g) AS distinct_values, (SELECT count(*) FROM g) > 10 AS truncated FROM g ORDER BY n DESC, value LIMIT 10")
def a2_facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.facet_counts(table(spark, sf_dir, "part"), "p_brand", 10)


@register("a3_filtered", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, round(sum(l_extendedprice) FILTER (l_discount > 0.05), 2) AS discounted FROM lineitem GROUP BY 1")
def a3_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2).alias("discounted"))


@register("a4_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def a4_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@register("a5_distinct_rows", "SELECT l_suppkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1")
def a5_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "l_suppkey").dropDuplicates().groupBy("l_suppkey").agg(F.count("*").alias("n"))


@register("a6_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 14")
def a6_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 14")


@register("a7_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def a7_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@register("a8_grouping_sets", "SELECT l_returnflag, l_linestatus, year(l_shipdate)::INT AS y, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, y), (l_linestatus, y), (y), ())")
def a8_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir).withColumn("y", F.year("l_shipdate"))
    return l.groupingSets([["l_returnflag", "y"], ["l_linestatus", "y"], ["y"], []], "l_returnflag", "l_linestatus", "y").agg(F.count("*").alias("n"))


@register("a10_quantiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS q10, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY 1")
def a10_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ranking.quantiles(_lines(spark, sf_dir), ["l_returnflag"], "l_extendedprice", {"q10": 0.1, "q90": 0.9, "med": 0.5})
    return q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("q10", "q90", "med")])


@register("a11_nearest_rank", "SELECT p_brand, quantile_disc(p_retailprice, 0.25) AS q25, quantile_disc(p_retailprice, 0.9) AS q90 FROM part GROUP BY 1")
def a11_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.nearest_ranks(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", {"q25": 0.25, "q90": 0.9})


@register("a13_ordered_list", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def a13_ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(listed, lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@register("a15_bool", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_pending, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1")
def a15_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@register("a16_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def a16_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.first_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@register("a17_most_frequent", "SELECT c, v AS priority FROM (SELECT o_custkey AS c, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def a17_most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.most_frequent(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "priority").withColumnRenamed("o_custkey", "c")


@register("a18_per_year", "SELECT CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate)::INT END AS y, count(*) AS n FROM orders GROUP BY 1")
def a18_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("y")).agg(F.count("*").alias("n"))


@register("a19_event_collapse", "WITH e AS (SELECT l_orderkey, min(l_shipdate) AS d, bool_or(l_returnflag = 'R') AS worst, bool_or(l_linestatus = 'O') AS ongoing FROM lineitem GROUP BY 1) SELECT year(d)::INT AS y, count(*) AS events, count(*) FILTER (worst) AS worst, count(*) FILTER (ongoing) AS ongoing FROM e GROUP BY 1")
def a19_event_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d"), F.bool_or(F.col("l_returnflag") == "R").alias("w"), F.bool_or(F.col("l_linestatus") == "O").alias("o"))
    return e.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("events"), F.count_if("w").alias("worst"), F.count_if("o").alias("ongoing"))


@register("a20_shares", "WITH g AS (SELECT c_mktsegment AS seg, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS nation, count(*) AS n FROM customer GROUP BY 1, 2) SELECT seg, nation, n, round(n / sum(n) OVER (PARTITION BY seg), 6) AS share, CASE WHEN nation IS NOT NULL THEN round(n / sum(n) FILTER (nation IS NOT NULL) OVER (PARTITION BY seg), 6) END AS share_of_known FROM g")
def a20_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("seg"), F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nation"))
    return aggregates.shares(c, ["seg"], "nation").withColumn("share", F.round("share", 6)).withColumn("share_of_known", F.round("share_of_known", 6))


@register("a21_rates", "SELECT n_name, round(100000.0 * count(*) FILTER (c_acctbal < 0) / nullif(count(*), 0), 4) AS per_100k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def a21_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.try_divide(100000.0 * F.count_if(F.col("c_acctbal") < 0), F.count("*")), 4).alias("per_100k"))


@register("a22_concentration", "WITH v AS (SELECT l_returnflag AS f, l_suppkey AS u, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT *, v / sum(v) OVER (PARTITION BY f) AS s, row_number() OVER (PARTITION BY f ORDER BY v DESC, u) AS r FROM v) SELECT f AS l_returnflag, count(*) AS units, round(sum(power(100 * s, 2)), 4) AS hhi, round(sum(s) FILTER (r <= 3), 6) AS top_share FROM s GROUP BY 1")
def a22_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = aggregates.concentration(_lines(spark, sf_dir), ["l_returnflag"], "l_suppkey", "l_quantity", 3)
    return c.withColumn("hhi", F.round("hhi", 4)).withColumn("top_share", F.round("top_share", 6))


@register("a23_histogram", "SELECT floor(log10(o_totalprice))::INT AS decade, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def a23_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_totalprice > 0").groupBy(F.floor(F.log10("o_totalprice")).cast("int").alias("decade")).agg(F.count("*").alias("n"))


@register("a24_class_breaks", "SELECT list_distinct([quantile_disc(n, 0.2), quantile_disc(n, 0.4), quantile_disc(n, 0.6), quantile_disc(n, 0.8), max(n)]).list_sort().list_transform(lambda x: x::VARCHAR).array_to_string(',') AS breaks FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def a24_class_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return aggregates.class_breaks(n, "n").select(F.array_join(F.transform("breaks", lambda x: x.cast("long").cast("string")), ",").alias("breaks"))


@register("a25_survey_total", """WITH d AS (SELECT l_returnflag AS dom, l_suppkey % 5 AS st, l_suppkey AS psu, l_quantity AS w FROM lineitem), m AS (SELECT st, count(DISTINCT psu) AS m FROM d GROUP BY 1),
    u AS (SELECT dom, st, psu, sum(w * 1.0) AS t, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT dom, st, sum(t) AS t, sum(t * t) AS tt, sum(n) AS n FROM u GROUP BY ALL)
    SELECT dom, sum(n)::BIGINT AS n, round(sum(t), 2) AS total, round(sum(CASE WHEN m > 1 THEN m / (m - 1) * (tt - t * t / m) ELSE 0 END), 2) AS variance FROM s JOIN m USING (st) GROUP BY 1""")
def a25_survey_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _lines(spark, sf_dir).select(F.col("l_returnflag").alias("dom"), (F.col("l_suppkey") % 5).alias("st"), F.col("l_suppkey").alias("psu"), F.col("l_quantity").alias("w"), F.lit(1.0).alias("one"))
    return aggregates.survey_total(d, ["dom"], "st", "psu", "w", "one").select("dom", "n", F.round("total", 2).alias("total"), F.round("variance", 2).alias("variance"))


@register("a25_survey_ratio", """WITH d AS (SELECT l_returnflag AS dom, l_suppkey % 5 AS st, l_suppkey AS psu, l_quantity AS w, l_discount > 0.05 AS hit FROM lineitem), m AS (SELECT st, count(DISTINCT psu) AS m FROM d GROUP BY 1),
    r AS (SELECT dom, count(*) AS n, sum(w) AS x, sum(CASE WHEN hit THEN w ELSE 0 END) AS y FROM d GROUP BY 1), u AS (SELECT dom, st, psu, sum(w) AS x, sum(CASE WHEN hit THEN w ELSE 0 END) AS y FROM d GROUP BY ALL),
    z AS (SELECT u.dom, st, sum(u.y - r.y / r.x * u.x) AS z, sum((u.y - r.y / r.x * u.x) ** 2) AS zz FROM u JOIN r USING (dom) GROUP BY ALL)
    SELECT dom, n, round(y / x, 9) AS share, round(1e6 * v / (x * x), 9) AS share_variance FROM r JOIN (SELECT dom, sum(CASE WHEN m > 1 THEN m / (m - 1) * (zz - z * z / m) ELSE 0 END) AS v FROM z JOIN m USING (st) GROUP BY 1) USING (dom)""")
def a25_survey_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of discounted lines by domain, its variance times a million."""
    d = _lines(spark, sf_dir).select(F.col("l_returnflag").alias("dom"), (F.col("l_suppkey") % 5).alias("st"), F.col("l_suppkey").alias("psu"), F.col("l_quantity").alias("w"), (F.col("l_discount") > 0.05).alias("hit"))
    return aggregates.survey_ratio(d, ["dom"], "st", "psu", "w", F.col("hit")).select("dom", "n", F.round("share", 9).alias("share"), F.round(F.col("share_variance") * 1e6, 9).alias("share_variance"))


@register("a26_moe_sum", "SELECT p_brand, CASE WHEN count(m) = count(*) THEN round(sqrt(sum(m * m)), 6) END AS moe FROM (SELECT p_brand, CASE WHEN p_size <> 50 OR p_brand < 'Brand#3' THEN p_size / 10.0 END AS m FROM part) GROUP BY 1")
def a26_moe_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.when((F.col("p_size") != 50) | (F.col("p_brand") < "Brand#3"), F.col("p_size") / 10.0)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(aggregates.moe_sum(m), 6).alias("moe"))


@register("a27_exact_cents", "SELECT o_orderstatus, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1")
def a27_exact_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@register("a28_duplicates", "SELECT text, count(*) AS rows FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def a28_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.duplicate_groups(table(spark, sf_dir, "documents"), "text")


@register("a29_profile", "SELECT 'c_name' AS \"column\", count(*) AS rows, count(*) FILTER (c_name IS NULL OR trim(c_name) = '') AS blank, count(*) FILTER (trim(c_name) <> c_name) AS untrimmed FROM customer UNION ALL SELECT 'c_mktsegment', count(*), count(*) FILTER (c_mktsegment IS NULL OR trim(c_mktsegment) = ''), count(*) FILTER (trim(c_mktsegment) <> c_mktsegment) FROM customer")
def a29_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.profile(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"]).drop("approx_values")


_REGISTRY = """d AS (SELECT CASE WHEN o_orderkey % 50 = 3 THEN NULL WHEN o_orderkey % 50 = 4 THEN 'x' || o_orderkey ELSE (o_orderkey // 2)::VARCHAR END AS id, CASE WHEN o_orderkey % 9 = 0 THEN ' ' WHEN o_orderkey % 9 = 1 THEN ' ' || o_orderpriority ELSE o_orderpriority END AS label,
    CASE WHEN o_orderkey % 7 = 0 THEN '2001-02-30' WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END AS cust FROM orders)"""


@register("a29_quality", f"""WITH {_REGISTRY} SELECT 'rows' AS "check", '' AS subject, count(*) AS n FROM d UNION ALL SELECT 'blank', 'label', count(*) FILTER (trim(label) = '') FROM d UNION ALL SELECT 'untrimmed', 'label', count(*) FILTER (trim(label) <> label AND trim(label) <> '') FROM d
    UNION ALL SELECT 'bad_dates', 'day', count(*) FILTER (NOT coalesce(try_strptime(day, '%Y-%m-%d') BETWEEN DATE '1995-01-01' AND DATE '2030-01-01', false)) FROM d UNION ALL SELECT 'bad_ids', 'id', count(*) FILTER (NOT coalesce(regexp_full_match(id, '[0-9]+'), false)) FROM d
    UNION ALL SELECT 'duplicate_ids', 'id', coalesce(sum(m - 1), 0)::BIGINT FROM (SELECT count(*) AS m FROM d WHERE regexp_full_match(id, '[0-9]+') GROUP BY id) UNION ALL SELECT 'orphans', 'cust', count(*) FROM d WHERE cust NOT IN (SELECT c_custkey FROM customer)""")
def a29_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register with bad days, blanks, ids that are missing, odd or repeated, and customers that are not there."""
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select(
        F.when(k % 50 == 4, F.concat(F.lit("x"), k)).when(k % 50 != 3, F.floor(k / 2).cast("string")).alias("id"),
        F.when(k % 9 == 0, " ").when(k % 9 == 1, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("label"),
        F.when(k % 7 == 0, "2001-02-30").when(k % 7 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(k % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("cust"),
    )
    return aggregates.quality(d, "id", ["label"], {"day": ("1995-01-01", "2030-01-01")}, {"cust": (table(spark, sf_dir, "customer"), "c_custkey")})


@register("a30_path_flows", "WITH t AS (SELECT conv_id, turn, role, row_number() OVER w - 1 AS step, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) SELECT step::INT AS step, role AS src, nxt AS dst, count(*) AS n FROM t WHERE nxt IS NOT NULL GROUP BY 1, 2, 3")
def a30_path_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select(F.transform("t", lambda x: x["role"]).alias("path"))
    return aggregates.path_flows(paths, "path")


@register("a31_cited_by", "SELECT l_suppkey, count(DISTINCT l_orderkey) AS orders, count(DISTINCT o_custkey) AS customers FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey IS DISTINCT FROM l_suppkey GROUP BY 1")
def a31_cited_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left").filter(~F.col("o_custkey").eqNullSafe(F.col("l_suppkey")))
    return l.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("o_custkey").alias("customers"))


@register("a32_fold_tail", "WITH g AS (SELECT p_brand AS name, round(sum(p_retailprice), 2) AS v FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, name) AS r FROM g) SELECT CASE WHEN r <= 6 THEN name ELSE 'Other' END AS name, round(sum(v), 2) AS v FROM r GROUP BY 1")
def a32_fold_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.sum("p_retailprice"), 2).alias("v"))
    return aggregates.fold_tail(g, "name", "v", 6).withColumn("v", F.round("v", 2))


@register("a35_flags", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey & 1 > 0 THEN 'one' END, CASE WHEN c_custkey & 2 > 0 THEN 'two' END, CASE WHEN c_custkey & 4 > 0 THEN 'four' END], lambda x: x IS NOT NULL), '|') AS flags FROM customer")
def a35_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.when(F.col("c_custkey").bitwiseAND(b) > 0, n) for b, n in ((1, "one"), (2, "two"), (4, "four"))])
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_compact(names), "|").alias("flags"))


@register("a37_tree_check", "WITH n AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, (SELECT count(*) FROM nation) // 5 AS v FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CASE WHEN n_nationkey > 20 THEN 2 WHEN n_nationkey = 7 THEN 0 ELSE 1 END FROM nation), k AS (SELECT parent, sum(v) AS c FROM n WHERE parent IS NOT NULL GROUP BY 1) SELECT node AS parent, v AS own, c::BIGINT AS children, CASE WHEN v = c THEN 'whole' WHEN v > c THEN 'short' ELSE 'over' END AS state FROM n JOIN k ON n.node = k.parent")
def a37_tree_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    size = n.agg(F.floor(F.count("*") / 5).alias("v"))  # one row
    top = table(spark, sf_dir, "region").crossJoin(F.broadcast(size)).select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.lit(None).cast("string").alias("parent"), "v")
    low = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.when(F.col("n_nationkey") > 20, 2).when(F.col("n_nationkey") == 7, 0).otherwise(1).cast("long").alias("v"))
    return aggregates.tree_check(top.unionByName(low), "node", "parent", "v")


@register("a38_revisions", "SELECT a.l_orderkey AS k, a.l_returnflag AS latest, string_agg(DISTINCT b.l_returnflag, ',' ORDER BY b.l_returnflag) AS others FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag IS DISTINCT FROM b.l_returnflag WHERE a.l_linenumber = 1 GROUP BY 1, 2")
def a38_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir)
    latest = l.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("latest"))
    other = l.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("o")).distinct()
    return latest.join(other, "k").filter(~F.col("latest").eqNullSafe(F.col("o"))).groupBy("k", "latest").agg(F.array_join(F.sort_array(F.collect_set("o")), ",").alias("others"))


@register("a39_two_levels", "WITH a AS (SELECT n_regionkey AS firm, c_nationkey AS attorney, count(DISTINCT c_custkey) AS parties, bool_or(c_acctbal > 9900) AS active FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT firm, count(*) AS attorneys, sum(parties)::BIGINT AS parties, bool_or(active) AS active FROM a GROUP BY 1")
def a39_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("firm"), "c_nationkey").agg(F.countDistinct("c_custkey").alias("p"), F.bool_or(F.col("c_acctbal") > 9900).alias("a"))
    return a.groupBy("firm").agg(F.count("*").alias("attorneys"), F.sum("p").alias("parties"), F.bool_or("a").alias("active"))


@register("a41_validity", "SELECT count(*) AS rows, count(*) FILTER (l_shipdate < o_orderdate) AS before_order, count(*) FILTER (o_orderkey IS NULL) AS orphans, count(*) FILTER (l_discount NOT BETWEEN 0 AND 0.1) AS odd_discount FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def a41_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = _lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return l.agg(F.count("*").alias("rows"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("before_order"), F.count_if(F.col("o_orderkey").isNull()).alias("orphans"), F.count_if(~F.col("l_discount").between(0, 0.1)).alias("odd_discount"))
