"""Join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.dates import month_index
from tabulon.operators import joins
from tabulon.plans.registry import register
from tabulon.sources.tables import table


@register("j1_inner", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def j1_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))


@register("j2_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders, max(o_totalprice) AS largest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j2_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer without orders has 0 of them, but no largest order: null, not 0."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("largest"))
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "largest")


@register("j3_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 3000 GROUP BY 1) b ON a.k = b.k")
def j3_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@register("j4_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j4_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@register("j5_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j5_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@register("j6_one_row", "WITH p AS (SELECT max(o_orderdate)::DATE AS latest FROM orders) SELECT o_orderkey FROM orders, p WHERE o_orderdate::DATE > latest - 30")
def j6_one_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    latest = o.agg(F.to_date(F.max("o_orderdate")).alias("latest"))  # one row
    return o.crossJoin(F.broadcast(latest)).filter(F.to_date("o_orderdate") > F.date_sub("latest", 30)).select("o_orderkey")


@register("j7_unnest", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def j7_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("j8_unnest_outer", "SELECT p_partkey, w FROM part LEFT JOIN LATERAL (SELECT unnest(list_filter(string_split(p_name, ' '), lambda x: length(x) > 6)) AS w) t ON true")
def j8_unnest_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.explode_outer(F.filter(F.split("p_name", " "), lambda x: F.length(x) > 6)).alias("w"))


_KINDS = "(VALUES ('first', '^[12]-'), ('middle', '^3-'), ('low', '-.*LOW'), ('any', 'S'))"


@register("j9_regex_join", f"SELECT kind, count(*) AS n FROM orders JOIN {_KINDS} k(kind, re) ON regexp_matches(o_orderpriority, re) GROUP BY 1")
def j9_regex_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns are literals of the plan, four rows, so their broadcast has a fixed size; values are grouped first."""
    values = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    kinds = spark.sql(f"SELECT * FROM {_KINDS} k(kind, re)")
    return values.join(F.broadcast(kinds), F.expr("o_orderpriority rlike re")).groupBy("kind").agg(F.sum("n").alias("n"))


@register("j10_null_tolerant", "WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS court FROM customer), b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 > 0 THEN s_nationkey END AS court FROM supplier) SELECT a.k, a.court, b.court AS right_court FROM a JOIN b ON a.k = b.k AND (a.court = b.court OR a.court IS NULL OR b.court IS NULL)")
def j10_null_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")).alias("court"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_nationkey")).alias("court"))
    return joins.null_tolerant(a, b, "k", "court")


@register("j11_partner_series", "SELECT year(o_orderdate)::INT AS y, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def j11_partner_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("y")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).select("y", *[F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("F", "O", "P")])


@register("j12_linked_gap", """SELECT o_orderkey, CASE WHEN s IS NULL THEN 'no link' WHEN s < o_orderdate::DATE THEN 'before' WHEN s <= o_orderdate::DATE + 365 THEN 'within a year' ELSE 'later' END AS gap
    FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate)::DATE AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def j12_linked_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("s"))
    d = F.datediff("s", F.to_date("o_orderdate"))
    gap = F.when(F.col("s").isNull(), "no link").when(d < 0, "before").when(d <= 365, "within a year").otherwise("later")
    return table(spark, sf_dir, "orders").join(s, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", gap.alias("gap"))


@register("j13_as_of", """SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'""")
def j13_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_purchase"))
    return joins.as_of(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@register("j13_first_after", """SELECT e.event_id, p.ts AS next_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts <= p.ts WHERE e.event_type = 'error'""")
def j13_first_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bought = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    return joins.first_after_by_union(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "bought", "next_purchase").select("event_id", "next_purchase")


_MONTHS = "year({0}) * 12 + month({0}) - 1"


@register("j14_month_window", f"""SELECT a.c AS c, a.m AS m, count(*) AS near FROM (SELECT DISTINCT o_custkey AS c, {_MONTHS.format('o_orderdate')} AS m FROM orders WHERE o_orderstatus = 'P') a
    JOIN (SELECT o_custkey AS c, {_MONTHS.format('o_orderdate')} AS m FROM orders) b ON a.c = b.c AND abs(a.m - b.m) <= 12 GROUP BY 1, 2""")
def j14_month_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), month_index("o_orderdate").alias("m"), "o_orderstatus")
    a = o.filter("o_orderstatus = 'P'").select("c", "m").distinct()
    return joins.within_months(a, o.select("c", F.col("m").alias("other")), "c", "m", "other", 12).groupBy("c", "m").agg(F.count("*").alias("near"))


@register("j15_valid_at", "SELECT l_suppkey, count(*) AS open FROM (SELECT l_suppkey, l_shipdate AS s, CASE WHEN l_returnflag <> 'N' THEN l_shipdate + to_days(l_quantity::INT) END AS e FROM lineitem) WHERE s <= TIMESTAMP '1998-01-01' AND (e IS NULL OR e > TIMESTAMP '1998-01-01') GROUP BY 1")
def j15_valid_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("s"), F.when(F.col("l_returnflag") != "N", F.date_add(F.to_date("l_shipdate"), F.col("l_quantity").cast("int"))).alias("e"))
    return joins.valid_at(l, "s", "e", F.lit("1998-01-01").cast("date")).groupBy("l_suppkey").agg(F.count("*").alias("open"))


@register("j16_unique_match", "SELECT p_partkey, CASE WHEN n = 1 THEN k END AS supplier, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS match_status FROM part LEFT JOIN (SELECT s_nationkey + 1 AS size, count(*) AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1) ON size = p_size")
def j16_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 1).alias("p_size"), "s_suppkey")
    return joins.unique_match(table(spark, sf_dir, "part").select("p_partkey", "p_size"), s, "p_size", "s_suppkey", "supplier").select("p_partkey", "supplier", "match_status")


@register("j17_exploded_keys", "SELECT coalesce(n_name, '(unmatched)') AS nation, count(*) AS n FROM (SELECT unnest(list_distinct([c_nationkey, (c_custkey % 30)::INT])) AS k FROM customer) LEFT JOIN nation ON n_nationkey = k GROUP BY 1")
def j17_exploded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.explode(F.array_distinct(F.array("c_nationkey", (F.col("c_custkey") % 30).cast("int")))).alias("k"))
    return k.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"), "left").groupBy(F.coalesce("n_name", F.lit("(unmatched)")).alias("nation")).agg(F.count("*").alias("n"))


@register("j18_parsed_key", "SELECT regexp_extract(c_name, '#0*([0-9]+)$', 1)::BIGINT AS k, s_name FROM customer JOIN supplier ON regexp_extract(c_name, '#0*([0-9]+)$', 1) = regexp_extract(s_name, '#0*([0-9]+)$', 1) WHERE regexp_extract(c_name, '#0*([0-9]+)$', 1) <> ''")
def j18_parsed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    def key(c: str):
        return F.nullif(F.regexp_extract(c, "#0*([0-9]+)$", 1), F.lit("")).alias("key")

    c, s = table(spark, sf_dir, "customer").select(key("c_name")), table(spark, sf_dir, "supplier").select("s_name", key("s_name"))
    return c.join(s, "key").select(F.col("key").cast("long").alias("k"), "s_name")


@register("j19_lookup", "SELECT r_name, sum(o_totalprice)::BIGINT AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j19_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.groupBy("r_name").agg(F.round(F.sum("o_totalprice")).cast("long").alias("total"))


@register("j20_routed_key", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^Brand#1') THEN 'by size' WHEN regexp_matches(p_brand, '^Brand#[23]') THEN 'by type' END AS route, CASE WHEN regexp_matches(p_brand, '^Brand#1') THEN 'S' || p_size WHEN regexp_matches(p_brand, '^Brand#[23]') THEN 'T' || split_part(p_type, ' ', 1) END AS target FROM part")
def j20_routed_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("p_brand")
    size, kind = b.rlike("^Brand#1"), b.rlike("^Brand#[23]")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(size, "by size").when(kind, "by type").alias("route"), F.when(size, F.concat(F.lit("S"), F.col("p_size").cast("string"))).when(kind, F.concat(F.lit("T"), F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("target"))


@register("j21_with_unmatched", "SELECT p_brand, count(*) AS parts, count(n) AS sold_parts, count(*) - count(n) AS unsold, coalesce(sum(n), 0)::BIGINT AS line_items FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def j21_with_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").join(l, F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.groupBy("p_brand").agg(F.count("*").alias("parts"), F.count("n").alias("sold_parts"), F.count_if(F.col("n").isNull()).alias("unsold"), F.coalesce(F.sum("n"), F.lit(0)).alias("line_items"))


@register("j22_two_hops", "SELECT r_name, count(*) AS customers, count(*) FILTER (s IS NULL) AS without_supplier, round(sum(s), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) AS s FROM supplier WHERE s_acctbal > 6000 GROUP BY 1) ON s_nationkey = n_nationkey GROUP BY 1")
def j22_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").filter("s_acctbal > 6000").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("s"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("customers"), F.count_if(F.col("s").isNull()).alias("without_supplier"), F.round(F.sum("s"), 2).alias("balance"))


@register("j24_paired_metrics", "WITH f AS (SELECT c_nationkey AS e, 'balance' AS m, avg(c_acctbal) AS v FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 'spend', avg(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT a.e AS nation, round(a.v, 4) AS balance, round(b.v, 4) AS spend FROM f a JOIN f b ON a.e = b.e WHERE a.m = 'balance' AND b.m = 'spend'")
def j24_paired_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = c.groupBy(F.col("c_nationkey").alias("e")).agg(F.avg("c_acctbal").alias("v")).withColumn("m", F.lit("balance"))
    b = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("e")).agg(F.avg("o_totalprice").alias("v")).withColumn("m", F.lit("spend"))
    facts = a.unionByName(b)
    wide = facts.groupBy("e").pivot("m", ["balance", "spend"]).agg(F.first("v")).dropna()
    return wide.select(F.col("e").alias("nation"), F.round("balance", 4).alias("balance"), F.round("spend", 4).alias("spend"))


@register("j25_neighbours", "WITH e AS (SELECT l_orderkey AS src, l_suppkey AS dst, l_returnflag AS kind FROM lineitem), b AS (SELECT src AS node, kind, 'out' AS direction, dst AS o FROM e UNION ALL SELECT dst, kind, 'in', src FROM e) SELECT node, kind, direction, count(DISTINCT o) AS n FROM b GROUP BY 1, 2, 3")
def j25_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"))
    return joins.neighbours(e)


@register("j26_path_check", "WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, bool_and(role IS DISTINCT FROM before) AS alternates FROM t GROUP BY 1")
def j26_path_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("ok", ~F.col("role").eqNullSafe(before)).groupBy("conv_id").agg(F.bool_and("ok").alias("alternates"))


@register("j26_cited_paths", """WITH n AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos, l_partkey AS node, l_suppkey % 2 AS turn, l_quantity > 48 AS torn, l_discount < 0.1 AS visible FROM lineitem),
    e AS (SELECT path, pos, node AS a, lead(node) OVER w AS b, turn, torn AND node <> lead(node) OVER w AS torn, visible, l FROM (SELECT *, count(*) OVER (PARTITION BY path) - 1 AS l FROM n) WINDOW w AS (PARTITION BY path ORDER BY pos)),
    j AS (SELECT path, count(*) AS nodes, bool_or(torn AND pos < l) AS torn, bool_and(visible OR pos = l) AS visible, path % 10 = 0 AND count(*) > 1 AS short, string_agg(CASE WHEN pos < l THEN 'cites' || CASE WHEN turn = 1 AND a <> b THEN '<' ELSE '>' END || b END, ' ' ORDER BY pos) AS steps, min(a) FILTER (pos = 0) AS first FROM e GROUP BY path)
    SELECT path, nodes, CASE WHEN short THEN 'count' WHEN torn THEN 'disconnected' WHEN NOT visible THEN 'hidden' END AS problem, CASE WHEN NOT short AND NOT coalesce(torn, false) AND visible THEN first || coalesce(' ' || steps, '') END AS shown FROM j""")
def j26_cited_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an order as a path: some edges point back, some join nothing, some are hidden, some are missing."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("path").orderBy("l_linenumber", "node", "l_suppkey")
    n = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_orderkey": "path", "l_partkey": "node"}).withColumn("pos", F.row_number().over(w) - 1).withColumn("b", F.lead("node").over(w))
    turn, torn = F.col("l_suppkey") % 2 == 1, (F.col("l_quantity") > 48) & (F.col("node") != F.col("b"))
    src, dst = F.when(turn, F.col("b")).otherwise(F.col("node")), F.when(turn, F.col("node")).otherwise(F.col("b"))
    e = n.filter("b IS NOT NULL").select("path", "pos", src.alias("src"), F.when(torn, F.lit(-1)).otherwise(dst).alias("dst"), F.lit("cites").alias("kind"), (F.col("l_discount") < 0.1).alias("visible"))
    return joins.cited_paths(n.select("path", "pos", "node"), e.filter("path % 10 > 0 OR pos > 0"))


@register("j27_together", "WITH i AS (SELECT DISTINCT l_orderkey AS g, l_suppkey AS i FROM lineitem) SELECT x.i AS a, y.i AS b, count(*) AS n FROM i x JOIN i y ON x.g = y.g AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 20")
def j27_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.together(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 20)


@register("j29_alias_join", "SELECT n_name, count(*) AS n FROM (SELECT n_nationkey, n_name, unnest(list_distinct([n_name, upper(n_name), 'The ' || n_name])) AS alias FROM nation) JOIN (SELECT CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN upper(n_name) ELSE 'The ' || n_name END AS said FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON alias = said GROUP BY 1")
def j29_alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    aliases = n.select("n_name", F.explode(F.array_distinct(F.array("n_name", F.upper("n_name"), F.concat(F.lit("The "), "n_name")))).alias("alias"))
    third = F.col("s_suppkey") % 3
    said = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.when(third == 0, F.col("n_name")).when(third == 1, F.upper("n_name")).otherwise(F.concat(F.lit("The "), "n_name")).alias("said"))
    return aliases.join(said, F.col("alias") == F.col("said")).groupBy("n_name").agg(F.count("*").alias("n"))


@register("j30_close_spellings", "WITH w AS (SELECT DISTINCT p_name AS w FROM part) SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w)::INT AS distance FROM w a JOIN w b ON a.w < b.w AND levenshtein(a.w, b.w) <= 2")
def j30_close_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole names of all parts."""
    return joins.close_spellings(table(spark, sf_dir, "part"), "p_name", 2)


@register("j30_all_close_spellings", "WITH w AS (SELECT DISTINCT string_split(p_name, ' ')[1] || substr(p_brand, 7, 1) AS w FROM part) SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w)::INT AS distance FROM w a JOIN w b ON a.w < b.w AND levenshtein(a.w, b.w) <= 2")
def j30_all_close_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all parts."""
    w = table(spark, sf_dir, "part").select(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.substring("p_brand", 7, 1)).alias("w"))
    return joins.close_spellings(w, "w", 2)


@register("j31_changes", "WITH h AS (SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_custkey % 5 > 0), o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS b FROM customer WHERE c_custkey % 3 > 0) SELECT coalesce(h.k, o.k) AS k, CASE WHEN h.k IS NULL THEN 'insert' WHEN o.k IS NULL THEN 'gone' WHEN h.b = o.b THEN 'unchanged' ELSE 'update' END AS change FROM h FULL JOIN o ON h.k = o.k")
def j31_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b"))
    return joins.changes(c.filter("k % 5 > 0"), c.filter("k % 3 > 0").withColumn("b", F.when(F.col("k") % 7 == 0, F.col("b") + 1).otherwise(F.col("b"))), "k", ["b"])


@register("j32_recursive_fold", "SELECT p_partkey, replace(replace(replace(lower(p_name), 'a', 'e'), 'e', 'i'), 'i', 'o') AS name FROM part")
def j32_recursive_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (("a", "e"), ("e", "i"), ("i", "o"))])
    return table(spark, sf_dir, "part").select("p_partkey", F.aggregate(steps, F.lower("p_name"), lambda s, r: F.replace(s, r["a"], r["b"])).alias("name"))


@register("j33_ancestors", "WITH RECURSIVE e AS (SELECT s_suppkey AS node, s_suppkey // 2 AS parent FROM supplier WHERE s_suppkey > 1), r AS (SELECT node, parent AS ancestor, 1 AS steps FROM e UNION ALL SELECT r.node, e.parent, steps + 1 FROM r JOIN e ON r.ancestor = e.node) SELECT node, ancestor, steps FROM r")
def j33_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "supplier").filter("s_suppkey > 1").select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_suppkey") / 2).alias("parent"))
    return joins.ancestors(e, "node", "parent")


@register("j34_name_lookup", r"WITH n AS (SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM supplier), q AS (SELECT c_custkey, 'supplier ' || lpad((c_custkey % 150)::VARCHAR, 9, '0') AS key FROM customer) SELECT c_custkey, CASE WHEN count(s_suppkey) = 0 THEN 'none' WHEN count(s_suppkey) > 1 THEN 'ambiguous' ELSE 'matched' END AS state FROM q LEFT JOIN n ON n.key = q.key GROUP BY 1")
def j34_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabulon.functions.text import plain_key

    names = table(spark, sf_dir, "supplier").select("s_suppkey", plain_key("s_name").alias("key"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("supplier "), F.lpad((F.col("c_custkey") % 150).cast("string"), 9, "0")).alias("key"))
    found = joins.unique_match(asked, names, "key", "s_suppkey", "supplier")
    return found.select("c_custkey", F.when(F.col("match_status") == "unmatched", "none").otherwise(F.col("match_status")).alias("state"))
