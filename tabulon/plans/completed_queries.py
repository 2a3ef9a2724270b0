"""Sources, guards, series, accumulators, queues and statistics that complete the families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabulon.functions import json_paths
from tabulon.operators import aggregates, filters, ranking, series, statistics
from tabulon.operators.accumulators import Accumulator
from tabulon.operators.filters import RecordFilter
from tabulon.plans.registry import register
from tabulon.sources import files, readers
from tabulon.sources.scratch import fresh_path
from tabulon.sources.tables import table
from tabulon.streaming import cdc

_M = "m AS (SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS v FROM orders GROUP BY 1, 2)"


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("month")).agg(F.count("*").alias("v"))


# sources and sinks


@register("s3_pruned_csv", "SELECT c_mktsegment, count(*) AS orders, round(sum(c_acctbal), 2) AS balance FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def s3_pruned_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a wide CSV only three columns are parsed, then joined."""
    path, c = fresh_path(spark, "csv"), table(spark, sf_dir, "customer")
    c.write.option("header", True).csv(path)
    rows = files.read_csv(spark, path, c.schema).select("c_custkey", "c_mktsegment", "c_acctbal")
    return table(spark, sf_dir, "orders").join(rows, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def _broken_tsv(spark: SparkSession, sf_dir: str):
    """A file whose records hold tabs or line feeds in their narratives, are broken over two or three lines, or are beyond
    repair."""
    path = fresh_path(spark, "tsv")
    tail = "concat('\\t', p_size, '\\t', p_partkey)"
    line = F.expr(f"""CASE p_partkey % 6 WHEN 0 THEN concat(p_partkey, '\\t', p_name, '\\t', p_type, {tail}) WHEN 1 THEN concat(p_partkey, '\\t', p_name, '\\r\\n', p_type, {tail})
        WHEN 2 THEN concat(p_partkey, '\\t', p_name, '\\n', p_type, {tail}) WHEN 3 THEN concat(p_partkey, '\\t', p_name, '\\t\\r\\n', p_size, '\\r\\n\\t', p_partkey)
        WHEN 4 THEN concat('torn\\t', p_name, '\\r\\n', p_partkey, '\\t', p_name, {tail}) ELSE concat(p_partkey, '\\t', p_name, {tail}) END""")
    table(spark, sf_dir, "part").select(line.alias("value")).write.option("lineSep", "\r\n").text(path)
    return files.read_repaired_tsv(spark, path, ["id", "narrative", "size", "again"], "narrative")


@register("s4_repaired_tsv", "SELECT p_partkey::VARCHAR AS id, CASE p_partkey % 6 WHEN 0 THEN p_name || chr(9) || p_type WHEN 1 THEN p_name || p_type WHEN 2 THEN p_name || chr(10) || p_type ELSE p_name END AS narrative, p_size::VARCHAR AS size, p_partkey::VARCHAR AS again FROM part WHERE p_partkey % 6 <> 4")
def s4_repaired_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken_tsv(spark, sf_dir)[0]


@register("s4_repair_counts", "SELECT CASE p_partkey % 6 WHEN 0 THEN 'merged' WHEN 1 THEN 'rejoined' WHEN 3 THEN 'rejoined' WHEN 4 THEN 'fragment' ELSE 'whole' END AS kind, count(*) AS n FROM part GROUP BY 1")
def s4_repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken_tsv(spark, sf_dir)[1]


@register("s7_xml", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s7_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, s = fresh_path(spark, "xml"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    s.write.format("xml").option("rowTag", "supplier").save(path)
    return files.read_xml(spark, path, "supplier", s.schema)


@register("s11_fixed_windows", "SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS page, o_orderkey FROM orders")
def s11_fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_windows(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, 10**12)


@register("s12_filtered_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'")
def s12_filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = RecordFilter(datasets=("F", "P"), ranges={"o_orderdate": ("1996-01-01", "1998-12-31")})
    return filters.keep(table(spark, sf_dir, "orders"), wanted, dataset="o_orderstatus", id_col="o_orderkey").agg(F.count("*").alias("n"))


@register("s13_paged_fetch", "SELECT page, count(*) AS rows, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 1000 AS page FROM customer) GROUP BY 1")
def s13_paged_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    paged = files.read_windows(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 1000, 10**12)
    return paged.groupBy("page").agg(F.count("*").alias("rows"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


_HALF = "list_transform(embedding, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x::DOUBLE / power(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10), 0) * power(2.0, greatest(floor(log2(abs(x::DOUBLE))), -14) - 10) END)"


@register("s16_half_vectors", f"SELECT vec_id, round(list_sum({_HALF}), 5) AS total, round(list_max({_HALF}), 6) AS largest FROM embeddings")
def s16_half_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as 16-bit floats with a digest, read back and checked."""
    path = fresh_path(spark, "half")
    files.write_half_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    v = files.read_half_vectors(spark, path, "vec_id")
    return v.select("vec_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), F.round(F.array_max("vector").cast("double"), 6).alias("largest"))


@register("f24_half_rounding", f"SELECT vec_id, array_to_string(list_transform(({_HALF})[1:4], lambda x: (x * 16777216)::BIGINT::VARCHAR), ' ') AS head FROM embeddings")
def f24_half_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded to 16-bit floats by column arithmetic, half to even, subnormal ones included; given in units of 2 ** -24."""
    def half(x):
        d = x.cast("double")
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(d))), F.lit(-14)) - 10)
        return F.when(d == 0, 0.0).otherwise(F.rint(d / step) * step)

    head = F.transform(F.slice("embedding", 1, 4), lambda x: (half(x) * 16777216).cast("long").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(head, " ").alias("head"))


@register("s18_inline_values", "SELECT a.kind AS kind, count(*) AS n FROM orders JOIN (VALUES ('O', 'open'), ('F', 'done'), ('P', 'held')) a(code, kind) ON o_orderstatus = a.code GROUP BY 1")
def s18_inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.sql("SELECT * FROM VALUES ('O', 'open'), ('F', 'done'), ('P', 'held') a(code, kind)")
    return table(spark, sf_dir, "orders").join(F.broadcast(kinds), F.col("o_orderstatus") == F.col("code")).groupBy("kind").agg(F.count("*").alias("n"))


@register("k1_publish", "SELECT s_suppkey, s_name FROM supplier")
def k1_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published twice: the second set of rows takes the first one's place."""
    path, s = fresh_path(spark, "published"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    files.publish(s.filter("s_suppkey % 2 = 0"), path, "s_suppkey")
    files.publish(s, path, "s_suppkey")
    return spark.read.schema(s.schema).parquet(path)


@register("k2_append", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'first' ELSE 'second' END AS lot FROM supplier")
def k2_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are held already are not added again."""
    path, s = fresh_path(spark, "published"), table(spark, sf_dir, "supplier").select("s_suppkey")
    first = s.filter("s_suppkey % 3 = 0").withColumn("lot", F.lit("first"))
    before = files.publish(first, path, "s_suppkey")["rows"]
    files.publish_more(s.withColumn("lot", F.lit("second")), path, "s_suppkey", before)
    return spark.read.parquet(path)


@register("k3_upsert_batches", "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders), p AS (SELECT o_orderkey, n // 500 AS b, n % 500 // 120 AS p FROM n) SELECT o_orderkey, dense_rank() OVER (ORDER BY b, p) - 1 AS batch FROM p")
def k3_upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 rows at most, and as many bytes as 120 of these rows of one length take."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("key"))
    size = len('{"key":"000000000000"}') + 1
    rows = files.upsert_batches(o.select("key"), "key", 500, 2 + 120 * size)
    return rows.select(F.col("key").cast("long").alias("o_orderkey"), "batch")


@register("k4_copy_export", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'C:' || chr(92) || 'temp' || chr(9) || c_name END AS note FROM customer")
def k4_copy_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "copy")
    note = F.expr(r"CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('C:\\temp', '\t', c_name) END")
    files.write_copy_text(table(spark, sf_dir, "customer").select("c_custkey", note.alias("note")), path)
    return files.read_copy_text(spark, path, T.StructType.fromDDL("c_custkey long, note string"))[0]


# filters and guards


@register("p2_membership", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def p2_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No dataset named: all of them."""
    return filters.keep(table(spark, sf_dir, "orders"), RecordFilter(), dataset="o_orderstatus").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@register("p3_json_facets", "SELECT event_id FROM events WHERE (props ->> '$.k')::INT IN (1, 5, 9, 40) AND event_type IN ('click', 'error')")
def p3_json_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets in JSON: a number that is one of four, and an array that holds one of two values."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(k.alias("k"), F.array("event_type", F.lit("any")).alias("kinds"))).alias("facets"))
    return e.filter(json_paths.json_facets("facets", {"k": [1, 5, 9, 40], "kinds": ["click", "error"]})).select("event_id")


@register("p4_contains", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'wid')")
def p4_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep(table(spark, sf_dir, "part"), RecordFilter(contains={"p_name": "WiD"})).select("p_partkey")


@register("p7_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-02-01' AND o_orderdate < TIMESTAMP '1997-03-01'")
def p7_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.keep(table(spark, sf_dir, "orders"), RecordFilter(ranges={"o_orderdate": ("1997-02-01", "1997-02-28")})).select("o_orderkey")


@register("p12_typed_guards", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 3 > 0 THEN year(o_orderdate)::INT END AS year FROM orders")
def p12_typed_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("CASE o_orderkey % 5 WHEN 0 THEN CAST(o_totalprice AS STRING) WHEN 1 THEN concat(' ', CAST(o_totalprice AS STRING)) WHEN 2 THEN concat('-', CAST(o_totalprice AS STRING)) WHEN 3 THEN 'abc' END")
    d = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN concat(year(o_orderdate), '-02-30') WHEN 2 THEN date_format(o_orderdate, 'yyyy-M-d x') END")
    y = F.expr("CASE WHEN o_orderkey % 3 > 0 THEN CAST(year(o_orderdate) AS STRING) ELSE CAST(year(o_orderdate) + 1000 AS STRING) END")
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.number_guard(n, 0).alias("amount"), F.date_format(filters.date_guard(d), "yyyy-MM-dd").alias("day"), filters.year_guard(y).alias("year"))


@register("p16_pruned_fields", "SELECT o_orderkey AS key, o_custkey AS buyer, year(o_orderdate)::INT AS year FROM orders")
def p16_pruned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of nested records; the scan reads no others."""
    path = fresh_path(spark, "nested")
    o = table(spark, sf_dir, "orders")
    o.select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("note")).alias("buyer"), F.struct(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).alias("filed")).alias("record")).write.parquet(path)
    kept = json_paths.projected(spark.read.parquet(path), ["record.key", "record.buyer.id", "record.filed.year"])
    return kept.select(F.col("record.key").alias("key"), F.col("record.buyer.id").alias("buyer"), F.col("record.filed.year").alias("year"))


@register("p17_masked_paths", """SELECT o_orderkey, sha256('{"at":"<masked>","lines":[{"by":"' || o_orderpriority || '","when":"<masked>"},{"by":"' || o_orderstatus || '","when":"<masked>"}]}') AS digest FROM orders""")
def p17_masked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records compared without the fields that change at every reading."""
    day = F.col("o_orderdate").cast("string")
    r = F.struct(day.alias("at"), F.array(F.struct(F.col("o_orderpriority").alias("by"), day.alias("when")), F.struct(F.col("o_orderstatus").alias("by"), day.alias("when"))).alias("lines"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r"))
    kind = o.schema["r"].dataType
    once = o.withColumn("r", json_paths.masked(F.col("r"), kind, ["at"]))
    twice = once.withColumn("r", json_paths.masked(F.col("r"), kind, ["lines", "*", "when"]))
    return twice.select("o_orderkey", F.sha2(F.to_json("r"), 256).alias("digest"))


@register("f19_json_diff", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '$.k' WHEN 2 THEN '$.u.list[1],$.u.more' ELSE '$.u.list' END AS paths FROM events")
def f19_json_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths at which an event's record and a later one differ: none, a value, an element and a new field, a longer list."""
    k = F.get_json_object("props", "$.k")
    e = table(spark, sf_dir, "events").withColumn("k", k.cast("int"))
    e = e.withColumn("old", F.expr("concat('{\"k\":', k, ',\"u\":{\"list\":[1,', user_id, ']}}')"))
    e = e.withColumn("new", F.expr("CASE event_id % 4 WHEN 0 THEN concat('{\"u\":{\"list\":[1,', user_id, ']},\"k\":', k, '}') WHEN 1 THEN concat('{\"k\":', k + 1000, ',\"u\":{\"list\":[1,', user_id, ']}}') WHEN 2 THEN concat('{\"k\":', k, ',\"u\":{\"list\":[1,', user_id + 1000, '],\"more\":null}}') ELSE concat('{\"k\":', k, ',\"u\":{\"list\":[1]}}') END"))
    return json_paths.with_differences(e.select("event_id", "old", "new"), "old", "new").select("event_id", F.array_join("paths", ",").alias("paths"))


# aggregates


@register("a12_median", "SELECT l_returnflag, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY 1")
def a12_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", {"med": 0.5}).withColumn("med", F.round("med", 4))


@register("a34_tiers", "WITH k AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_nationkey < 10 THEN 2 ELSE 3 END AS tier, c_nationkey AS court FROM customer), o AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS b, count(*) FILTER (o_orderstatus = 'P') AS e FROM orders GROUP BY 1) SELECT tier, court, count(*) AS clusters, count(*) FILTER (n > 0) AS cases, coalesce(sum(n), 0)::BIGINT AS opinions, round(coalesce(sum(b), 0), 2) AS volume, coalesce(sum(e), 0)::BIGINT AS no_text FROM k LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1, 2")
def a34_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume by tier and court: opinions are added up per cluster before clusters are."""
    tier = F.when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_nationkey") < 10, 2).otherwise(3)
    k = table(spark, sf_dir, "customer").select("c_custkey", tier.alias("tier"), F.col("c_nationkey").alias("court"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("b"), F.count_if(F.col("o_orderstatus") == "P").alias("e"))
    j = k.join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.groupBy("tier", "court").agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 0).alias("cases"), F.coalesce(F.sum("n"), F.lit(0)).alias("opinions"), F.round(F.coalesce(F.sum("b"), F.lit(0.0)), 2).alias("volume"), F.coalesce(F.sum("e"), F.lit(0)).alias("no_text"))


@register("a36_partial_final", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, max(l_quantity) AS hi FROM lineitem GROUP BY 1")
def a36_partial_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of three chunks are written apart and merged."""
    acc = Accumulator(("l_returnflag",), "l_quantity", 5.0, centre=25.0)
    path, l = fresh_path(spark, "states"), table(spark, sf_dir, "lineitem")
    for k in range(3):
        acc.states(l.filter(F.col("l_linenumber") % 3 == k)).write.mode("append").parquet(path)
    done = acc.finished(spark.read.parquet(path))
    return done.select("l_returnflag", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "hi")


@register("udf3_accumulator", "WITH h AS (SELECT event_type, floor(value / 50)::BIGINT AS b, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, b FROM h QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, b) = 1) SELECT e.event_type, count(*) AS n, min(value) AS lo, any_value(t.b) AS modal_bin FROM events e JOIN t ON t.event_type = e.event_type GROUP BY 1")
def udf3_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = Accumulator(("event_type",), "value", 50.0)
    e = table(spark, sf_dir, "events")
    states = acc.merged(acc.states(e.filter("user_id % 2 = 0")).unionByName(acc.states(e.filter("user_id % 2 = 1"))))
    return acc.finished(states).select("event_type", "n", "lo", "modal_bin")


@register("a40_watch_summary", "WITH b AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_custkey % 50 AS state, o_orderstatus AS s FROM orders WHERE o_totalprice > 200000), s AS (SELECT unnest(generate_series((SELECT min(month) FROM b), (SELECT max(month) FROM b), INTERVAL 1 MONTH))::DATE AS month) SELECT strftime(s.month, '%Y-%m') AS month, count(*) FILTER (b.s = 'F') AS enacted, count(*) FILTER (b.s IS NOT NULL AND b.s <> 'F') AS other, count(DISTINCT state) AS states, s.month >= DATE '2001-06-01' AS partial FROM s LEFT JOIN b ON b.month = s.month GROUP BY s.month")
def a40_watch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select((F.col("o_custkey") % 50).alias("state"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    w = aggregates.watch_summary(b, "state", "day", "o_orderstatus", "F", F.lit("2001-06-15").cast("date"))
    return w.select(F.date_format("month", "yyyy-MM").alias("month"), F.col("good").alias("enacted"), "other", F.col("units").alias("states"), "partial")


@register("j23_board", "WITH d AS (SELECT c_nationkey AS court, count(*) AS pending FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1), v AS (SELECT s_nationkey AS court, count(*) FILTER (s_acctbal >= 0) AS open, count(*) FILTER (s_acctbal < 0) AS announced, max(floor(abs(s_acctbal)))::BIGINT AS longest_open FROM supplier GROUP BY 1), m AS (SELECT court, months, rank() OVER (ORDER BY months DESC) AS place FROM (SELECT s_nationkey AS court, count(*) AS months FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1)) SELECT d.court AS court, pending, coalesce(open, 0)::BIGINT AS open, coalesce(announced, 0)::BIGINT AS announced, longest_open, months, place FROM d LEFT JOIN v ON v.court = d.court LEFT JOIN m ON m.court = d.court")
def j23_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courts with a load, beside each its vacancies and vacant months with a competition rank."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.groupBy(F.col("c_nationkey").alias("court")).agg(F.count("*").alias("pending"))
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "court")
    v = s.select("court", F.when(F.col("s_acctbal") >= 0, "open").otherwise("announced").alias("status"), F.floor(F.abs("s_acctbal")).alias("days"))
    m = s.filter("s_suppkey % 3 = 0").groupBy("court").agg(F.count("*").alias("months")).withColumn("place", F.rank().over(Window.orderBy(F.desc("months"))))  # one row per court
    return aggregates.board(d, v, m, "court")


# series


@register("w25_panorama", f"WITH {_M}, f AS (SELECT k, month, v FROM m WHERE v > 25), r AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i FROM (SELECT DISTINCT month FROM f)), p AS (SELECT k, i, v FROM f JOIN r USING (month)), s AS (SELECT k, min(i) AS a, max(i) AS z FROM p GROUP BY 1), e AS (SELECT k, a, z, unnest(range(a, z + 1)) AS i FROM s) SELECT e.k AS k, a AS first, z AS last, string_agg(coalesce(v::VARCHAR, '-'), ',' ORDER BY e.i) AS listed FROM e LEFT JOIN p ON p.k = e.k AND p.i = e.i GROUP BY e.k, a, z")
def w25_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series.panorama(_monthly(spark, sf_dir).filter("v > 25"), "k", "month", "v")
    return p.select("k", "first", "last", F.array_join(F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",").alias("listed"))


@register("w25_frames", "WITH d AS (SELECT year(o_orderdate)::INT AS report, c_nationkey AS place, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT report, place, value, round(value / sum(value) OVER (PARTITION BY report), 6) AS share FROM d")
def w25_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.groupBy(F.year("o_orderdate").alias("report"), F.col("c_nationkey").alias("place")).agg(F.count("*").alias("n"))
    return series.report_frames(d, "report", "place", "n").withColumn("share", F.round("share", 6))


_PLACED = f"{_M}, p AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY month) - 1 AS i, CASE WHEN v % 4 > 0 THEN v END AS v, v % 5 = 0 AS part, CASE WHEN v % 3 > 0 THEN v / 10.0 END AS moe FROM m)"


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    m = _monthly(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("month")) - 1)  # a row per month
    return m.select("k", "i", F.when(v % 4 > 0, v).alias("v"), (v % 5 == 0).alias("part"), F.when(v % 3 > 0, v / 10.0).alias("moe"))


@register("w31_segments", f"WITH {_PLACED}, n AS (SELECT *, lead(v) OVER w AS nv, lead(part) OVER w AS np, lag(v) OVER w AS bv FROM p WINDOW w AS (PARTITION BY k ORDER BY i)), e AS (SELECT k, i, part OR np AS dashed FROM n WHERE v IS NOT NULL AND nv IS NOT NULL), g AS (SELECT *, i - row_number() OVER (PARTITION BY k, dashed ORDER BY i) AS grp FROM e) SELECT k, CASE WHEN dashed THEN 'dashed' ELSE 'solid' END AS kind, min(i) AS first, max(i) + 1 AS last FROM g GROUP BY k, dashed, grp UNION ALL SELECT k, 'dot', i, i FROM n WHERE v IS NOT NULL AND nv IS NULL AND bv IS NULL")
def w31_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.line_segments(_placed(spark, sf_dir), ["k"], "i", "v", "part")


@register("w31_margin_runs", f"WITH {_PLACED}, g AS (SELECT *, i - row_number() OVER (PARTITION BY k ORDER BY i) AS grp FROM p WHERE v IS NOT NULL AND moe IS NOT NULL) SELECT k, min(i) AS first, max(i) AS last, round(min(v - moe), 6) AS lowest, round(max(v + moe), 6) AS highest FROM g GROUP BY k, grp")
def w31_margin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = series.margin_runs(_placed(spark, sf_dir), ["k"], "i", "v", "moe")
    return r.select("k", "first", "last", F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"))


@register("w34_change_radar", "WITH v AS (SELECT p_brand AS part, p_partkey AS s, l_shipdate::DATE AS d, l_returnflag <> 'N' AND l_shipdate >= TIMESTAMP '1997-01-01' AS ok FROM part LEFT JOIN lineitem ON l_partkey = p_partkey) SELECT part, count(DISTINCT s) AS sections, count(DISTINCT s) FILTER (ok) AS changed, count(*) FILTER (ok) AS changes, strftime(max(d) FILTER (ok), '%Y-%m-%d') AS latest, count(DISTINCT s) FILTER (ok AND d > DATE '1999-06-30' AND d <= DATE '2000-06-30') AS last12_sections, count(*) FILTER (ok AND d > DATE '1999-06-30' AND d <= DATE '2000-06-30') AS last12_changes FROM v GROUP BY 1")
def w34_change_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sections with their versions; substantive ones since 1997 count."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_list(F.struct(F.to_date("l_shipdate").alias("date"), (F.col("l_returnflag") != "N").alias("substantive"))).alias("versions"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(v, "p_partkey", "left").withColumn("versions", F.coalesce("versions", F.array().cast("array<struct<date:date,substantive:boolean>>")))
    r = series.change_radar(p, "p_brand", "p_partkey", "versions", F.lit("2000-06-30").cast("date"), F.lit("1997-01-01").cast("date"))
    return r.withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


# statistics without a statement: seeded or iterative


@register("n5_permutation_p")
def n5_permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"), F.count("*").alias("n"))
    return statistics.permutation_p(c.withColumn("all", F.lit("all")), ["all"], "balance", "n", 200, 1019)


@register("n10_clusters")
def n10_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    found, score = statistics.clustered(statistics.standardised(p, ["p_size", "p_retailprice"]), "p_partkey", ["p_size", "p_retailprice"], 4)
    return found.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("silhouette", F.lit(round(score, 6)))


@register("n11_loess")
def n11_loess(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _monthly(spark, sf_dir).withColumn("x", F.year("month") * 12 + F.month("month"))
    return statistics.loess_band(m, ["k"], "x", "v")


@register("n15_family", """WITH c AS (SELECT o_custkey, count(*)::DOUBLE AS n, sum(o_totalprice) AS total, max(o_totalprice) AS largest, any_value(c_acctbal) AS c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    l AS (SELECT 'n' AS y, total AS x, n AS v FROM c UNION ALL SELECT 'largest', total, largest FROM c UNION ALL SELECT 'c_acctbal', total, c_acctbal FROM c),
    r AS (SELECT y, rank() OVER (PARTITION BY y ORDER BY x) + (count(*) OVER (PARTITION BY y, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY y ORDER BY v) + (count(*) OVER (PARTITION BY y, v) - 1) / 2.0 AS rv FROM l),
    k AS (SELECT y, count(*) AS n, corr(rx, rv) AS rho FROM r GROUP BY y), t AS (SELECT *, n - 2 AS f, atan(rho / sqrt(1 - rho * rho)) AS th FROM k),
    s AS (SELECT *, coalesce(list_sum(list_transform(range(0, f // 2), lambda j: exp(2 * j * ln(cos(th)) + coalesce(list_sum(list_transform(range(1, j + 1), lambda i: CASE WHEN f % 2 = 1 THEN ln(2.0 * i / (2 * i + 1)) ELSE ln((2.0 * i - 1) / (2 * i)) END)), 0)))), 0) AS total FROM t),
    p AS (SELECT *, greatest(CASE WHEN f % 2 = 1 THEN 1 - 2 / pi() * (abs(th) + abs(sin(th)) * cos(th) * total) ELSE 1 - abs(sin(th)) * total END, 0) AS p FROM s),
    q AS (SELECT *, least(min(p * 3 / r) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING), 1) AS q FROM (SELECT *, rank() OVER (ORDER BY p) AS r FROM p))
    SELECT y, n, round(rho, 6) AS rho, round(tanh(atanh(rho) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(rho) + 1.959963984540054 / sqrt(n - 3)), 6) AS high, round(p, 7) AS p, round(q, 7) AS q, q < 0.05 AS holds FROM q""")
def n15_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's total against three other measures, tested together."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.max("o_totalprice").alias("largest"))
    tested = statistics.family_tests(c.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")), "c_custkey", "total", ["n", "largest", "c_acctbal"])
    return tested.select("y", "n", *[F.round(x, 6).alias(x) for x in ("rho", "low", "high")], F.round("p", 7).alias("p"), F.round("q", 7).alias("q"), "holds")


@register("n14_reliability", "WITH g AS (SELECT p_type, sum(p_size * 10) AS estimate, count(*) AS n, stddev_samp(p_size) / sqrt(count(*)) / avg(p_size) AS cv FROM part WHERE p_size > 0 GROUP BY 1) SELECT p_type, n, CASE WHEN NOT (estimate < 1200 OR n < 20 OR cv > 0.33) THEN estimate END::BIGINT AS estimate FROM g")
def n14_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates below 1,200, of fewer than 20 cases, or with a coefficient of variation above 33 % are withheld."""
    g = table(spark, sf_dir, "part").filter("p_size > 0").groupBy("p_type").agg(F.sum(F.col("p_size") * 10).alias("estimate"), F.count("*").alias("n"), (F.stddev_samp("p_size") / F.sqrt(F.count("*")) / F.avg("p_size")).alias("cv"))
    return g.select("p_type", "n", F.when(~F.coalesce(statistics.unreliable(F.col("estimate"), F.col("n"), F.col("cv")), F.lit(True)), F.col("estimate")).alias("estimate"))


# change data and queues


@register("c7_change_events", "WITH o AS (SELECT o_custkey AS k, o_orderkey AS v, unnest(['priority', 'status']) AS field, unnest([o_orderpriority, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END]) AS val FROM orders), l AS (SELECT *, lag(val) OVER w AS before, row_number() OVER w AS r FROM o WINDOW w AS (PARTITION BY k, field ORDER BY v)) SELECT k, v, field, before, val AS after, CASE WHEN before IS NULL THEN 'added' WHEN val IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM l WHERE r > 1 AND before IS DISTINCT FROM val")
def c7_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("status"))
    return cdc.change_events(o, "k", "v", ["priority", "status"])


@register("m7_work_queue", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') SELECT o_orderkey AS id, CASE WHEN n <= 50 OR n > 150 THEN 'c' ELSE 'b' END AS worker FROM o WHERE n <= 50 OR (n > 100 AND n <= 250) ORDER BY n LIMIT 200")
def m7_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a takes 100 items and finishes 50; b takes the next 50; after a's lease c takes what a left, then the next ones."""
    items = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate")
    q = cdc.WorkQueue(spark, fresh_path(spark, "queue"))
    a = q.claim(items, "o_orderkey", ["o_orderdate"], "a", "2026-01-01 00:00:00", 10, 100)
    later = items.join(a.withColumnRenamed("id", "o_orderkey"), "o_orderkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)
    q.finish(later.select(F.col("o_orderkey").alias("id")), "a")
    b = q.claim(items, "o_orderkey", ["o_orderdate"], "b", "2026-01-01 00:05:00", 60, 50)
    c = q.claim(items, "o_orderkey", ["o_orderdate"], "c", "2026-01-01 00:20:00", 60, 150)
    return b.withColumn("worker", F.lit("b")).unionByName(c.withColumn("worker", F.lit("c")))


@register("m8_budgeted_runs", "SELECT doc_id, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM documents")
def m8_budgeted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nights that each work on a third of the text, until nothing is pending."""
    d, root = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "nights")
    budget = d.agg(F.sum(F.length("text"))).first()[0] // 3 + 1
    while cdc.budgeted(spark, d, "doc_id", F.length("text"), root, budget, lambda x: x.select("doc_id", F.length(F.regexp_replace("text", "[^A-Z]", "")).cast("long").alias("capitals"))):
        pass
    return spark.read.parquet(f"{root}/results/*")


@register("m11_family_rebuild", "SELECT o_custkey % 20 AS family, o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def m11_family_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates by family of customers: those of the families that new orders touch are deleted and built again."""
    o, path = table(spark, sf_dir, "orders").withColumn("family", F.col("o_custkey") % 20), fresh_path(spark, "family")

    def family(rows: DataFrame) -> DataFrame:
        return rows.groupBy("family", "o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    cdc.rebuilt_family(spark, path, o.filter("NOT (o_orderkey % 10 = 0 AND family < 7)"), "family", o.select("family"), family)
    out = cdc.rebuilt_family(spark, path, o, "family", o.filter("o_orderkey % 10 = 0 AND family < 7").select("family"), family)
    return out.select(F.col("family").cast("long").alias("family"), "o_custkey", "n", "total")


# functions and registries


@register("udf2_table_function", "SELECT month::VARCHAR AS month, n FROM (SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)")
def udf2_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set-returning function in SQL, which the optimizer inlines."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_series")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION series_window(first DATE, months INT) RETURNS TABLE (month DATE, n BIGINT)
        RETURN SELECT CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders_of_series WHERE CAST(o_orderdate AS DATE) >= first AND CAST(o_orderdate AS DATE) < add_months(first, months) GROUP BY 1""")
    return spark.sql("SELECT CAST(month AS STRING) AS month, n FROM series_window(DATE '1997-01-01', 12)")


@register("udf4_named_source", "SELECT n_nationkey, n_name FROM nation")
def udf4_named_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "named")
    files.write_copy_text(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    readers.define_source(readers.Source("nations", "copy text", "n_nationkey int, n_name string", least_rows=20))
    return readers.read_source(spark, "nations", path)
