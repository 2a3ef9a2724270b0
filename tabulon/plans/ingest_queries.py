"""Sources, sinks, incremental ingest and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions import text as tf
from tabulon.operators import passages
from tabulon.plans.registry import register
from tabulon.sources import files
from tabulon.sources.scratch import fresh_path, stored
from tabulon.sources.tables import table
from tabulon.streaming import cdc


@register("s1_csv_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return files.read_csv(spark, path, T.StructType.fromDDL("c_custkey long, c_name string, c_acctbal double"))


@register("s5_json_lines", "SELECT event_id, event_type, value FROM events WHERE event_id % 50 > 0")
def s5_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line in fifty is broken and must be held, not repaired."""
    path = fresh_path(spark, "jsonl")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    e.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return files.read_json_lines(spark, path, T.StructType.fromDDL("event_id long, event_type string, value double"))[0]


@register("s17_copy_text", "SELECT page_id, url, html FROM pages")
def s17_copy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "copy")
    files.write_copy_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return files.read_copy_text(spark, path, T.StructType.fromDDL("page_id long, url string, html string"))[0]


@register("s19_json_rows", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events")
def s19_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("a"))
    return e.select("event_id", F.inline(F.from_json("a", "array<struct<k:int>>")))


@register("k6_packet", "SELECT count(*) AS rows FROM supplier")
def k6_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, read back and digested again; a difference would raise."""
    path = fresh_path(spark, "published")
    s = table(spark, sf_dir, "supplier")
    files.publish(s.filter("s_suppkey % 2 = 0"), path, "s_suppkey")
    files.publish_more(s, path, "s_suppkey", s.filter("s_suppkey % 2 = 0").count())
    return spark.read.parquet(path).agg(F.count("*").alias("rows"))


@register("k7_dictionary", "WITH d AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) AS code, p_partkey FROM part) SELECT p_partkey, code FROM d")
def k7_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = files.dictionary_encoded(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "code")
    return coded.select("p_partkey", "code")


@register("m1_micro_batches", "SELECT user_id, event_type AS last_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def m1_micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive as files in three micro-batches, each user's latest one wins whatever the order of arrival."""
    src, e = fresh_path(spark, "arrivals"), table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    for part in (2, 0, 1):
        e.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(src)
    target = cdc.VersionedTable(spark, fresh_path(spark, "state"), e.limit(0), "user_id")
    cdc.ingest(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src), target, "user_id", "ts", fresh_path(spark, "cursor"))
    return target.read().select("user_id", F.col("event_type").alias("last_type"), "event_id")


@register("m3_change_detection", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'insert' WHEN c_custkey % 6 = 1 THEN 'update' ELSE 'unchanged' END AS change FROM customer")
def m3_change_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    held = c.filter("c_custkey % 4 > 0").withColumn("_hash", cdc.payload_hash(["c_name", "c_acctbal"]))
    offered = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 6 == 1, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return cdc.classify(offered, held, "c_custkey", ["c_name", "c_acctbal"]).select("c_custkey", "change")


@register("m4_versions", """WITH o AS (SELECT DISTINCT o_custkey AS k, o_orderdate AS t0, o_orderstatus AS s FROM orders), l AS (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY t0, sha256('{"s":"' || s || '"}')) AS before FROM o), c AS (SELECT * FROM l WHERE s IS DISTINCT FROM before)
    SELECT k, row_number() OVER w AS version, s, t0 AS valid_from, lead(t0) OVER w AS valid_to FROM c WINDOW w AS (PARTITION BY k ORDER BY t0, sha256('{"s":"' || s || '"}'))""")
def m4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("s"))
    return cdc.versions(o, "k", "at", ["s"])


@register("m5_late_rows", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE c_acctbal + 100 END AS v FROM customer")
def m5_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    late = F.when(F.col("k") % 3 == 0, -1).otherwise(1)
    return cdc.merged(c.withColumn("as_of", F.lit(0)), c.withColumn("as_of", late).withColumn("v", F.col("v") + 100), "k", "as_of").select("k", "v")


@register("m6_insert_only", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0")
def m6_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return cdc.insert_only(s.filter("s_suppkey % 3 > 0"), s, "s_suppkey", ["s_name"]).select("s_suppkey")


@register("m9_freshness", "WITH l AS (SELECT event_type AS source, ts, value > 2 AS ok FROM events WHERE event_type <> 'view' OR value < 0), g AS (SELECT source, max(ts) FILTER (ok) AS last_ok, last(ok ORDER BY ts, ok) AS lately FROM l GROUP BY 1) SELECT source, last_ok, CASE WHEN last_ok IS NULL THEN 'never' WHEN NOT lately THEN 'failed' WHEN last_ok < TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR THEN 'stale' ELSE 'ok' END AS status FROM g")
def m9_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").filter("event_type <> 'view' or value < 0").select(F.col("event_type").alias("source"), "ts", (F.col("value") > 2).alias("ok"))
    return cdc.freshness(runs, "source", "ts", "ok", F.lit("2024-01-31").cast("timestamp"), 6)


@register("m10_cleanup", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0)")
def m10_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned on yesterday's rows: odd ones have changed since and stay."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    plan = cdc.cleanup_plan(o, "o_orderkey", ["o_orderstatus", "o_totalprice"], F.col("o_orderstatus") == "P")
    now = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return cdc.applied(now, plan, "o_orderkey", ["o_orderstatus", "o_totalprice"])[0].select("o_orderkey")


def _cleaned_orders(spark: SparkSession, sf_dir: str):
    """Orders P are to go and orders F to be marked; before the clean-up every third one changes, after it every fifth."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority"))
    run = cdc.Cleanup(spark, fresh_path(spark, "cleanup"), "o_orderkey")
    run.plan(o, "one", F.col("o_orderstatus") == "P", "pending orders")
    run.plan(o, "two", F.col("o_orderstatus") == "F", "finished orders are marked", {"o_orderpriority": F.concat(F.lit("done "), "o_orderpriority")})
    now = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    first = run.apply(now, "one")
    return run, now, first, run.apply(first, "two")


@register("m10_verified", """SELECT phase, count(*) FILTER (s) AS planned, CASE WHEN phase = 'one' THEN count(*) FILTER (s AND o_orderkey % 3 > 0) ELSE 0 END AS removed, CASE WHEN phase = 'two' THEN count(*) FILTER (s AND o_orderkey % 3 > 0) ELSE 0 END AS changed, count(*) FILTER (s AND o_orderkey % 3 = 0) AS skipped, true AS complete
    FROM (SELECT phase, o_orderkey, o_orderstatus = CASE WHEN phase = 'one' THEN 'P' ELSE 'F' END AS s FROM orders, (VALUES ('one'), ('two')) p(phase)) GROUP BY phase""")
def m10_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, now, first, second = _cleaned_orders(spark, sf_dir)
    return run.verify(now, first, "one").withColumn("phase", F.lit("one")).unionByName(run.verify(first, second, "two").withColumn("phase", F.lit("two")))


@register("m10_rolled_back", """SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'P' THEN -1 WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN -1 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 AND o_orderkey % 5 = 0 THEN 'done ' ELSE '' END || o_orderpriority AS o_orderpriority FROM orders""")
def m10_rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taken back but for the marked orders that somebody has changed since."""
    run, _, _, second = _cleaned_orders(spark, sf_dir)
    later = second.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, -1.0).otherwise(F.col("o_totalprice")))
    return run.rollback(run.rollback(later, "two"), "one")


@register("m12_coverage", "SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS n, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def m12_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"))


@register("m14_only_new_keys", "SELECT DISTINCT md5(text) AS key FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def m14_only_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    return d.select("key").distinct().join(d.filter("doc_id % 2 = 0").select("key"), "key", "left_anti")


@register("m14_two_nights", r"""WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 7 > 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'Line of document ' || doc_id % 10 ELSE text END AS text FROM documents WHERE doc_id % 11 > 0),
    ka AS (SELECT DISTINCT l FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM a) WHERE l <> ''), kb AS (SELECT DISTINCT l FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM b) WHERE l <> '')
    SELECT 1 AS night, 'send' AS what, sha256('m' || chr(0) || 'document' || chr(0) || l) AS key FROM ka UNION ALL SELECT 2, 'send', sha256('m' || chr(0) || 'document' || chr(0) || l) FROM kb WHERE l NOT IN (SELECT l FROM ka) UNION ALL SELECT 2, 'delete', sha256('m' || chr(0) || 'document' || chr(0) || l) FROM ka WHERE l NOT IN (SELECT l FROM kb)
    UNION ALL SELECT 1, 'cut', count(*)::VARCHAR FROM a UNION ALL SELECT 2, 'cut', count(*)::VARCHAR FROM b WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def m14_two_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nights of a changing corpus, cut at line ends: what is sent to be embedded, what is deleted, how many are cut."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    tail = F.concat(F.coalesce("text", F.lit("")), F.lit("\nLine of document "), F.col("doc_id") % 10)
    nights = [d.filter("doc_id % 7 > 0"), d.filter("doc_id % 11 > 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, tail).otherwise(F.col("text")))]

    def lines(docs: DataFrame) -> DataFrame:
        return docs.select("id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "body")).filter("body <> ''")

    state, out = cdc.PassageState(spark, fresh_path(spark, "passages"), lines), None
    for number, docs in enumerate(nights, 1):
        send, gone, cut = state.refresh(docs, "doc_id", "text", lambda body: tf.embedding_key(body, "m"))
        told = [send.select(F.lit("send").alias("what"), "key"), gone.select(F.lit("delete").alias("what"), "key"), spark.createDataFrame([("cut", str(cut))], "what string, key string")]
        for t in told:
            t = stored(t.withColumn("night", F.lit(number)), "night")
            out = t if out is None else out.unionByName(t)
    return out


@register("m15_tumbling", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def m15_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@register("m15_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) FOR k IN range(4)]) AS start FROM events) GROUP BY 1")
def m15_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", [], slide="15 minutes")


@register("m15_sessions", """WITH f AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM f)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def m15_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", ["user_id"])


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files that are not in order of time."""
    src, e = fresh_path(spark, "arrivals"), table(spark, sf_dir, "events")
    e.repartition(4, F.col("event_id")).write.parquet(src)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(src)


@register("m15_stream_tumbling", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def m15_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _arrivals(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "60 days")
    return cdc.drained(cdc.tumbling(stream, "ts", "1 day", ["event_type"]), ["event_type", "start"])


@register("m15_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def m15_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _arrivals(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])
    return cdc.drained(stream)


@register("x7_chunks")
def x7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.chunked(table(spark, sf_dir, "documents"), "doc_id", "text").drop("body")
