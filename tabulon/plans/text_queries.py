"""Text, retrieval, scalar-function, statistics and calculator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import special
from tabulon.functions import text as tf
from tabulon.operators import calculators, dedup, passages, ranking, search, statistics
from tabulon.plans.registry import register
from tabulon.sources.tables import table


@register("f1_strings", "SELECT c_custkey, upper(c_name) AS up, substr(c_name, 3, 5) AS part, split_part(c_name, '#', 2) AS tail, strpos(c_name, '#') AS at, lpad(c_nationkey::VARCHAR, 4, '0') AS padded, replace(c_mktsegment, 'E', '3') AS swapped FROM customer")
def f1_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper("c_name").alias("up"), F.substring("c_name", 3, 5).alias("part"), F.split_part("c_name", F.lit("#"), F.lit(2)).alias("tail"), F.instr("c_name", "#").cast("long").alias("at"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"), F.replace("c_mktsegment", F.lit("E"), F.lit("3")).alias("swapped"))


@register("f2_regex", r"SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1)::INT AS number, regexp_replace(p_type, '[AEIOU]', '', 'g') AS consonants, len(regexp_extract_all(p_name, '[a-z]+')) AS words FROM part")
def f2_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("number"), F.regexp_replace("p_type", "[AEIOU]", "").alias("consonants"), F.size(F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0))).cast("long").alias("words"))


@register("f4_code_points", "SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, substr(text, 5, 12) AS part FROM documents")
def f4_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.substring("text", 5, 12).alias("part"))


@register("f6_categories", "SELECT CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'promotion' WHEN regexp_matches(p_type, 'STEEL|TIN') THEN 'cheap metal' WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'other metal' ELSE 'rest' END AS cat, count(*) AS n FROM part GROUP BY 1")
def f6_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("promotion", "^PROMO"), ("cheap metal", "STEEL|TIN"), ("other metal", "BRASS|COPPER")]
    return table(spark, sf_dir, "part").groupBy(tf.category("p_type", rules, "rest").alias("cat")).agg(F.count("*").alias("n"))


@register("f10_window", "SELECT doc_id, CASE WHEN strpos(lower(text), 'the') > 0 THEN substr(text, greatest(strpos(lower(text), 'the') - 10, 1), strpos(lower(text), 'the') - greatest(strpos(lower(text), 'the') - 10, 1) + 13) END AS around FROM documents")
def f10_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tf.window_around("text", "the", 10).alias("around"))


@register("f14_null_safe_math", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(100.0 * (c_nationkey - c_acctbal) / c_acctbal, 6) END AS pct, round(c_acctbal / nullif(c_nationkey, 0), 6) AS ratio, least(greatest(c_acctbal, 0), 5000) AS clamped FROM customer")
def f14_null_safe_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(b > 0, F.round(100.0 * (n - b) / b, 6)).alias("pct"), F.round(F.try_divide(b, n), 6).alias("ratio"), F.least(F.greatest(b, F.lit(0.0)), F.lit(5000.0)).alias("clamped"))


@register("f17_json", "SELECT event_type, count(*) AS n, sum((props ->> '$.k')::INT)::BIGINT AS k FROM events GROUP BY 1")
def f17_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


@register("f18_canonical_hash", """SELECT c_custkey, sha256('{"acct":' || round(c_acctbal * 100)::BIGINT || ',"key":' || c_custkey || ',"name":"' || c_name || '"}') AS h FROM customer""")
def f18_canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order, integers only: equal content has one spelling."""
    whole = F.struct(F.round(F.col("c_acctbal") * 100).cast("long").alias("acct"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.to_json(whole), 256).alias("h"))


@register("f20_digests", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s FROM nation")
def f20_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.md5("n_name").alias("m"), F.sha2("n_name", 256).alias("s"))


@register("f25_urls", r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '([^/?#]*)(\?[^#]*)?(#.*)?$', 1) AS filename, regexp_replace(url, '([?&])(ref|utm_source)=[^&#]*', '\1\2=…', 'g') AS redacted FROM pages")
def f25_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"([^/?#]*)(\?[^#]*)?(#.*)?$", 1).alias("filename"), F.regexp_replace("url", "([?&])(ref|utm_source)=[^&#]*", "$1$2=…").alias("redacted"))


@register("s8_html_text", r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script\s*>|style[^>]*>.*?</style\s*>|!--.*?-->)', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g').replace('&nbsp;', ' ').replace('&lt;', '<').replace('&gt;', '>').replace('&quot;', '"').replace('&#39;', '''').replace('&copy;', '©').replace('&middot;', '·').replace('&amp;', '&'), '\s+', ' ', 'g'))) AS chars FROM pages""")
def s8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(tf.without_tags("html")).cast("long").alias("chars"))


@register("x1_prefix_search", r"SELECT doc_id FROM (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS w FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, 'ther'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'anst'))) > 0")
def x1_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(search.prefix_search("text", "ther anst")).select("doc_id")


@register("x2_web_search", r"WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents) SELECT doc_id FROM t WHERE contains(t, ' of the ') AND (contains(t, ' with ') OR contains(t, ' from ')) AND NOT contains(t, ' was ')")
def x2_web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(search.web_match("text", '"of the" with OR from -was')).select("doc_id")


@register("x3_tiers", "SELECT p_partkey, CASE WHEN len(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: starts_with(x, 'sma'))) > 0 THEN 0 ELSE 1 END AS tier FROM part WHERE len(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: starts_with(x, 'sma'))) > 0")
def x3_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tiered(table(spark, sf_dir, "part"), "p_name", "p_type", "sma", "p_partkey").select("p_partkey", "tier")


@register("x4_inverted_index", r"WITH t AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM documents) SELECT term, id, count(*) AS tf FROM t GROUP BY 1, 2")
def x4_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text").drop("first")


@register("x9_nearest", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 6) AS score, list_cosine_similarity(q.e, v.e) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, id) AS place FROM s) WHERE place <= 5""")
def x9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return search.nearest(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 5).withColumn("score", F.round("score", 6))


@register("x11_recall", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS id, v.label = q.label AS good, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, v.e), 9) DESC, v.vec_id) AS place FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    p AS (SELECT query, count(*) FILTER (place <= 10) / count(*) AS r, coalesce(1 / min(place) FILTER (place <= 10), 0) AS rr FROM s WHERE good GROUP BY 1) SELECT count(*) AS queries, round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr FROM p""")
def x11_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q, labels = e.filter("vec_id % 100 = 0"), e.select(F.col("vec_id").alias("id"), F.col("label").alias("own"))
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n"))
    wanted = q.select(F.col("vec_id").alias("query"), "label").join(sizes, "label")
    found = search.nearest(e, q, "vec_id", "embedding", 10).join(labels, "id").join(wanted.select("query", "label"), "query").withColumn("good", F.col("own") == F.col("label"))
    s = search.retrieval_scores(found, wanted.select("query", "n"), 10)
    return s.select("queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@register("t5_top_records", r"""WITH p AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    s AS (SELECT doc_id, n, round(len(list_filter(w, lambda x: x IN ('the', 'of', 'and', 'der', 'de'))) / len(w), 9) AS score FROM (SELECT doc_id, n, list_filter(string_split_regex(lower(line), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM p) WHERE len(w) >= 5),
    b AS (SELECT doc_id, max(score) AS score FROM s GROUP BY 1) SELECT doc_id AS record, min(n)::INTEGER AS passage, score, (row_number() OVER (ORDER BY score DESC, doc_id))::INTEGER AS place FROM b JOIN s USING (doc_id, score) GROUP BY doc_id, score ORDER BY score DESC, doc_id LIMIT 50""")
def t5_top_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their line with the largest share of common words."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    w = F.filter(F.split(F.lower("line"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    common = F.filter("w", lambda x: x.isin("the", "of", "and", "der", "de"))
    scored = lines.select("doc_id", "n", w.alias("w")).filter(F.size("w") >= 5).select("doc_id", "n", F.round(F.size(common) / F.size("w"), 9).alias("score"))
    return search.best_passages(scored, "doc_id", "n", "score", 50)


@register("x19_content_dedup", "SELECT doc_id, md5(text) AS h, min(doc_id) OVER (PARTITION BY text) AS keeper FROM documents")
def x19_content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("keeper")), "h").select("doc_id", "h", "keeper")


@register("x19_fetch_decisions", """WITH d AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS h, sha1(coalesce(text, '')) AS s, length(coalesce(text, ''))::BIGINT + 1 AS b, doc_id % 12 AS k FROM documents), o AS (SELECT h, any_value(s) AS s, any_value(b) AS b FROM d WHERE k <> 9 GROUP BY h)
    SELECT id, CASE WHEN k = 0 THEN 'other provider' WHEN k IN (1, 2) AND d.h IN (SELECT h FROM o) THEN 'same sha1' WHEN k = 3 THEN 'nothing known' WHEN k = 4 THEN 'several versions of the address' WHEN d.h NOT IN (SELECT h FROM o) THEN 'object not in the index' WHEN k = 5 THEN 'sha1 has changed' WHEN k = 6 THEN 'size has changed' ELSE 'same address' END AS reason,
      CASE WHEN (k IN (1, 2) OR k > 6) AND d.h IN (SELECT h FROM o) THEN 'skip' ELSE 'download' END AS action, CASE WHEN (k IN (1, 2) OR k > 6) AND d.h IN (SELECT h FROM o) THEN d.h END AS sha256 FROM d""")
def x19_fetch_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: some stored, some known by their address, some changed since, some with two versions."""
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id") % 12
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("h"), F.sha1(text).alias("s"), (F.length(text) + 1).cast("long").alias("b"), k.alias("k"))
    objects = d.filter("k <> 9").select(F.col("h").alias("sha256"), F.col("s").alias("sha1"), F.col("b").alias("bytes"))
    address = F.concat(F.lit("https://Files.example.org/"), F.col("id"), F.lit("?v=1"))
    urls = d.filter("k <> 3").select(address.alias("url"), F.col("h").alias("sha256")).unionByName(d.filter("k = 4").select(F.lower(address).alias("url"), F.sha2(F.lit("another"), 256).alias("sha256")))
    queue = d.select("id", F.when(F.col("k") == 0, "letters").otherwise("docket").alias("provider"), F.concat(address, F.lit("#page=2")).alias("url"), F.when(F.col("k").isin(1, 2), F.upper("s")).when(F.col("k") == 5, F.sha1(F.lit("changed"))).alias("sha1"), F.when(F.col("k") == 6, F.col("b") + 1).when(F.col("k") == 7, F.col("b")).alias("bytes"))
    return dedup.fetch_decisions(queue, objects, urls, ["docket"])


@register("x20_passages", r"WITH b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, item_id FROM d JOIN b ON contains(t, p)")
def x20_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return passages.passages_within(d.select("doc_id", "text"), b.select("item_id", F.col("text").alias("passage")), "doc_id", "text", "item_id", "passage")


@register("x21_hash_sample", "SELECT doc_id FROM (SELECT doc_id, sha256(doc_id::VARCHAR || ':7') AS h FROM documents) ORDER BY h, doc_id LIMIT 100")
def x21_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":7")), 256), "doc_id").limit(100).select("doc_id")


@register("n1_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def n1_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(statistics.pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@register("n2_spearman", "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part) SELECT p_brand, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def n2_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.spearman(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice").withColumn("rho", F.round("rho", 6))


@register("n3_fisher", "SELECT p_brand, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM (SELECT p_brand, corr(p_size, p_retailprice) AS r, count(*) AS n FROM part GROUP BY 1)")
def n3_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(statistics.pearson("p_size", "p_retailprice").alias("r"), F.count("*").alias("n"))
    i = statistics.fisher_interval(F.col("r"), F.col("n"))
    return g.select("p_brand", F.round(i["low"], 6).alias("low"), F.round(i["high"], 6).alias("high"))


def _t_sql(keys: str) -> str:
    """Student's two-sided p-value by its closed sums for whole degrees of freedom."""
    return f"""WITH g AS (SELECT {keys} AS k, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND var_pop(l_quantity) > 0 AND var_pop(l_extendedprice) > 0),
    t AS (SELECT k, n - 2 AS v, r, atan(r / sqrt(greatest(1 - r * r, 1e-300))) AS th FROM g),
    s AS (SELECT *, coalesce(list_sum(list_transform(range(0, v // 2), lambda j: exp(2 * j * ln(cos(th)) + coalesce(list_sum(list_transform(range(1, j + 1), lambda i: CASE WHEN v % 2 = 1 THEN ln(2.0 * i / (2 * i + 1)) ELSE ln((2.0 * i - 1) / (2 * i)) END)), 0)))), 0) AS total FROM t)
    SELECT k, v AS freedom, round(r, 9) AS r, round(CASE WHEN v % 2 = 1 THEN 1 - 2 / pi() * (abs(th) + abs(sin(th)) * cos(th) * total) ELSE 1 - abs(sin(th)) * total END, 8) + 0 AS p FROM s"""


@register("n3_t_test", _t_sql("l_suppkey"))
def n3_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations with their p-values, of a few hundred pairs each."""
    return _t_tests(table(spark, sf_dir, "lineitem"), "l_suppkey")


@register("n3_t_test_few", _t_sql("l_orderkey"))
def n3_t_test_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of three to seven pairs."""
    return _t_tests(table(spark, sf_dir, "lineitem"), "l_orderkey")


def _t_tests(lines: DataFrame, key: str) -> DataFrame:
    g = lines.groupBy(F.col(key).alias("k")).agg(statistics.pearson("l_quantity", "l_extendedprice").alias("r"), F.count("*").alias("n")).filter("r IS NOT NULL")
    return g.select("k", (F.col("n") - 2).alias("freedom"), F.round("r", 9).alias("r"), F.round(statistics.correlation_p(F.col("r"), F.col("n")), 8).alias("p"))


@register("n4_benjamini_hochberg", "WITH p AS (SELECT p_partkey AS k, p_brand AS fam, (p_partkey * 37 % 1000 + 1) / 1000.0 AS p FROM part), r AS (SELECT *, rank() OVER (PARTITION BY fam ORDER BY p) + count(*) OVER (PARTITION BY fam, p) - 1 AS r, count(*) OVER (PARTITION BY fam) AS m FROM p) SELECT k, round(least(min(p * m / r) OVER (PARTITION BY fam ORDER BY p DESC RANGE UNBOUNDED PRECEDING), 1), 6) AS q FROM r")
def n4_benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("fam"), ((F.col("p_partkey") * 37 % 1000 + 1) / 1000.0).alias("p"))
    return statistics.benjamini_hochberg(p, ["fam"], "p").select("k", F.round("q", 6).alias("q"))


@register("n6_regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def n6_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@register("n7_deviation", "SELECT o_orderstatus, round(stddev_pop(o_totalprice), 4) AS pop, round(stddev_samp(o_totalprice), 4) AS samp FROM orders GROUP BY 1")
def n7_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.stddev_pop("o_totalprice"), 4).alias("pop"), F.round(F.stddev_samp("o_totalprice"), 4).alias("samp"))


@register("n8_survival", """WITH d AS (SELECT p_brand AS g, p_size // 4 AS a, p_size // 4 + 1 + p_partkey % 9 AS z, p_partkey % 3 > 0 AS e FROM part), t AS (SELECT DISTINCT g, z AS t FROM d WHERE e),
    r AS (SELECT t.g, t.t, (SELECT count(*) FROM d WHERE d.g = t.g AND a < t.t AND z >= t.t) AS n, (SELECT count(*) FROM d WHERE d.g = t.g AND z = t.t AND e) AS k FROM t)
    SELECT g, t, n AS at_risk, k AS events, round(CASE WHEN bool_or(k >= n) OVER w THEN 0 ELSE exp(sum(CASE WHEN k < n THEN ln((n - k) / n) ELSE 0 END) OVER w) END, 6) AS survival,
      CASE WHEN NOT bool_or(k >= n) OVER w THEN round(exp(sum(CASE WHEN k < n THEN ln((n - k) / n) ELSE 0 END) OVER w - 1.959963984540054 * sqrt(sum(CASE WHEN k < n THEN k / (n * (n - k)) END) OVER w)), 6) END AS low,
      CASE WHEN NOT bool_or(k >= n) OVER w THEN round(least(1, exp(sum(CASE WHEN k < n THEN ln((n - k) / n) ELSE 0 END) OVER w + 1.959963984540054 * sqrt(sum(CASE WHEN k < n THEN k / (n * (n - k)) END) OVER w))), 6) END AS high FROM r WHERE n > 0 WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def n8_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.floor(F.col("p_size") / 4).alias("a"), (F.floor(F.col("p_size") / 4) + 1 + F.col("p_partkey") % 9).alias("z"), (F.col("p_partkey") % 3 > 0).alias("e"))
    return statistics.kaplan_meier(d, ["g"], "a", "z", "e").select("g", "t", "at_risk", "events", *[F.round(c, 6).alias(c) for c in ("survival", "low", "high")])


@register("n9_box", "WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1, median(p_retailprice) AS med, quantile_cont(p_retailprice, 0.75) AS q3 FROM part GROUP BY 1) SELECT p_brand, round(q1, 4) AS q1, round(med, 4) AS med, round(q3, 4) AS q3, min(p_retailprice) FILTER (p_retailprice >= q1 - 1.5 * (q3 - q1)) AS low, max(p_retailprice) FILTER (p_retailprice <= q3 + 1.5 * (q3 - q1)) AS high, count(*) FILTER (p_retailprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM part JOIN q USING (p_brand) GROUP BY 1, 2, 3, 4")
def n9_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = statistics.box_stats(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")
    return b.select("p_brand", *[F.round(c, 4).alias(c) for c in ("q1", "med", "q3")], "low", "high", "outliers")


@register("n12_wilson", "WITH g AS (SELECT toxic, count(*) AS n, sum(quality) AS k FROM labels GROUP BY 1), p AS (SELECT *, k / n AS p, 3.8414588206941236 AS zz FROM g) SELECT toxic, round((p + zz / (2 * n)) / (1 + zz / n) - 1.959963984540054 / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n)), 6) AS low, round((p + zz / (2 * n)) / (1 + zz / n) + 1.959963984540054 / (1 + zz / n) * sqrt(p * (1 - p) / n + zz / (4 * n * n)), 6) AS high FROM p")
def n12_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("quality").alias("k"))
    w = statistics.wilson(F.col("k"), F.col("n"))
    return g.select("toxic", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


@register("n13_poisson", "WITH g AS (SELECT p_brand, count(*) FILTER (p_size < 3) AS x FROM part GROUP BY 1) SELECT p_brand, x, round(CASE WHEN x > 0 THEN x * power(1 - 1 / (9.0 * x) - 1.959963984540054 / (3 * sqrt(x)), 3) ELSE 0 END, 6) AS low, round((x + 1) * power(1 - 1 / (9.0 * (x + 1)) + 1.959963984540054 / (3 * sqrt(x + 1)), 3), 6) AS high FROM g")
def n13_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") < 3).alias("x"))
    p = statistics.poisson_limits(F.col("x"))
    return g.select("p_brand", "x", F.round(p["low"], 6).alias("low"), F.round(p["high"], 6).alias("high"))


@register("n13_signals", """WITH g AS (SELECT p_brand AS k, count(*) FILTER (p_size > 25) AS recent, count(*) FILTER (p_size <= 25 AND p_brand < 'Brand#45') AS prior FROM part GROUP BY 1), c AS (SELECT sum(recent) / sum(prior) AS c FROM g),
    e AS (SELECT *, prior * c AS expected, CASE WHEN recent > 0 THEN recent * power(1 - 1 / (9.0 * recent) - 1.959963984540054 / (3 * sqrt(recent)), 3) ELSE 0 END AS low, (recent + 1) * power(1 - 1 / (9.0 * (recent + 1)) + 1.959963984540054 / (3 * sqrt(recent + 1)), 3) AS high FROM g, c)
    SELECT k, recent, round(CASE WHEN expected > 0 THEN recent / expected END, 6) AS ratio, CASE WHEN recent < 5 THEN 'low' WHEN prior < 2 THEN 'new' WHEN low > expected THEN CASE WHEN recent >= 1.5 * expected THEN 'sharp' ELSE 'rising' END WHEN high < expected THEN 'falling' ELSE 'steady' END AS signal FROM e""")
def n13_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by brand against what the change over all brands leads to expect."""
    size = F.col("p_size")
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("k")).agg(F.count_if(size > 25).alias("recent"), F.count_if((size <= 25) & (F.col("p_brand") < "Brand#45")).alias("prior"))
    change = g.agg((F.sum("recent") / F.sum("prior")).alias("change"))  # one row
    s = statistics.signal(F.col("recent"), F.col("prior"), F.col("change"), least=5, new_below=2)
    return g.crossJoin(F.broadcast(change)).select("k", "recent", s.alias("s")).select("k", "recent", F.round("s.ratio", 6).alias("ratio"), "s.signal")


@register("n16_normal_scores", "SELECT p_partkey, round((row_number() OVER (ORDER BY p_retailprice, p_partkey)) / ((SELECT count(*) FROM part) + 1.0), 9) AS share, (row_number() OVER (ORDER BY p_retailprice, p_partkey) * 2 > (SELECT count(*) FROM part) + 1)::INTEGER AS upper FROM part")
def n16_normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal scores of all prices by rank: the quantile's sign, and the share that the distribution gives back."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    n = p.agg(F.count("*").alias("n"))  # one row
    ranked = ranking.numbered(p, ["p_retailprice", "p_partkey"], "r").crossJoin(F.broadcast(n))
    z = special.normal_quantile(F.col("r") / (F.col("n") + 1))
    return ranked.select("p_partkey", z.alias("z")).select("p_partkey", F.round(special.normal_cdf(F.col("z")), 9).alias("share"), (F.col("z") > 0).cast("int").alias("upper"))


@register("n16_growth", "WITH g AS (SELECT o_orderpriority AS k, count(*) FILTER (year(o_orderdate) = 1995) AS a, count(*) FILTER (year(o_orderdate) = 2000) AS z FROM orders GROUP BY 1) SELECT k, round(power(z / a, 1 / 5.0) - 1, 9) AS cagr FROM g")
def n16_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.year("o_orderdate")
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count_if(y == 1995).alias("a"), F.count_if(y == 2000).alias("z"))
    return g.select("k", F.round(statistics.growth_rate(F.col("a"), F.col("z"), F.lit(5)), 9).alias("cagr"))


@register("c1_inflation", "WITH i AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1) SELECT o_orderkey, round(o_totalprice * b.value / a.value, 4) AS adjusted FROM orders LEFT JOIN i a ON a.month = date_trunc('month', o_orderdate) LEFT JOIN i b ON b.month = DATE '2001-07-01'")
def c1_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("from_month"), F.lit("2001-07-01").cast("date").alias("to_month"))
    index = o.groupBy(F.col("from_month").alias("month")).agg(F.avg("o_totalprice").alias("value"))
    return calculators.adjusted_for_prices(o, index, "o_totalprice", "from_month", "to_month", "adjusted").select("o_orderkey", F.round("adjusted", 4).alias("adjusted"))


@register("c2_present_value", "SELECT p_partkey, round(p_retailprice * (1 - power(1.03, -p_size)) / 0.03, 4) AS pv FROM part")
def c2_present_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(calculators.present_value(F.col("p_retailprice"), F.col("p_size"), F.lit(0.03)), 4).alias("pv"))


@register("c3_judgment_interest", """WITH y AS (SELECT o_orderkey, o_totalprice AS p, (o_orderdate::DATE + to_years(n - 1))::DATE AS a, least((o_orderdate::DATE + to_years(n))::DATE, DATE '2003-05-28') AS z FROM orders, range(1, 20) t(n))
    SELECT o_orderkey, round(any_value(p) * product(1 + 0.045 * (z - a) / 365) - any_value(p), 2) AS interest FROM y WHERE z > a GROUP BY 1""")
def c3_judgment_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.round(calculators.compounded_interest(F.col("o_totalprice"), F.lit(0.045), F.to_date("o_orderdate"), F.lit("2003-05-28").cast("date")), 2).alias("interest"))


@register("c4_age_rows", "SELECT p_partkey, v AS expectancy FROM part LEFT JOIN (VALUES (0, 10, 70.5), (10, 30, 55.25), (30, NULL, 30.0)) t(a, z, v) ON p_size >= a AND (z IS NULL OR p_size < z)")
def c4_age_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    brackets = spark.sql("SELECT * FROM VALUES (0, 10, 70.5D), (10, 30, 55.25D), (30, NULL, 30.0D) t(from_age, to_age, expectancy)")
    return calculators.row_for_age(table(spark, sf_dir, "part").select("p_partkey", "p_size"), brackets, "p_size", ["expectancy"]).select("p_partkey", "expectancy")
