"""Names, citations, docket texts and deadlines: operators over texts that are put together from whole tables.

The tables hold no such texts, so each query writes them from a table's columns and its statement derives what must be
found from the same columns, not from the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions import text as tf
from tabulon.operators import calculators, citations, joins, names, search, series
from tabulon.plans.registry import register
from tabulon.sources.tables import table


@register("f7_firm_key", "SELECT s_suppkey, 'supplier ' || lpad(s_suppkey::VARCHAR, 9, '0') || CASE s_suppkey % 4 WHEN 0 THEN ' and sons' WHEN 1 THEN ' and sons' WHEN 2 THEN '' ELSE ' holding' END AS key FROM supplier")
def f7_firm_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    name = F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat('The ', s_name, ' & Sons, Inc.') WHEN 1 THEN upper(concat(s_name, ' and Sons Co., Ltd.')) WHEN 2 THEN concat(s_name, ' L.L.C') ELSE concat('  ', s_name, ' Holding,  Corporation ') END")
    return s.select("s_suppkey", tf.firm_key(F.regexp_replace(name, "L\\.L\\.C", "LLC")).alias("key"))


@register("f8_negation", "SELECT o_orderkey, o_orderkey % 5 IN (0, 3) AS reported FROM orders")
def f8_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'One death was reported.' WHEN 1 THEN 'No injury or death was reported.' WHEN 2 THEN 'The firm denies any death' WHEN 3 THEN 'No fire occurred. A death followed.' ELSE 'All is well' END")
    return table(spark, sf_dir, "orders").select("o_orderkey", tf.mentions(F.concat(said, F.lit(" File "), F.col("o_orderkey").cast("string")), "(?i)death").alias("reported"))


@register("f9_sentences", "SELECT p_partkey, (3 - p_partkey % 2)::INT AS sentences, p_size * 1500000.0 AS first_number FROM part")
def f9_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("concat('Mr. Lee of Acme Inc. sold ', p_size, '.0 ', CASE WHEN p_partkey % 2 = 0 THEN 'million units. He left! U.S. law, No. 12, was cited by J. Roe.' ELSE 'million units, e.g. of ' END, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat(p_type, '. Was it so?') END)")
    n = F.get(tf.numbers(said), F.lit(0)) * 1.5
    return table(spark, sf_dir, "part").select("p_partkey", F.size(tf.sentences(said)).alias("sentences"), n.alias("first_number"))


@register("j28_name_crosswalk", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 3 AND s_suppkey % 7 > 0 THEN s_suppkey END AS person, CASE WHEN s_suppkey % 4 = 3 THEN 0 WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END AS candidates, CASE WHEN s_suppkey % 4 = 3 THEN 'unmatched' WHEN s_suppkey % 7 = 0 THEN 'ambiguous' ELSE 'matched' END AS state FROM supplier")
def j28_name_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name has a person with a full middle name and, for every seventh, one more with an initial."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    left = s.withColumn("name", F.expr("concat('Hon. Ann ', CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'B. ' WHEN 2 THEN 'Beth ' ELSE 'Carl ' END, 'Ost', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ', Jr.' ELSE '' END)"))
    right = s.withColumn("name", F.expr("concat('ANN BETH OST', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' Junior' ELSE '' END)")).withColumnRenamed("s_suppkey", "person")
    more = s.filter("s_suppkey % 7 = 0").select((F.col("s_suppkey") + 1_000_000).alias("person"), F.expr("concat('Ann B. Ost', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN ' Jr' ELSE '' END, ' Esq.')").alias("name"))
    return names.crosswalk(left, right.unionByName(more), "s_suppkey", "person", "name")


_CITING = "concat('See ', o_orderkey % 50 + 1, ' U.S.C. § ', o_custkey, '; ', CASE WHEN o_orderkey % 3 = 0 THEN concat('Id. at 4. Roe v. Doe, ', o_orderkey % 90 + 500, ' U.S. ', o_custkey + 1, ' (1999); ', o_orderkey % 90 + 500, ' U.S. at 77. ') ELSE '' END, 'and ', o_orderkey % 40 + 1, ' C.F.R. § ', o_custkey, '.', o_orderkey % 9 + 1, '.')"
_CITED = """c AS (SELECT o_orderkey AS id, 'usc' AS kind, 'usc:' || (o_orderkey % 50 + 1) || ':' || o_custkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS n FROM orders
    UNION ALL SELECT o_orderkey, 'case', 'case:' || (o_orderkey % 90 + 500) || ':us:' || (o_custkey + 1), 2 FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT o_orderkey, 'cfr', 'cfr:' || (o_orderkey % 40 + 1) || ':' || o_custkey || '.' || (o_orderkey % 9 + 1), 1 FROM orders)"""


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CITING).alias("said"))


@register("x12_citations", f"WITH {_CITED} SELECT * FROM c")
def x12_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short forms count for what they stand for."""
    return citations.citations(_citing(spark, sf_dir), "o_orderkey", "said")


#: kind, text before and after the number n, key before and after it
_KINDS = (
    ("usc", "under 28 U.S.C. § ", "a-1 and", "usc:28:", "a-1"), ("cfr", "21 C. F. R. part ", ".5", "cfr:21:", ".5"), ("federal_register", "85 Fed. Reg. ", ",001", "federal_register:85:", "001"), ("statutes_at_large", "110 Stat. ", "", "statutes_at_large:110:", ""),
    ("public_law", "Public Law No. 104-", ".", "public_law:104:", ""), ("constitution_us", "item ", " of U.S. Const. amend. XIV", None, None), ("constitution_state", "item ", " of N.Y. Const. art. VI", None, None), ("federal_rule", "Fed. R. Civ. P. ", "", "federal_rule:civ:", ""),
    ("local_rule", "Local Civil Rule ", ".1", "local_rule:", ".1"), ("state_regulation", "Cal. Code Regs. tit. 8, § ", "", "state_regulation:cal:", ""), ("state_statute", "W.Va. Penal Code Ann. § ", ".02", "state_statute:wva:", ".02"), ("mdl", "MDL No. 1", "", "mdl:1", ""),
    ("docket", "No. 3:20-cv-10", "", "docket:3:20-cv-10", ""), ("case", "77 F. Supp. 2d ", " (2001)", "case:77:fsupp2d:", ""), ("case", "77 Cal.App.4th ", "; see", "case:77:calapp4th:", ""), ("case", "77 F. App’x ", "", "case:77:fapp’x:", ""),
)
_NUMBER = "(100 + p_partkey % 800)"


def _kinds_sql() -> str:
    out = []
    for k, (kind, before, after, key, rest) in enumerate(_KINDS):
        own = f"'{key}' || {_NUMBER} || '{rest}'" if key else "'constitution_us:amend:xiv'" if kind == "constitution_us" else "'constitution_state:ny:vi'"
        shift = len(" of ") + len(before) + 3 + len("Part: ") if not key else len("Part: ") + {"usc": 6}.get(kind, 0)
        out.append(f"SELECT p_partkey AS id, '{kind}' AS kind, {own} AS key, {shift} AS start FROM part WHERE p_partkey % {len(_KINDS) + 1} = {k}")
    last = len(_KINDS)
    out.append(f"SELECT p_partkey, k, 'case:5:f3d:' || {_NUMBER}, s FROM part, (VALUES ('case', 6), ('short', 34), ('short', 54)) t(k, s) WHERE p_partkey % {last + 1} = {last}")
    return " UNION ALL ".join(out)


@register("x12_all_kinds", _kinds_sql())
def x12_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of citation, and where each stands."""
    texts = [f"concat('Part: {before}', {_NUMBER}, '{after}')" for _, before, after, _, _ in _KINDS] + [f"concat('Part: 5 F.3d ', {_NUMBER}, ' (9th Cir. 2001). 5 F.3d at 300, then Id. at 14')"]
    said = F.expr("CASE p_partkey % " + str(len(texts)) + " " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END")
    return citations.located(table(spark, sf_dir, "part").select("p_partkey", said.alias("said")), "p_partkey", "said").select("id", "kind", "key", "start")


_KNOWN = "k AS (SELECT DISTINCT 'usc:' || (p_partkey % 50 + 1) || ':' || p_partkey AS key, 'statute ' || (p_partkey % 50 + 1) || '-' || p_partkey || CASE WHEN p_partkey % 11 = 0 AND t = 1 THEN ' bis' ELSE '' END AS target FROM part, range(2) r(t))"


@register("x13_resolved", f"WITH {_CITED}, {_KNOWN}, g AS (SELECT key, min(target) AS a, max(target) AS z FROM k GROUP BY 1) SELECT id, c.key AS key, n, CASE WHEN a = z THEN a END AS target, CASE WHEN a IS NULL THEN 'pending' WHEN a = z THEN 'resolved' ELSE 'ambiguous' END AS state FROM c LEFT JOIN g ON c.key = g.key")
def x13_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from texts to authorities; every eleventh authority key has two targets."""
    p = table(spark, sf_dir, "part").select(F.expr("concat('usc:', p_partkey % 50 + 1, ':', p_partkey)").alias("key"), F.expr("explode(array(concat('statute ', p_partkey % 50 + 1, '-', p_partkey), concat('statute ', p_partkey % 50 + 1, '-', p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ' bis' ELSE '' END)))").alias("target"))
    return citations.resolved(citations.citations(_citing(spark, sf_dir), "o_orderkey", "said").drop("kind"), p)


@register("x14_citation_facts", f"WITH {_CITED}, o AS (SELECT o_orderkey, o_orderpriority AS court, year(o_orderdate)::INT AS y FROM orders) SELECT court, y, count(DISTINCT o_orderkey) AS filings, count(DISTINCT id) FILTER (kind = 'case') AS citing, count(DISTINCT key) FILTER (kind = 'case') AS decisions, count(DISTINCT key) FILTER (kind <> 'case') AS provisions FROM o LEFT JOIN c ON id = o_orderkey GROUP BY 1, 2")
def x14_citation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of each court and year, those that cite decisions, and the decisions and provisions cited."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("court"), F.year("o_orderdate").alias("y"))
    c = citations.citations(_citing(spark, sf_dir), "o_orderkey", "said").select(F.col("id").alias("o_orderkey"), "kind", "key")
    case = F.col("kind") == "case"
    return o.join(c, "o_orderkey", "left").groupBy("court", "y").agg(F.countDistinct("o_orderkey").alias("filings"), F.countDistinct(F.when(case, F.col("o_orderkey"))).alias("citing"), F.countDistinct(F.when(case, F.col("key"))).alias("decisions"), F.countDistinct(F.when(~case, F.col("key"))).alias("provisions"))


@register("x15_authority_lines", "SELECT p_partkey AS id, (p_size % 54 + 1)::INT AS title, (p_partkey + 1)::VARCHAR AS section, CASE p_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'et seq' WHEN 2 THEN 'range' ELSE 'note' END AS form, CASE WHEN p_partkey % 4 = 2 THEN (p_partkey + 9)::VARCHAR END AS last FROM part UNION ALL SELECT p_partkey, 28, '7', 'exact', NULL FROM part WHERE p_partkey % 2 = 0")
def x15_authority_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.expr("concat('Authority: ', p_size % 54 + 1, ' U.S.C. ', p_partkey + 1, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' et seq.' WHEN 2 THEN concat('-', p_partkey + 9) ELSE ' note' END, CASE WHEN p_partkey % 2 = 0 THEN '; 28 U.S.C. 7' ELSE '' END, '; Pub. L. 104-4; 99 U.S.C. 5.')")
    return citations.authority_lines(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")), "p_partkey", "line")


_DAYS = "strftime(o_orderdate + INTERVAL {} DAY, '%Y-%m-%d')"


@register("x16_docket_dates", f"""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS kind, {_DAYS.format(30)} AS a, {_DAYS.format(44)} AS b FROM orders)
    SELECT o_orderkey, 1 AS nth, a AS date, 'set for' AS phrase, 'Jury Selection' AS label, '08:00 AM' AS time, false AS vacated FROM o WHERE kind = 0 UNION ALL SELECT o_orderkey, 2, b, 'set for', 'Jury Selection', NULL, true FROM o WHERE kind = 0
    UNION ALL SELECT o_orderkey, 1, a, 'reset for', 'Status Conference', '10:00 AM', false FROM o WHERE kind = 1 UNION ALL SELECT o_orderkey, 2, b, 'due by', 'Answer of party ' || o_orderkey, NULL, false FROM o WHERE kind = 1
    UNION ALL SELECT o_orderkey, 1, a, 'is set for', 'Hearing', NULL, true FROM o WHERE kind = 2 UNION ALL SELECT o_orderkey, 2, b, 'continued to', 'Hearing', NULL, false FROM o WHERE kind = 2
    UNION ALL SELECT o_orderkey, 1, a, 'continued to', '… two three four five six seven eight nine ten eleven Bench Trial', '9:30', false FROM o WHERE kind = 3""")
def x16_docket_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = "date_format(o_orderdate + INTERVAL {} DAYS, 'M/d/yyyy')"
    a, b = day.format(30), day.format(44)
    entry = F.expr(f"""CASE o_orderkey % 4
        WHEN 0 THEN concat('CLERK NOTICE (hearing). Jury Selection set for ', {a}, ' at 08:00 AM, Jury Trial set for ', {b}, ' is vacated. Seen 1/2/2003.')
        WHEN 1 THEN concat('ORDERED that the Status  Conference reset for ', {a}, ', 10:00 AM; Answer of party ', o_orderkey, ' due by ', {b}, '. It was vacated before.')
        WHEN 2 THEN concat('It is hereby ordered that the Hearing is set for ', {a}, ', has been vacated and continued to ', {b}, '. Reply due by 2/30/2001.')
        ELSE concat('Minutes\none two three four five six seven eight nine ten eleven Bench Trial continued to ', {a}, ' at 9:30. (Signed on 5/21/2026)') END""")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(tf.docket_dates(entry)).alias("at", "d")).select("o_orderkey", (F.col("at") + 1).alias("nth"), F.date_format("d.date", "yyyy-MM-dd").alias("date"), "d.phrase", "d.label", "d.time", "d.vacated")


@register("x17_order_windows", "WITH z AS (SELECT max(o_orderdate)::DATE AS z, min(o_orderdate)::DATE AS a FROM orders) SELECT o_orderpriority, count(*) FILTER (z - o_orderdate::DATE < 30) AS d30, count(*) FILTER (z - o_orderdate::DATE < 90) AS d90, CASE WHEN max(z - a) >= 90000 THEN count(*) END AS d90000 FROM orders, z GROUP BY 1")
def x17_order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in the last 30 and 90 days; a window that the record does not cover has no count."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.to_date("o_orderdate").alias("day"))
    z = o.agg(F.max("day").alias("today"), F.min("day").alias("since"))  # one row
    return series.recent_changes(o.crossJoin(F.broadcast(z)), ["o_orderpriority"], "day", F.col("today"), F.col("since"), (30, 90, 90000))


@register("x18_fact_check", "SELECT o_orderkey, 'It paid ' || o_custkey || ' dollars.' || CASE WHEN o_orderkey % 2 = 0 THEN ' Sales were ' || (o_orderkey % 7 + 1) || ' million.' ELSE '' END || ' Nobody spoke.' AS kept FROM orders")
def x18_fact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences whose numbers the source does not have are dropped."""
    source = F.expr("concat('In ', year(o_orderdate), ' the firm paid ', o_custkey, ' dollars', CASE WHEN o_orderkey % 2 = 0 THEN concat(' on sales of ', (o_orderkey % 7 + 1) * 1000, ',000') ELSE '' END)")
    summary = F.expr("concat('It paid ', o_custkey, ' dollars. It paid ', o_custkey + 50000001, ' dollars. Sales were ', o_orderkey % 7 + 1, ' million. Nobody spoke.')")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tf.backed_sentences(summary, source), " ").alias("kept"))


@register("x5_query_lint", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'empty' WHEN 1 THEN 'quotes' WHEN 2 THEN 'parentheses' WHEN 3 THEN 'parentheses' WHEN 4 THEN 'range' WHEN 5 THEN 'wildcard' END AS problem FROM part")
def x5_query_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("CASE p_partkey % 8 WHEN 0 THEN '  ' WHEN 1 THEN concat('\"', p_name) WHEN 2 THEN concat(p_name, ') OR (x') WHEN 3 THEN concat('((', p_name, ')') WHEN 4 THEN concat(p_name, ' [1 to 5]') WHEN 5 THEN concat(p_name, ' AND ab*') WHEN 6 THEN concat('(', p_name, ' OR \"a ) b\") [1 TO 5] abc*') ELSE p_name END")
    return table(spark, sf_dir, "part").select("p_partkey", search.query_problem(q).alias("problem"))


@register("x24_watch_phrases", r"WITH t AS (SELECT doc_id, source, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents) SELECT doc_id FROM t WHERE source IN ('src0', 'src3', 'src7') AND (contains(t, ' of the ') OR contains(t, ' with that ') OR contains(t, ' and in '))")
def x24_watch_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("source").isin("src0", "src3", "src7"))
    return d.filter(search.phrase_match("text", ["of the", "With that", "and  in"])).select("doc_id")


@register("x8_snippets", r"""WITH c AS (SELECT doc_id, 'Document ' || doc_id || ' › ' || coalesce(source, '') AS heading, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, '[\x1e\x1f]', '', 'g'), '\n[\t ]+', chr(10), 'g'), chr(9), ' '), ' {2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS t FROM documents),
    f AS (SELECT *, trim(regexp_replace(t, '\s+', ' ', 'g')) AS flat FROM c), n AS (SELECT *, CASE WHEN contains(left(flat, 160), ' ') AND length(regexp_replace(left(flat, 160), ' [^ ]*$', '')) > 80 THEN length(regexp_replace(left(flat, 160), ' [^ ]*$', '')) ELSE 160 END AS n FROM f)
    SELECT doc_id, CASE WHEN length(flat) <= 160 THEN flat ELSE rtrim(left(flat, n), ' ,;:.-') || '…' END AS snippet, (length(t) * 10 + 33) // 34 AS tokens, sha256('m' || chr(0) || 'document' || chr(0) || heading || chr(10) || chr(10) || t) AS key FROM n""")
def x8_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets, estimates of tokens, and the keys of what would be embedded under a heading path."""
    heading = F.concat(F.lit("Document "), F.col("doc_id"), F.lit(" › "), F.coalesce("source", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", heading.alias("heading"), "text", tf.cleaned("text").alias("t"))
    return d.select("doc_id", tf.snippet("text", 160).alias("snippet"), tf.token_estimate("t").alias("tokens"), tf.embedding_key(tf.embedding_text("heading", "text"), "m").alias("key"))


@register("x23_similar_names", "WITH n AS (SELECT DISTINCT p_name AS n FROM part), k AS (SELECT n, array_to_string(list_sort(list_distinct(string_split(lower(n), ' '))), ' ') AS k FROM n) SELECT a.n AS a, b.n AS b, CASE WHEN a.k = b.k THEN 'order' ELSE 'spelling' END AS why FROM k a JOIN k b ON a.n < b.n AND (a.k = b.k OR levenshtein(a.n, b.n) <= 2)")
def x23_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names of the same words in another order, or within two letters of each other."""
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("n")).distinct()
    k = n.select("n", F.array_join(F.array_sort(F.array_distinct(F.split(F.lower("n"), " "))), " ").alias("k"))
    same = k.join(k.select(F.col("n").alias("b"), "k"), "k").filter("n < b").select(F.col("n").alias("a"), "b", F.lit("order").alias("why"))
    near = joins.close_spellings(n, "n", 2).select("a", "b", F.lit("spelling").alias("why"))
    return same.unionByName(near.join(same, ["a", "b"], "left_anti"))


@register("c5_deadlines", "SELECT o_orderkey, CASE WHEN day(o_orderdate::DATE + INTERVAL 24 MONTH) = day(o_orderdate) THEN strftime(least((o_orderdate::DATE + INTERVAL 24 MONTH)::DATE + (CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_custkey % 40 >= 10 THEN greatest(o_custkey % 40, 10 + o_orderkey % 25) ELSE o_custkey % 40 + o_orderkey % 25 END)::INT, (o_orderdate::DATE + INTERVAL 25 MONTH)::DATE), '%Y-%m-%d') END AS due FROM orders")
def c5_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years, and the days of two pauses that may overlap, but not after 25 months."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    pauses = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN array() ELSE array(struct(d + 110 AS s, CAST(d + CAST(110 + o_orderkey % 25 AS INT) AS DATE) AS e), struct(d + 100 AS s, CAST(d + CAST(100 + o_custkey % 40 AS INT) AS DATE) AS e)) END").cast("array<struct<s:date,e:date>>")
    due = calculators.deadline(F.col("d"), F.lit(24), pauses, ceiling=F.add_months("d", 25))
    exact = F.dayofmonth(F.add_months("d", 24)) == F.dayofmonth("d")
    return o.select("o_orderkey", F.when(exact, F.date_format(due, "yyyy-MM-dd")).alias("due"))


@register("c5_reviewed", """WITH o AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate::DATE AS d, (o_orderdate::DATE + INTERVAL 24 MONTH)::DATE AS b, ((o_orderdate::DATE + 50) + INTERVAL 24 MONTH)::DATE AS anew FROM orders),
    r AS (SELECT *, CASE WHEN k = 2 THEN 'open_ended' WHEN k = 3 AND day(anew) <> day(d + 50) THEN 'needs_review' ELSE 'calculated' END AS status, CASE k WHEN 1 THEN b + 45 WHEN 3 THEN anew WHEN 4 THEN greatest(b, d + 750) WHEN 5 THEN d + 800 ELSE b END AS due FROM o)
    SELECT o_orderkey, status, CASE WHEN status = 'calculated' THEN strftime(CASE WHEN o_orderkey % 7 = 0 THEN least(due, b + 20) ELSE due END, '%Y-%m-%d') END AS due, status = 'calculated' AND o_orderkey % 7 = 0 AND due > b + 20 AS capped FROM r""")
def c5_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years from each order under two pauses, an open pause, a delayed start, a floor or a fixed date, and some caps."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))

    def one(**parts) -> Column:
        kinds = dict(f.split(":") for f in calculators.INSTRUCTION[7:-1].split(","))
        return F.struct(*[parts.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])

    def day(n: int) -> Column:
        return F.date_add("d", n)

    yes, kind = F.lit(True), F.col("o_orderkey") % 6
    pauses = F.array(one(id=F.lit("b"), kind=F.lit("pause"), confirmed=yes, start=day(120), resume=day(400), most=F.lit(25), most_unit=F.lit("calendar_days")), one(id=F.lit("a"), kind=F.lit("pause"), confirmed=yes, start=day(100), resume=day(130)))
    still = F.array(one(id=F.lit("a"), kind=F.lit("pause"), confirmed=yes, start=day(100)))
    later = F.array(one(id=F.lit("a"), kind=F.lit("defer_start"), confirmed=yes, resume=day(50)))
    floor = F.array(one(id=F.lit("a"), kind=F.lit("minimum_after_event"), confirmed=yes, protected=day(10), event=day(720), amount=F.lit(30), unit=F.lit("calendar_days")))
    fixed = F.array(one(id=F.lit("a"), kind=F.lit("fixed_deadline"), confirmed=yes, date=day(800)))
    given = F.when(kind == 1, pauses).when(kind == 2, still).when(kind == 3, later).when(kind == 4, floor).when(kind == 5, fixed)
    base = F.add_months("d", 24)
    caps = F.when(F.col("o_orderkey") % 7 == 0, F.array(F.date_add(base, 20)))
    out = calculators.reviewed_deadline(F.col("d"), base, F.lit(2), F.lit("calendar_years"), given, caps)
    return o.select("o_orderkey", out.alias("r")).select("o_orderkey", "r.status", F.date_format("r.date", "yyyy-MM-dd").alias("due"), "r.capped")


@register("c6_rules_of_sections", "WITH s AS (SELECT s_suppkey AS section_id, s_nationkey AS j, 'usc:' || (s_suppkey % 50 + 1) || ':' || s_suppkey AS key FROM supplier), r AS (SELECT p_partkey AS rule_id, p_partkey % 25 AS j, 'usc:' || (p_partkey % 50 + 1) || ':' || (p_partkey % 150) AS key, p_partkey % 100 AS held FROM part), m AS (SELECT section_id, rule_id, 'citation' AS how FROM s JOIN r ON s.j = r.j AND s.key = r.key UNION SELECT section_id, rule_id, 'captured_text' FROM s JOIN r ON s.j = r.j AND section_id = held) SELECT section_id, rule_id, string_agg(how, ',' ORDER BY how) AS matched_by FROM m GROUP BY 1, 2")
def c6_rules_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section_id"), F.col("s_nationkey").cast("long").alias("jurisdiction"), F.expr("concat('usc:', s_suppkey % 50 + 1, ':', s_suppkey)").alias("key"))
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), (F.col("p_partkey") % 25).alias("jurisdiction"), F.expr("concat('under ', p_partkey % 50 + 1, ' U.S.C. § ', p_partkey % 150)").alias("pinpoint"), F.array(F.col("p_partkey") % 100).alias("captured"))
    return citations.rules_of_sections(r, s).select("section_id", "rule_id", F.array_join("matched_by", ",").alias("matched_by"))


@register("c8_rule_matrix", "SELECT c_nationkey, min(c_custkey % 60 + 1) FILTER (c_custkey % 3 = 0)::INT AS response_service, min(c_custkey % 60 + 1) FILTER (c_custkey % 3 = 1)::INT AS response_filing, min(c_custkey % 60 + 1) FILTER (c_custkey % 3 = 2)::INT AS reply_filing FROM customer GROUP BY 1")
def c8_rule_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that practice texts allow, by measure and anchor, the shortest of each branch."""
    said = F.expr("concat(CASE c_custkey % 3 WHEN 0 THEN 'A response is due within ' WHEN 1 THEN 'Opposition must be filed within ' ELSE 'A reply is due within ' END, c_custkey % 60 + 1, ' days after ', CASE WHEN c_custkey % 3 = 0 THEN 'service' ELSE 'filing' END, ' of the motion.')")
    t = table(spark, sf_dir, "customer").select("c_nationkey", said.alias("t"))
    measure = tf.category("t", [("reply", r"(?i)\breply\b"), ("response", r"(?i)\b(response|opposition)\b")], "other")
    anchor = tf.category("t", [("service", r"(?i)after service"), ("filing", r"(?i)after filing")], "none")
    days = F.regexp_extract("t", r"within (\d+) days", 1).try_cast("int")
    cells = t.select("c_nationkey", F.concat_ws("_", measure, anchor).alias("cell"), days.alias("days"))
    return cells.groupBy("c_nationkey").pivot("cell", ["response_service", "response_filing", "reply_filing"]).agg(F.min("days"))
