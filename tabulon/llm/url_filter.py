"""URL filters by rules, and for urls without a rule by trust and distrust spread over host edges.

Host edges come from the pages' html: a host named in a link or in the text of another host's page.  Trust flows along
the edges from hosts whose pages the rules allow (personalised PageRank); distrust flows against them from hosts whose
pages the rules block.  Both walks advance together, one join and one aggregation a round, until what is still to be
added to all scores together is below TOLERANCE; the threshold is compared at 9 digits.  A host's seed is the share
of its pages that the rules allow or block, so scores do not shrink as the graph grows; a host is blocked when distrust
exceeds trust by as much as a host has of itself when half its pages are blocked by rule.

DataFrame functions only.  Defined results: a null url, or one without "://", has an empty host and path and is allowed;
null html names no hosts; repeated pages count as often as they occur; a null page_id is kept; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import Buckets, shuffle_width, stored, tidy

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, TOLERANCE = 0.85, 1e-10
STEP = 4  # rounds between two writes
HUB = 100_000  # edges of one host that are joined under one key; a hub's are dealt over as many keys as it takes
NAMED = r"(?:(?:https?:)?//)?(?<![A-Za-z0-9-])(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(rest, r"^[^?#]*", 0)


def _by_rule(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits host and path; nulls if none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0])):
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, text).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, what).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return rule, verdict


def _edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """(src, dst, w): pages of src that name dst; a bare name counts if it is a known host, a link always."""
    named = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(NAMED), F.lit(0)))).alias("said"))
    named = named.select("src", F.contains("said", F.lit("//")).alias("linked"), F.lower(F.regexp_replace("said", "^.*//", "")).alias("dst"))
    named = named.filter((F.col("src") != F.col("dst")) & (F.col("src") != "")).groupBy("src", "dst").agg(F.max("linked").alias("linked"), F.count("*").alias("w"))
    known = hosts.select(F.col("host").alias("dst"), F.lit(True).alias("known"))
    return named.join(known, "dst", "left").filter("linked or known").select("src", "dst", "w")


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, score) of the converged walks, or after so many rounds.

    seeds: (kind, host, seed), kind trust or distrust; edges: (src, dst, w).  A round passes on what the last one added;
    no round adds more than damping times the one before, so what all further ones add is bounded.  Edges are stored once,
    in buckets, and stay where they are.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("at"), F.col("dst").alias("to"), "w").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("at"), F.col("src").alias("to"), "w"))
    total = stored(both.groupBy("kind", "at").agg(F.sum("w").alias("total"), F.ceil(F.count("*") / HUB).cast("int").alias("salts")), "host-degrees")
    salts = total.select("kind", F.col("at").alias("host"), "salts")
    both = both.join(total, ["kind", "at"]).select("kind", "at", "to", (F.col("w") / F.col("total")).alias("share"), F.pmod(F.xxhash64("to"), F.col("salts")).cast("int").alias("salt"))
    both = both.join(salts.withColumnsRenamed({"host": "to", "salts": "to_salts"}), ["kind", "to"], "left").withColumn("to_salts", F.coalesce("to_salts", F.lit(1)))
    own = ((1 - damping) * F.col("seed")).alias("score")
    score = seeds.join(salts, ["kind", "host"], "left").select("kind", "host", own, own.alias("added"), F.coalesce("salts", F.lit(1)).alias("salts"))
    n = shuffle_width(edges.sparkSession)
    with Buckets(edges.sparkSession, n, *EDGE_KEY) as buckets:
        held = edges.sparkSession.table(buckets.stored(both.repartition(n, *EDGE_KEY), "edges"))
        k = 0
        while rounds is None or k < rounds:
            moved = _passed_on(held, score, damping)
            score = score.select("kind", "host", "score", F.lit(0.0).alias("added"), "salts").unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("added").alias("added"), F.max("salts").alias("salts"))
            k += 1
            if k % STEP == 0:
                score = stored(score, "host-scores")
                if rounds is None and (score.agg(F.sum("added")).first()[0] or 0.0) * damping / (1 - damping) < tolerance:
                    break
        return stored(score.select("kind", "host", "score"), "host-totals")


EDGE_KEY = ("kind", "at", "salt")


def _passed_on(edges: DataFrame, score: DataFrame, damping: float) -> DataFrame:
    """(kind, host, score, added, salts): what hosts whose score has grown add to others.  Edges lie in buckets by the key
    of this join, so only these hosts are moved, not the edges."""
    last = score.filter("added > 0").select("kind", F.col("host").alias("at"), "added", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    added = (damping * F.col("share") * F.col("added")).alias("added")
    return edges.join(last, [*EDGE_KEY]).select("kind", F.col("to").alias("host"), added.alias("score"), added, F.col("to_salts").alias("salts"))


@tidy
def judge_urls(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = _by_rule(rules)
    pages = df.select("page_id", host.alias("host"), path.alias("path"), "html").withColumn("rule", rule).withColumn("by_rule", verdict)
    hosts = stored(pages.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")), "hosts")
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", (F.col("allowed") / F.col("n")).alias("seed")).unionByName(hosts.select(F.lit("distrust").alias("kind"), "host", (F.col("blocked") / F.col("n")).alias("seed"))).filter("seed > 0 and host <> ''")
    score = spread(_edges(pages, hosts), seeds, damping, rounds)
    by_host = score.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"))
    by_host = stored(by_host.withColumn("bad", F.round(F.col("distrust") - F.col("trust"), 9) >= round((1 - damping) / 2, 9)), "host-verdicts")
    out = pages.drop("html").join(by_host, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"))
