"""Joins that Spark has no single operator for, composed of equi-joins and aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.sources.scratch import stored


def first_on_or_after(left: DataFrame, events: DataFrame, on: str, at: str, event: str, out: str, chunk: str = "month") -> DataFrame:
    """left with the earliest event of the same key on or after its own date; null without one.

    Dates and events of a key are sorted together by chunks of time, so a key with very many of both costs no more than
    their sum.
    """
    return first_after_by_union(left, events, on, at, event, out, chunk)


def unique_match(left: DataFrame, right: DataFrame, on: str, value: str, out: str, status: str = "match_status") -> DataFrame:
    """left with right's value where exactly one right row has the key; status matched, ambiguous or unmatched."""
    one = right.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    joined = left.join(one, on, "left")
    state: Column = F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "ambiguous").otherwise("matched")
    return joined.withColumn(out, F.when(F.col("_n") == 1, F.col("_v"))).withColumn(status, state).drop("_n", "_v")


def _along(both: DataFrame, on: str, order: list, value: str, chunk: str, after: bool) -> DataFrame:
    """both with `value` filled along time `_t` within each key: the last known one before, or the first after, a row.

    Time is cut into chunks.  A chunk of a key is a window of its own; between chunks only one value per key and chunk
    is carried, so a key with very many rows is spread over as many tasks as it has chunks.
    """
    from pyspark.sql.window import Window

    d = both.withColumn("_b", F.date_trunc(chunk, F.col("_t")))
    inner = Window.partitionBy(on, "_b").orderBy(*order)
    pick, edge = (F.first, inner.rowsBetween(0, Window.unboundedFollowing)) if after else (F.last, inner.rowsBetween(Window.unboundedPreceding, 0))
    known = F.when(F.col(value).isNotNull(), F.struct("_t", F.col(value).alias("v")))
    ends = d.groupBy(on, "_b").agg((F.min(known) if after else F.max(known)).alias("_e"))
    outer = Window.partitionBy(on).orderBy("_b")  # a row per key and chunk
    beyond = F.first("_e", ignorenulls=True).over(outer.rowsBetween(1, Window.unboundedFollowing)) if after else F.last("_e", ignorenulls=True).over(outer.rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(F.col(on).alias("_k"), F.col("_b").alias("_c"), beyond["v"].alias("_carried"))
    out = d.withColumn(value, pick(value, ignorenulls=True).over(edge)).join(carried, F.col(on).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_c")))
    return out.withColumn(value, F.coalesce(value, "_carried")).drop("_b", "_k", "_c", "_carried")


def first_after_by_union(left: DataFrame, events: DataFrame, on: str, at: str, event: str, out: str, chunk: str = "day") -> DataFrame:
    """first_on_or_after() for left rows that are many per key: sorts of the keys' time chunks instead of a join on the key."""
    a = left.select("*", F.col(at).alias("_t"), F.lit(True).alias("_left"), F.lit(None).cast(events.schema[event].dataType).alias(out))
    b = events.select(on, F.col(event).alias("_t"), F.lit(False).alias("_left"), F.col(event).alias(out))
    both = _along(a.unionByName(b, allowMissingColumns=True), on, ["_t", F.desc("_left")], out, chunk, after=True)
    return both.filter("_left").select(*left.columns, out)


def as_of(left: DataFrame, right: DataFrame, on: str, at: str, right_at: str, values: list[str], chunk: str = "day") -> DataFrame:
    """left with the values of the latest right row of the same key at or before its own time."""
    kept = F.struct(F.col(right_at), *[F.col(v) for v in values])
    a = left.select("*", F.col(at).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(right.select(kept.alias("s")).schema["s"].dataType).alias("_s"))
    b = right.select(on, F.col(right_at).alias("_t"), F.lit(0).alias("_o"), kept.alias("_s"))
    both = _along(a.unionByName(b, allowMissingColumns=True), on, ["_t", "_o", "_s"], "_s", chunk, after=False)
    return both.filter("_o = 1").select(*left.columns, *[F.col("_s")[v].alias(v) for v in values])


def within_months(left: DataFrame, right: DataFrame, on: str, month: str, right_month: str, reach: int) -> DataFrame:
    """Pairs of the same key whose month indexes differ by at most `reach`.

    Both sides are dealt into bins of reach + 1 months and the left one is copied to its neighbours: an equi-join.
    """
    width = reach + 1
    a = left.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(month) / width) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_bin", F.floor(F.col(right_month) / width))
    return a.join(b, [on, "_bin"]).filter(F.abs(F.col(month) - F.col(right_month)) <= reach).drop("_bin")


def valid_at(df: DataFrame, start: str, end: str, day: Column) -> DataFrame:
    """Rows that are open at a day: begun by then, and not ended or ended later."""
    return df.filter((F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) > day)))


def null_tolerant(left: DataFrame, right: DataFrame, on: str, loose: str) -> DataFrame:
    """Equal keys, and the loose column equal or missing on either side; right's loose column is named right_<loose>."""
    r = right.withColumnRenamed(loose, f"right_{loose}")
    return left.join(r, on).filter((F.col(loose) == F.col(f"right_{loose}")) | F.col(loose).isNull() | F.col(f"right_{loose}").isNull())


def changes(held: DataFrame, offered: DataFrame, id_col: str, payload: list[str]) -> DataFrame:
    """(id, change): insert, update or unchanged for every offered row, gone for held rows that are not offered."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(id_col, F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256).alias(name))

    both = digest(held, "_h").join(digest(offered, "_o"), id_col, "full")
    change = F.when(F.col("_h").isNull(), "insert").when(F.col("_o").isNull(), "gone").when(F.col("_h") == F.col("_o"), "unchanged").otherwise("update")
    return both.select(id_col, change.alias("change"))


def close_spellings(df: DataFrame, word: str, most: int = 2, share: int = 1000) -> DataFrame:
    """Pairs of distinct words (a < b) within an edit distance.

    Words that are that close share one of most + 1 equal parts of the longer word nearly at the same place; parts are
    the join key, so no word meets all others.
    """
    words = df.select(F.col(word).alias("w")).filter("w is not null").distinct().withColumn("n", F.length("w"))
    parts = most + 1
    cut = words.withColumn("size", F.ceil(F.col("n") / parts).cast("int"))
    # left: the word's own parts; right: every substring of every length a partner's part may have, near that place
    own = cut.select("w", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(k.alias("k"), F.substring(F.col("w"), k * F.col("size") + 1, F.col("size")).alias("p"), (k * F.col("size") + 1).alias("at")))).alias("x")).select(F.col("w").alias("a"), F.col("n").alias("na"), "x.*")
    near = words.withColumn("m", F.explode(F.sequence(F.greatest(F.col("n") - most, F.lit(1)), F.col("n") + most)))
    near = near.withColumn("size", F.ceil(F.col("m") / parts).cast("int"))
    at = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.struct(k.alias("k"), F.substring(F.col("w"), F.greatest(k * F.col("size") + 1 + d, F.lit(1)), F.col("size")).alias("p"))))))
    near = near.select(F.col("w").alias("b"), "m", at.alias("y")).select("b", "m", "y.*").distinct()
    # a part that very many words have is dealt into shares of its own words, each of which meets all partners
    many = own.groupBy("k", "p", "na").agg(F.ceil(F.count("*") / share).cast("int").alias("shares")).filter("shares > 1")
    own = own.join(many, ["k", "p", "na"], "left").withColumn("share", F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1))).cast("int"))
    near = near.join(many.withColumnRenamed("na", "m"), ["k", "p", "m"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
    pairs = own.join(near, (own["k"] == near["k"]) & (own["p"] == near["p"]) & (own["na"] == near["m"]) & (own["share"] == near["share"])).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= most)


def ancestors(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, ancestor, steps): every chain of parents upwards, stopping at a cycle; chains double each round until no pair is new."""
    known = df.filter(F.col(parent).isNotNull() & (F.col(node) != F.col(parent))).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps")).distinct()
    n = known.count()
    while True:
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor"), (F.col("a.steps") + F.col("b.steps")).alias("steps"))
        known = stored(known.unionByName(longer).filter("node <> ancestor").groupBy("node", "ancestor").agg(F.min("steps").alias("steps")), "chains")
        before, n = n, known.count()
        if n == before:
            return known


def neighbours(edges: DataFrame, source: str = "src", target: str = "dst", kind: str = "kind") -> DataFrame:
    """(node, kind, direction, n): how many neighbours each node has by edge type and direction."""
    out = edges.select(F.col(source).alias("node"), F.col(kind).alias("kind"), F.lit("out").alias("direction"), F.col(target).alias("other"))
    back = edges.select(F.col(target).alias("node"), F.col(kind).alias("kind"), F.lit("in").alias("direction"), F.col(source).alias("other"))
    return out.unionByName(back).groupBy("node", "kind", "direction").agg(F.countDistinct("other").alias("n"))


def cited_paths(nodes: DataFrame, edges: DataFrame, path: str = "path", position: str = "pos", node: str = "node") -> DataFrame:
    """(path, nodes, problem, shown): is each path a chain, and how it reads.

    nodes: (path, pos from 0, node); edges: (path, pos, src, dst, kind, visible), the edge at pos lies between the nodes at
    pos and pos + 1.  problem: null; or count (not one edge between each pair, or none at all), hidden, or disconnected (an
    edge that does not join its neighbours, in either direction).  shown, of whole paths: the nodes in order, with the
    kind of each edge and > or < for its direction.
    """
    n = nodes.groupBy(path).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(path).agg(F.count("*").alias("_e"), F.countDistinct(position).alias("_places"))
    a = nodes.select(path, position, F.col(node).alias("_a"))
    b = nodes.select(path, (F.col(position) - 1).alias(position), F.col(node).alias("_b"))
    met = edges.join(a, [path, position], "left").join(b, [path, position], "left")
    ahead = (F.col("src") == F.col("_a")) & (F.col("dst") == F.col("_b"))
    back = (F.col("dst") == F.col("_a")) & (F.col("src") == F.col("_b"))
    met = met.withColumn("_way", F.when(ahead, ">").when(back, "<")).withColumn("_seen", F.coalesce("visible", F.lit(False)))
    step = F.struct(position, F.concat(F.col("kind"), F.col("_way"), F.col("_b").cast("string")).alias("text"))
    judged = met.groupBy(path).agg(F.bool_and("_seen").alias("_seen"), F.bool_and(F.col("_way").isNotNull()).alias("_joined"), F.sort_array(F.collect_list(step)).alias("_steps"))
    first = nodes.filter(F.col(position) == 0).select(path, F.col(node).cast("string").alias("_first"))
    out = n.join(e, path, "left").join(judged, path, "left").join(first, path, "left")
    edges_there = F.coalesce("_e", F.lit(0))
    problem = F.when((edges_there != F.col("nodes") - 1) | (F.coalesce("_places", F.lit(0)) != edges_there), "count").when(~F.coalesce("_joined", F.lit(True)), "disconnected").when(~F.coalesce("_seen", F.lit(True)), "hidden")
    shown = F.array_join(F.concat(F.array("_first"), F.coalesce(F.transform("_steps", lambda x: x["text"]), F.array().cast("array<string>"))), " ")
    return out.withColumn("problem", problem).select(path, "nodes", "problem", F.when(F.col("problem").isNull(), shown).alias("shown"))


PART_PAIRS = 2_000_000  # pairs of items that one task counts


def together(df: DataFrame, group: str, item: str, least: int = 1, block: int = 1000) -> DataFrame:
    """(a, b, n): groups in which two items occur together.

    A group of more than about `block` items is dealt into blocks, and each pair of blocks is a join key of its own.  The
    pairs to come are added up beforehand, and as many parts are made that none has more than about PART_PAIRS: neither the
    join's nor the counting's tasks grow with the table.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = df.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g is not null and i is not null")
    one = one.repartition(max(width, math.ceil(one.count() / PART_PAIRS)), "g").distinct()
    size = one.groupBy("g").agg(F.count("*").alias("n"))
    expected = size.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    parts = max(width, math.ceil(expected / PART_PAIRS))
    dealt = one.join(size.select("g", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "g").withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    a = dealt.select("g", F.col("own").alias("p"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("q"), F.col("i").alias("x"))
    b = dealt.select("g", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("p"), F.col("own").alias("q"), F.col("i").alias("y"))
    a, b = (d.repartition(parts, "g", "p", "q") for d in (a, b))
    pairs = a.join(b, ["g", "p", "q"]).filter("p < q or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = pairs.repartition(parts, "a", "b")  # before they are counted: a task's table of distinct pairs would grow with its input
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
