"""Aggregations beyond a plain group-by: facets, shares, concentration, folds, survey variance, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.operators.ranking import nearest_ranks


def facet_counts(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(value, n, total, distinct_values, truncated): the most frequent values, ties by value."""
    groups = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    facts = groups.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))  # one row
    top = groups.orderBy(F.desc("n"), "value").limit(limit)
    return top.crossJoin(F.broadcast(facts)).withColumn("truncated", F.col("distinct_values") > limit)


def most_frequent(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Each group's most frequent value, ties by value."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("o"), F.col(column).alias("v")))
    return counted.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(out))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in an order that should end in an id."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def concentration(df: DataFrame, keys: list[str], unit: str, value: str, top: int) -> DataFrame:
    """(keys, units, hhi, top_share): Herfindahl index on shares in percent, and the largest units' share."""
    by_unit = df.groupBy(*keys, unit).agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*keys)
    share = F.col("_v") / F.sum("_v").over(w)
    ranked = by_unit.withColumn("_s", share).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_v"), unit)))
    return ranked.groupBy(*keys).agg(F.count("*").alias("units"), F.sum(F.pow(100 * F.col("_s"), 2)).alias("hhi"), F.sum(F.when(F.col("_r") <= top, F.col("_s"))).alias("top_share"))


def shares(df: DataFrame, keys: list[str], part: str, count: str = "n") -> DataFrame:
    """(keys, part, n, share, share_of_known): parts' shares of all rows, and of those whose part is known."""
    counted = df.groupBy(*keys, part).agg(F.count("*").alias(count))
    w = Window.partitionBy(*keys)
    known = F.sum(F.when(F.col(part).isNotNull(), F.col(count))).over(w)
    return counted.withColumn("share", F.col(count) / F.sum(count).over(w)).withColumn("share_of_known", F.when(F.col(part).isNotNull(), F.col(count) / known))


def fold_tail(df: DataFrame, name: str, value: str, n: int, other: str = "Other") -> DataFrame:
    """(name, value): the n largest and the rest in one; n + 1 parts are all shown, nulls stay apart and never add."""
    known = df.filter(F.col(value).isNotNull()).groupBy(name).agg(F.sum(value).alias(value))
    top = known.orderBy(F.desc(value), name).limit(n + 2)  # as many rows as tell whether there is a tail
    shown = top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(value), name))).withColumn("_all", F.count("*").over(Window.partitionBy())).filter((F.col("_r") <= n) | (F.col("_all") <= n + 1)).select(name, value)
    rest = known.join(F.broadcast(shown.select(F.col(name).alias("_n"))), F.col(name).eqNullSafe(F.col("_n")), "left_anti")
    tail = rest.agg(F.count("*").alias("_c"), F.sum(value).alias(value)).filter("_c > 0").select(F.lit(other).alias(name), value)
    return shown.unionByName(tail).unionByName(df.filter(F.col(value).isNull()).select(name, value))


def class_breaks(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """One row, breaks: nearest-rank quantiles of the positive values, equal ones merged."""
    marks = {f"q{k}": k / classes for k in range(1, classes + 1)}
    ranked = nearest_ranks(df.filter(F.col(value) > 0), [], value, marks)
    return ranked.select(F.array_distinct(F.array(*marks)).alias("breaks"))


def duplicate_groups(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows")).filter("rows > 1")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, blank, untrimmed, distinct_values) in one pass over the table."""
    parts = []
    for c in columns:
        s = F.col(c).cast("string")
        parts += [F.count("*").alias(f"{c}__rows"), F.count_if(s.isNull() | (F.trim(s) == "")).alias(f"{c}__blank"), F.count_if(F.trim(s) != s).alias(f"{c}__untrimmed"), F.approx_count_distinct(s, 0.01).alias(f"{c}__approx_values")]
    wide = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in ("rows", "blank", "untrimmed", "approx_values")]) for c in columns])
    return wide.select(F.inline(rows))


def quality(df: DataFrame, id_col: str, columns: list[str], days: dict[str, tuple[str, str]] | None = None, parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(check, subject, n): what is wrong with a table, in one pass and a join per parent.

    rows; blank and untrimmed by column; bad_dates: texts that are no day from the first to the last of `days`[column];
    bad_ids: null, or not made of digits; duplicate_ids: rows beyond the first of an id; orphans: rows whose value, not
    null, is in no row of the parent table.
    """
    found = {("rows", ""): F.count("*")}
    for c in columns:
        s = F.col(c).cast("string")
        found |= {("blank", c): F.count_if(s.isNull() | (F.trim(s) == "")), ("untrimmed", c): F.count_if((F.trim(s) != s) & (F.trim(s) != ""))}
    for c, (first, last) in (days or {}).items():
        day = F.try_to_date(F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c)), "yyyy-MM-dd")
        found["bad_dates", c] = F.count_if(~F.coalesce(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False)))
    good = F.coalesce(F.col(id_col).cast("string").rlike(r"^\d+$"), F.lit(False))
    found["bad_ids", id_col] = F.count_if(~good)
    names = {k: f"c{n}" for n, k in enumerate(found)}
    wide = df.agg(*[v.alias(names[k]) for k, v in found.items()])
    out = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("check"), F.lit(b).alias("subject"), F.col(n).alias("n")) for (a, b), n in names.items()])))
    again = df.filter(good).groupBy(id_col).agg((F.count("*") - 1).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    out = out.unionByName(again.select(F.lit("duplicate_ids").alias("check"), F.lit(id_col).alias("subject"), "n"))
    for c, (parent, key) in (parents or {}).items():
        alone = df.filter(F.col(c).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(c) == F.col("_key"), "left_anti").agg(F.count("*").alias("n"))
        out = out.unionByName(alone.select(F.lit("orphans").alias("check"), F.lit(c).alias("subject"), "n"))
    return out


def survey_total(df: DataFrame, keys: list[str], stratum: str, unit: str, weight: str, value: str) -> DataFrame:
    """(keys, n, total, variance, cv): weighted total with the between-unit variance within strata of a design.

    All units of a stratum count, also those without a case in the domain: their number comes from the whole table.
    """
    units = df.groupBy(stratum).agg(F.countDistinct(unit).alias("_m"))
    by_unit = df.groupBy(*keys, stratum, unit).agg(F.sum(F.col(weight) * F.col(value)).alias("_t"), F.count("*").alias("_n"))
    by_stratum = by_unit.groupBy(*keys, stratum).agg(F.sum("_t").alias("_t"), F.sum(F.col("_t") * F.col("_t")).alias("_tt"), F.sum("_n").alias("_n")).join(units, stratum)
    var = F.when(F.col("_m") > 1, F.col("_m") / (F.col("_m") - 1) * (F.col("_tt") - F.col("_t") * F.col("_t") / F.col("_m"))).otherwise(0.0)
    out = by_stratum.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_t").alias("total"), F.sum(var).alias("variance"))
    return out.withColumn("cv", F.try_divide(F.sqrt(F.greatest("variance", F.lit(0.0))), F.col("total")))


def survey_ratio(df: DataFrame, keys: list[str], stratum: str, unit: str, weight: str, part: Column) -> DataFrame:
    """(keys, n, total, part, share, variance, share_variance): weighted totals of all cases and of those where `part` holds,
    their share, the total's variance, and the share's by linearisation.

    The share's variance is that of the total of the residuals y - share * x of a design's units, over the square of the
    total; squares and products of the units' sums are added up by stratum, so one pass does for any number of domains.
    """
    units = df.groupBy(stratum).agg(F.countDistinct(unit).alias("_m"))
    w = F.col(weight).cast("double")
    own = df.groupBy(*keys, stratum, unit).agg(F.sum(w).alias("_x"), F.sum(F.when(part, w).otherwise(0.0)).alias("_y"), F.count("*").alias("_n"))
    x, y = F.col("_x"), F.col("_y")
    sums = own.groupBy(*keys, stratum).agg(F.sum(x).alias("_sx"), F.sum(y).alias("_sy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"), F.sum(x * y).alias("_xy"), F.sum("_n").alias("_n")).join(units, stratum)

    def between(a: str, b: str, product: str) -> Column:
        m = F.col("_m")
        return F.sum(F.when(m > 1, m / (m - 1) * (F.col(product) - F.col(a) * F.col(b) / m)).otherwise(0.0))

    out = sums.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_sx").alias("total"), F.sum("_sy").alias("part"), between("_sx", "_sx", "_xx").alias("_vx"), between("_sy", "_sy", "_yy").alias("_vy"), between("_sx", "_sy", "_xy").alias("_cxy"))
    share = F.try_divide(F.col("part"), F.col("total"))
    spread = F.greatest(F.col("_vy") - 2 * F.col("share") * F.col("_cxy") + F.col("share") * F.col("share") * F.col("_vx"), F.lit(0.0))
    return out.withColumn("share", share).select(*keys, "n", "total", "part", "share", F.greatest("_vx", F.lit(0.0)).alias("variance"), F.try_divide(spread, F.col("total") * F.col("total")).alias("share_variance"))


def moe_sum(moe: Column | str) -> Column:
    """Root of the sum of squares; null if any margin is missing."""
    c = F.col(moe) if isinstance(moe, str) else moe
    return F.when(F.count(c) == F.count("*"), F.sqrt(F.sum(c * c)))


def tree_check(df: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """(parent, own, children, state) where a parent's total is compared with its children's: whole, short or over."""
    kids = df.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(F.sum(value).alias("children"))
    both = df.join(kids, F.col(node) == F.col("_p")).select(F.col(node).alias("parent"), F.col(value).alias("own"), "children")
    return both.withColumn("state", F.when(F.col("own") == F.col("children"), "whole").when(F.col("own") > F.col("children"), "short").otherwise("over"))


def watch_summary(df: DataFrame, unit: str, day: str, outcome: str, good: str, as_of: Column) -> DataFrame:
    """(month, good, other, units, partial): outcomes of each month from the first to the last, months without any as
    zeros; units are distinct within the month; the month of the as-of date and later ones are partial."""
    d = df.filter(F.col(day).isNotNull()).withColumn("month", F.to_date(F.date_trunc("month", F.col(day))))
    span = d.agg(F.min("month").alias("a"), F.max("month").alias("z"))  # one row
    spine = span.select(F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    n = d.groupBy("month").agg(F.count_if(F.col(outcome) == good).alias("good"), F.count_if(~F.col(outcome).eqNullSafe(F.lit(good))).alias("other"), F.countDistinct(unit).alias("units"))
    out = spine.join(n, "month", "left").na.fill(0, ["good", "other", "units"])
    return out.withColumn("partial", F.col("month") >= F.to_date(F.date_trunc("month", as_of)))


def board(places: DataFrame, vacancies: DataFrame, months: DataFrame, key: str) -> DataFrame:
    """places with a pending load, and beside each its vacancies (key, status, days) and vacant months (key, months, rank).

    open and announced are counted, longest_open is the largest number of days; places without any show 0 and null.
    """
    v = vacancies.groupBy(key).agg(F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "announced").alias("announced"), F.max("days").alias("longest_open"))
    return places.filter("pending > 0").join(v, key, "left").join(months, key, "left").na.fill(0, ["open", "announced"])


def path_flows(df: DataFrame, path: str) -> DataFrame:
    """(step, src, dst, n): moves between neighbouring entries of array paths."""
    pair = F.arrays_zip(F.slice(F.col(path), F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))).alias("src"), F.slice(F.col(path), F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))).alias("dst"))
    return df.filter(F.size(path) > 1).select(F.posexplode(pair).alias("step", "m")).groupBy("step", "m.src", "m.dst").agg(F.count("*").alias("n"))
