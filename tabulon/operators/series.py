"""Time series: spines and gaps, lags by calendar, windows with coverage, cohorts, peaks, flows between snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.functions.dates import month_index


def month_spine(df: DataFrame, keys: list[str], month: str) -> DataFrame:
    """(keys, month): every month from each key's first to its last."""
    span = df.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_z"))
    return span.select(*keys, F.explode(F.sequence("_a", "_z", F.expr("INTERVAL 1 MONTH"))).alias(month))


def densified(df: DataFrame, keys: list[str], month: str, value: str, fill: float | None = None) -> DataFrame:
    """One row per key and month; a missing month is a gap (null) unless the source is a census and `fill` is given."""
    out = month_spine(df, keys, month).join(df.select(*keys, month, value), [*keys, month], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def lag_change(df: DataFrame, keys: list[str], month: str, value: str, k: int) -> DataFrame:
    """Adds before, change and pct: against the same key exactly k months earlier, null if either end is missing."""
    earlier = df.select(*keys, F.add_months(month, k).alias(month), F.col(value).alias("before"))
    out = df.join(earlier, [*keys, month], "left")
    return out.withColumn("change", F.col(value) - F.col("before")).withColumn("pct", F.when(F.col("before") > 0, 100.0 * (F.col(value) - F.col("before")) / F.col("before")))


def peak(value: str, at: str) -> Column:
    """(value, at) of the highest value, the earliest of equals; nulls never win."""
    key = F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("o"), F.col(at).alias("at"), F.col(value).alias("value")))
    return F.min(key)


def complete_buckets(df: DataFrame, keys: list[str], day: str, value: str, unit: str) -> DataFrame:
    """(keys, bucket, value, days): sums per day, week (from Monday) or month; null unless every day in it is known."""
    bucket = F.to_date(F.date_trunc(unit, F.col(day)))
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.when(F.count(value) == F.count("*"), F.sum(value)).alias("value"), F.count("*").alias("days"))


def recent_and_before(values: str, covered_from: Column, window_end: Column, months: int) -> tuple[Column, Column]:
    """Sums of the last `months` entries of a dense monthly array and of as many before; null where not covered."""
    n = (month_index(window_end) - month_index(covered_from) + 1).cast("int")  # entries up to the window's end

    def total(to: Column) -> Column:
        part = F.slice(F.col(values), F.greatest(to - months + 1, F.lit(1)), F.lit(months))
        return F.when((to >= months) & (to <= F.size(values)), F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)).cast("long")))

    return total(n), total(n - months)


def rising(df: DataFrame, keys: list[str], period: str, value: str, latest: Column, k: int) -> DataFrame:
    """(keys, recent, prior, ratio): last k periods against the k before, only where all 2 k are recorded."""
    d = df.filter((F.col(period) > latest - 2 * k) & (F.col(period) <= latest))
    out = d.groupBy(*keys).agg(F.count(value).alias("_n"), F.sum(F.when(F.col(period) > latest - k, F.col(value))).alias("recent"), F.sum(F.when(F.col(period) <= latest - k, F.col(value))).alias("prior"))
    return out.filter(F.col("_n") == 2 * k).withColumn("ratio", F.try_divide(F.col("recent").cast("double"), F.col("prior"))).drop("_n")


def cohorts(df: DataFrame, keys: list[str], period: str, value: str, threshold: float, reach: int) -> DataFrame:
    """(keys, offset, value): periods counted from the first one that reaches the threshold."""
    start = df.filter(F.col(value) >= threshold).groupBy(*keys).agg(F.min(period).alias("_s"))
    d = df.join(start, keys).withColumn("offset", F.col(period) - F.col("_s"))
    return d.filter(F.col("offset").between(0, reach)).select(*keys, "offset", value)


def snapshot_flows(df: DataFrame, period: str, unit: str) -> DataFrame:
    """(period, entered, left, stayed) between each snapshot and the one before it."""
    d = df.select(period, F.col(unit).alias("_u")).distinct()
    times = d.select(period).distinct().withColumn("_prev", F.lag(period).over(Window.orderBy(period)))  # one row per snapshot
    now = d.join(times, period).select(period, F.col("_prev"), "_u")
    was = d.join(times.select(F.col(period).alias("_now"), F.col("_prev").alias(period)), period).select(F.col("_now").alias(period), "_u", F.lit(True).alias("_was"))
    both = now.filter("_prev is not null").select(period, "_u", F.lit(True).alias("_is")).join(was, [period, "_u"], "full")
    return both.groupBy(period).agg(F.count_if(F.col("_was").isNull()).alias("entered"), F.count_if(F.col("_is").isNull()).alias("left"), F.count_if(F.col("_is") & F.col("_was")).alias("stayed"))


def drawdown(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, drop): the largest fall from an earlier high."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_f", F.max(value).over(w) - F.col(value)).groupBy(*keys).agg(F.max("_f").alias("drop"))


def largest_drop(df: DataFrame, member: str, order: str, value: str) -> DataFrame:
    """One row (from, to, drop, member, member_drop): the largest fall of all members' total, from its highest period to a
    later one, and the member that fell most between these two; none if the total never falls.

    Earlier periods come first among equal ones, smaller names among equal members; a member counts if it is listed in
    both periods.
    """
    total = df.filter(F.col(value).isNotNull()).groupBy(F.col(order).alias("to")).agg(F.sum(value).alias("v"))
    upto = Window.orderBy("to").rowsBetween(Window.unboundedPreceding, 0)  # a row per period
    high = total.withColumn("high", F.max("v").over(upto))
    first = total.select(F.col("to").alias("from"), F.col("v").alias("high")).groupBy("high").agg(F.min("from").alias("from"))
    fall = high.join(first, "high").withColumn("drop", F.col("high") - F.col("v")).filter("drop > 0 and `from` < `to`").orderBy(F.desc("drop"), "to").limit(1)
    a = df.select(F.col(member).alias("member"), F.col(order).alias("from"), F.col(value).alias("before"))
    z = df.select(F.col(member).alias("member"), F.col(order).alias("to"), F.col(value).alias("after"))
    one = F.broadcast(fall.select("from", "to", "drop"))  # one row
    both = a.join(one, "from").join(z, ["member", "to"]).withColumn("member_drop", F.col("before") - F.col("after")).filter(F.col("member_drop").isNotNull())
    return both.orderBy(F.desc("member_drop"), "member").limit(1).select("from", "to", "drop", "member", "member_drop")


def trailing_mean(value: str, keys: list[str], order: str, n: int) -> Column:
    """Mean of the last n rows; null until n values are there."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def coverage_break(df: DataFrame, keys: list[str], year: str, value: str, factor: float = 5.0) -> DataFrame:
    """(keys, year): the first year at least `factor` times the year before with every earlier year at most a factor-th."""
    w = Window.partitionBy(*keys).orderBy(year)
    before = F.lag(value).over(w)
    highest = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("_hit", (F.col(value) >= factor * before) & (highest <= F.col(value) / factor))
    return d.filter("_hit").groupBy(*keys).agg(F.min(year).alias(year))


def leaders(df: DataFrame, frame: str, unit: str, value: str) -> DataFrame:
    """(frame, leader, changed): the largest unit of each frame, and whether it differs from the frame before."""
    best = df.groupBy(frame).agg(F.min(F.struct((-F.col(value)).alias("o"), F.col(unit).alias("u"))).alias("b")).select(frame, F.col("b.u").alias("leader"))
    before = F.lag("leader").over(Window.orderBy(frame))  # one row per frame
    return best.withColumn("changed", before.isNotNull() & (F.col("leader") != before))


def line_segments(df: DataFrame, keys: list[str], place: str, value: str, partial: str) -> DataFrame:
    """(keys, kind, first, last): stretches of neighbouring places with values, as a chart draws them.

    kind: solid or dashed (an edge is dashed if either end is partial; edges of one style in a row are one line), or dot
    for a value without a neighbour.  place counts from 0 without holes; a row's value may be null.
    """
    w = Window.partitionBy(*keys).orderBy(place)
    there = F.col(value).isNotNull()
    d = df.select(*keys, F.col(place).alias("_at"), there.alias("_is"), F.col(partial).alias("_p"), F.lead(there).over(w).alias("_next"), F.lead(F.col(partial)).over(w).alias("_np"), F.lag(there).over(w).alias("_was"))
    dots = d.filter(F.col("_is") & ~F.coalesce("_was", F.lit(False)) & ~F.coalesce("_next", F.lit(False))).select(*keys, F.lit("dot").alias("kind"), F.col("_at").alias("first"), F.col("_at").alias("last"))
    edges = d.filter(F.col("_is") & F.col("_next")).select(*keys, F.when(F.col("_p") | F.col("_np"), "dashed").otherwise("solid").alias("kind"), F.col("_at").alias("first"))
    e = Window.partitionBy(*keys).orderBy("first")
    fresh = (F.col("first") != F.lag("first").over(e) + 1) | (F.col("kind") != F.lag("kind").over(e))
    edges = edges.withColumn("_i", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(e.rowsBetween(Window.unboundedPreceding, 0)))
    lines = edges.groupBy(*keys, "kind", "_i").agg(F.min("first").alias("first"), (F.max("first") + 1).alias("last")).drop("_i")
    return lines.unionByName(dots)


def margin_runs(df: DataFrame, keys: list[str], place: str, value: str, margin: str) -> DataFrame:
    """(keys, first, last, lowest, highest): stretches of neighbouring places with a value and a margin of error."""
    good = df.filter(F.col(value).isNotNull() & (F.col(margin) >= 0))
    w = Window.partitionBy(*keys).orderBy(place)
    d = good.withColumn("_i", F.col(place) - F.row_number().over(w))
    return d.groupBy(*keys, "_i").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.min(F.col(value) - F.col(margin)).alias("lowest"), F.max(F.col(value) + F.col(margin)).alias("highest")).drop("_i")


def panorama(df: DataFrame, unit: str, report: str, value: str) -> DataFrame:
    """(unit, first, last, values): each unit's values at every report from its first to its last, null where it is not listed.

    Reports are numbered from 0 in their order; first and last are numbers.
    """
    n = df.select(report).distinct().withColumn("_i", F.row_number().over(Window.orderBy(report)) - 1)  # one row per report
    d = df.join(F.broadcast(n), report).groupBy(unit, "_i").agg(F.sum(value).alias("_v"))
    g = d.groupBy(unit).agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    return g.select(unit, "first", "last", F.transform(F.sequence("first", "last"), lambda i: F.try_element_at("_m", i)).alias("values"))


def report_frames(df: DataFrame, report: str, place: str, value: str) -> DataFrame:
    """(report, place, value, share): what each place holds at each report, and its share of the report."""
    d = df.groupBy(report, place).agg(F.sum(value).alias("value"))
    total = d.groupBy(report).agg(F.sum("value").alias("_t"))
    return d.join(total, report).select(report, place, "value", F.try_divide(F.col("value"), F.col("_t")).alias("share"))


def change_radar(df: DataFrame, part: str, section: str, versions: str, today: Column, since: Column) -> DataFrame:
    """(part, sections, changed, changes, latest, last12_sections, last12_changes): substantive changes of sections.

    versions: array<struct<date: date, substantive: boolean>> of each section; only those from `since` on count, and the
    last twelve months end today.
    """
    counted = F.filter(versions, lambda v: v["substantive"] & (v["date"] >= since))
    d = df.select(F.col(part).alias("part"), F.col(section).alias("_s"), counted.alias("_c"), today.alias("_t"))
    recent = F.filter("_c", lambda v: (v["date"] > F.add_months("_t", -12)) & (v["date"] <= F.col("_t")))
    d = d.withColumn("_r", F.size(recent)).withColumn("_n", F.size("_c")).withColumn("_l", F.array_max(F.transform("_c", lambda v: v["date"])))
    return d.groupBy("part").agg(F.count("*").alias("sections"), F.count_if(F.col("_n") > 0).alias("changed"), F.sum("_n").alias("changes"), F.max("_l").alias("latest"), F.count_if(F.col("_r") > 0).alias("last12_sections"), F.sum("_r").alias("last12_changes"))


def recent_changes(df: DataFrame, keys: list[str], day: str, today: Column, covered_from: Column, windows: tuple[int, ...]) -> DataFrame:
    """(keys, one column d<n> per window): entries of the last n days; null if the record does not reach back that far."""
    d = F.datediff(today, F.col(day))
    counts = [F.when(F.max(F.datediff(today, covered_from)) >= n, F.count_if((d >= 0) & (d < n))).alias(f"d{n}") for n in windows]
    return df.groupBy(*keys).agg(*counts)


def fiscal_partial(day: Column, first_recorded: Column, last_recorded: Column) -> Column:
    """Is a day's fiscal year only partly recorded?"""
    start = F.make_date(F.year(F.add_months(day, 3)) - 1, F.lit(10), F.lit(1))
    return (first_recorded > start) | (last_recorded < F.date_sub(F.add_months(start, 12), 1))


def aligned(points: DataFrame, markers: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """((id, x, value, common), (id, fate)): several series over the periods in which they can be compared.

    points: (id, nth, kind, x, value, partial), nth the series' place; markers: (id, x), where what is counted changes.
    Series of the most frequent kind of period are used (of equally frequent ones that of the first series), the others
    are left out.  What lies before a series' last marker, and unfinished periods, are dropped.  The periods kept run from
    the first to the last in which at least two series have a value, and there must be `least` such; a value that is not
    recorded is null.  common: the first period in which every series used has a positive value, else the first one.
    """
    series = points.groupBy("id").agg(F.min("nth").alias("nth"), F.min("kind").alias("kind"))
    kinds = series.groupBy("kind").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    chosen = kinds.orderBy(F.desc("n"), "first").limit(1).select(F.col("kind").alias("_kind"))
    fates = series.crossJoin(F.broadcast(chosen)).select("id", F.when(F.col("kind") == F.col("_kind"), "used").otherwise("left out").alias("fate"))
    last = markers.groupBy("id").agg(F.max("x").alias("_cut"))
    used = fates.filter("fate = 'used'").select("id")
    p = points.join(used, "id", "left_semi").join(last, "id", "left").filter((F.col("_cut").isNull() | (F.col("x") >= F.col("_cut"))) & ~F.coalesce("partial", F.lit(False)))
    p = p.groupBy("id", "x").agg(F.max("value").alias("value"))
    periods = p.groupBy("x").agg(F.count("value").alias("known"), F.count_if(F.col("value") > 0).alias("positive"))
    span = periods.agg(F.min(F.when(F.col("known") >= 2, F.col("x"))).alias("_a"), F.max(F.when(F.col("known") >= 2, F.col("x"))).alias("_z"), F.count_if(F.col("known") >= 2).alias("_n")).filter(F.col("_n") >= least)
    kept = periods.crossJoin(F.broadcast(span)).filter(F.col("x").between(F.col("_a"), F.col("_z")))
    number = used.agg(F.count("*").alias("_all"))
    common = kept.crossJoin(F.broadcast(number)).agg(F.coalesce(F.min(F.when(F.col("positive") == F.col("_all"), F.col("x"))), F.min("x")).alias("_common"))
    spine = kept.select("x").crossJoin(F.broadcast(used)).crossJoin(F.broadcast(common))  # a few series by their periods
    return spine.join(p, ["id", "x"], "left").select("id", "x", "value", (F.col("x") == F.col("_common")).alias("common")), fates


# fixed values: forms that report whole years, and those that report quarters too; days of a year and of a quarter
ANNUAL_FORMS = ("10-K", "10-K405", "10-KT", "20-F", "40-F")
ALL_FORMS = (*ANNUAL_FORMS, "10-Q")
YEAR_DAYS, QUARTER_DAYS, FIRST_DAYS = (340, 380), (80, 100), 7


def reported(facts: DataFrame, keys: list[str], concepts: list[str]) -> DataFrame:
    """(keys, grain, start, end, fiscal_year, concept, value, form, filed): one value a period, the latest filed.

    facts: (keys, concept, start, end, value, form, filed); a balance has no start.  annual: 340 to 380 days, or a balance,
    in an annual form; quarterly: 80 to 100 days, or a balance, in any form; amendments (form with /A) count as their
    form.  Other facts are left out.  Of several concepts with a value the first in `concepts` is taken; of facts filed on
    one day the largest value.  A period that ends in the first week of January belongs to the year before.
    """
    form, span = F.regexp_replace("form", "/A$", ""), F.datediff("end", "start")
    balance = F.col("start").isNull()
    rank = F.coalesce(*[F.when(F.col("concept") == c, k) for k, c in enumerate(concepts)])
    year = F.when(form.isin(*ANNUAL_FORMS) & (balance | span.between(*YEAR_DAYS)), F.lit("annual"))
    quarter = F.when(form.isin(*ALL_FORMS) & (balance | span.between(*QUARTER_DAYS)), F.lit("quarterly"))
    d = facts.filter(F.col("value").isNotNull() & F.col("end").isNotNull()).withColumn("_rank", rank).filter("_rank IS NOT NULL")
    d = d.withColumn("grain", F.explode(F.array_compact(F.array(year, quarter))))
    best = F.max_by(F.struct("concept", "value", "form", "filed"), F.struct(-F.col("_rank"), "filed", "value"))
    fiscal = F.year("end") - F.when((F.month("end") == 1) & (F.dayofmonth("end") <= FIRST_DAYS), 1).otherwise(0)
    return d.groupBy(*keys, "grain", "start", "end").agg(best.alias("_b")).select(*keys, "grain", "start", "end", fiscal.alias("fiscal_year"), "_b.*")
