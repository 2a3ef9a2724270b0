"""Date and money calculators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import exact_anniversary

#: one reviewed adjustment of a deadline; what its kind does not use is null.  An open pause or resumption has none.
INSTRUCTION = "struct<id:string,kind:string,confirmed:boolean,start:date,resume:date,most:int,most_unit:string,protected:date,event:date,amount:int,unit:string,date:date>"
#: fixed values: units of periods, and how much of each is supported
LONGEST_PERIOD = {"calendar_years": 100, "calendar_months": 1200, "calendar_days": 36500}
LONGEST_EXCLUSION, MOST_INSTRUCTIONS = 36500, 100


def present_value(amount: Column, years: Column, rate: Column) -> Column:
    """Yearly payments at the ends of the years, discounted; fractions of a year are not paid."""
    n = F.floor(years).cast("int")
    pay = F.when(rate == 0, amount * n).otherwise(amount * (1 - F.pow(1 + rate, -n)) / rate)
    return F.when(n > 0, pay).otherwise(0.0)


def compounded_interest(principal: Column, rate: Column, start: Column, end: Column, day_basis: int | None = 365) -> Column:
    """Interest by days, added to the balance on each anniversary of the start; null where the end comes first.

    A day bears rate / day_basis, so a year with a 29th of February bears a day more; day_basis None counts each year's
    own days.  Anniversaries of a 29th of February fall on the 28th in other years.
    """

    def anniversary(n: Column) -> Column:
        return F.add_months(start, n * 12)

    def grown(balance: Column, n: Column) -> Column:
        to = F.least(anniversary(n), end)
        year = F.datediff(anniversary(n), anniversary(n - 1)) if day_basis is None else F.lit(day_basis)
        return balance * (1 + rate * F.greatest(F.datediff(to, anniversary(n - 1)), F.lit(0)) / year)

    years = F.sequence(F.lit(1), F.year(end) - F.year(start) + 1)
    return F.when(end >= start, F.aggregate(years, principal.cast("double"), grown) - principal)


def adjusted_for_prices(df: DataFrame, index: DataFrame, amount: str, month: str, to_month: str, out: str) -> DataFrame:
    """amount in the prices of another month; null where either month has no index value.  index: (month, value)."""
    a = index.select(F.col("month").alias(month), F.col("value").alias("_from"))
    b = index.select(F.col("month").alias(to_month), F.col("value").alias("_to"))
    joined = df.join(a, month, "left").join(b, to_month, "left")
    return joined.withColumn(out, F.when(F.col("_from") > 0, F.col(amount) * F.col("_to") / F.col("_from"))).drop("_from", "_to")


def row_for_age(df: DataFrame, brackets: DataFrame, age: str, values: list[str]) -> DataFrame:
    """df with the values of the bracket [from_age, to_age) that holds the age; a null to_age is open.

    brackets is a printed table of at most 200 rows; more are refused before it is broadcast.
    """
    if brackets.limit(201).count() > 200:
        raise ValueError("a table of at most 200 brackets is expected")
    small = F.broadcast(brackets.select("from_age", "to_age", *values))
    return df.join(small, (F.col(age) >= F.col("from_age")) & (F.col("to_age").isNull() | (F.col(age) < F.col("to_age"))), "left").drop("from_age", "to_age")


def deadline(accrued: Column, period_months: Column, pauses: Column, longest_pause: int | None = None, floor: Column | None = None, ceiling: Column | None = None) -> Column:
    """Accrual plus the period, plus the days of the pauses' union, not before floor and not after ceiling.

    pauses: array<struct<s: date, e: date>>, in any order, possibly overlapping; days [s, e) count once and only until
    the running deadline, which each pause moves.  Null where the period has no such day (a missing anniversary).
    """
    base = F.add_months(accrued, period_months)
    exact = F.when(F.dayofmonth(base) == F.dayofmonth(accrued), base)
    start = F.struct(exact.alias("due"), accrued.alias("seen"), F.lit(0).alias("used"))

    def add(acc: Column, p: Column) -> Column:
        begin = F.greatest(p["s"], acc["seen"])
        days = F.greatest(F.datediff(p["e"], begin), F.lit(0))
        if longest_pause is not None:
            days = F.least(days, F.lit(longest_pause) - acc["used"])
        days = F.when(begin <= acc["due"], days).otherwise(0)
        return F.struct(F.date_add(acc["due"], days).alias("due"), F.greatest(acc["seen"], F.when(begin <= acc["due"], p["e"]).otherwise(acc["seen"])).alias("seen"), (acc["used"] + days).alias("used"))

    out = F.aggregate(F.array_sort(pauses), start, add, lambda acc: acc["due"])
    if floor is not None:
        out = F.greatest(out, floor)
    return F.least(out, ceiling) if ceiling is not None else out


def civil_period(day: Column, amount: Column, unit: Column) -> Column:
    """A day some calendar days, months or years on; null where that month has no such day."""
    months = amount * F.when(unit == "calendar_years", 12).otherwise(1)
    return F.when(unit == "calendar_days", F.date_add(day, amount)).otherwise(exact_anniversary(day, months))


def _supported(amount: Column, unit: Column) -> Column:
    limit = F.coalesce(*[F.when(unit == u, n) for u, n in LONGEST_PERIOD.items()], F.lit(0))
    return F.coalesce((amount > 0) & (amount <= limit), F.lit(False))


def _sound(i: Column) -> Column:
    """Has an adjustment all that its kind needs?"""
    pause = i["start"].isNotNull() & (i["resume"].isNull() | (i["resume"] > i["start"])) & ((i["most"].isNull() & i["most_unit"].isNull()) | _supported(i["most"], i["most_unit"]))
    floor = i["protected"].isNotNull() & i["event"].isNotNull() & (i["event"] >= i["protected"]) & _supported(i["amount"], i["unit"])
    by_kind = F.when(i["kind"] == "pause", pause).when(i["kind"] == "defer_start", F.lit(True)).when(i["kind"] == "minimum_after_event", floor).when(i["kind"] == "fixed_deadline", i["date"].isNotNull())
    return F.coalesce(by_kind & i["confirmed"] & (F.trim(i["id"]) != ""), F.lit(False))


def _once(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def reviewed_deadline(start: Column, baseline: Column, amount: Column, unit: Column, instructions: Column, caps: Column | None = None) -> Column:
    """struct<status, date, effective_start, excluded_days, capped> of a clock under reviewed adjustments, in any order.

    status: calculated; invalid (something is missing or contradicts itself); open_ended (a pause or resumption has no end
    yet); needs_review (the date would rest on an assumption).  There is a date only if it was calculated.

    A delayed start runs the period anew from the latest resumption.  A pause counts up to its own maximum, from the start
    that is in force; pauses that overlap or touch are one, and one must begin while the clock runs.  A floor after an
    event must have attached in time; it preserves the later date.  A fixed date stands alone.  Caps are never passed.
    instructions: array of INSTRUCTION; caps: array<date>.
    """
    given = F.coalesce(instructions, F.array().cast(f"array<{INSTRUCTION}>"))
    limits = F.coalesce(caps, F.array().cast("array<date>")) if caps is not None else F.array().cast("array<date>")

    def of(kind: str, rows: Column) -> Column:
        return F.filter(rows, lambda i: i["kind"] == kind)

    def outcome(status: Column | str, date: Column | None = None, effective: Column | None = None, days: Column | None = None, capped: Column | None = None) -> Column:
        none = F.lit(None)
        return F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), (none.cast("date") if date is None else date).alias("date"), (none.cast("date") if effective is None else effective).alias("effective_start"), (none.cast("int") if days is None else days).cast("int").alias("excluded_days"), (F.lit(False) if capped is None else capped).alias("capped"))

    bad = start.isNull() | baseline.isNull() | (baseline < start) | ~_supported(amount, unit) | (F.size(given) > MOST_INSTRUCTIONS) | F.exists(given, lambda i: ~_sound(i)) | F.exists(limits, lambda c: c.isNull())
    bad = F.coalesce(bad, F.lit(True)) | (F.size(F.array_distinct(F.transform(given, lambda i: i["id"]))) < F.size(given))
    fixed, deferred = of("fixed_deadline", given), of("defer_start", given)
    resumed = F.array_max(F.transform(deferred, lambda i: i["resume"]))

    def pauses_from(effective: Column) -> Column:
        def one(i: Column) -> Column:
            most = civil_period(i["start"], i["most"], i["most_unit"])
            return F.struct(F.greatest(i["start"], effective).alias("s"), F.when(i["resume"].isNotNull(), F.least(i["resume"], most)).alias("e"))

        kept = F.filter(F.transform(of("pause", given), one), lambda p: p["e"].isNull() | (p["e"] > effective))
        none = F.array().cast("array<struct<s:date,e:date>>")

        def join(acc: Column, p: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            touches = (F.size(acc) > 0) & (last["e"].isNull() | (p["s"] <= last["e"]))
            end = F.when(last["e"].isNotNull() & p["e"].isNotNull(), F.greatest(last["e"], p["e"]))
            return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), end.alias("e"))))).otherwise(F.concat(acc, F.array(p)))

        return F.aggregate(F.array_sort(kept), none, join)

    def run(first: Column) -> Column:
        """first: the date before pauses, and the start in force."""
        going = F.struct(F.lit("calculated").alias("status"), first["date"].alias("date"), F.lit(0).alias("days"))

        def pause(acc: Column, p: Column) -> Column:
            days = F.datediff(p["e"], p["s"])
            stopped = F.when(acc["status"] != "calculated", acc["status"]).when(p["s"] > acc["date"], "needs_review").when(p["e"].isNull(), "open_ended").when(acc["days"] + days > LONGEST_EXCLUSION, "needs_review").otherwise("calculated")
            on = stopped == "calculated"
            return F.struct(stopped.alias("status"), F.when(on, F.date_add(acc["date"], days)).otherwise(acc["date"]).alias("date"), (acc["days"] + F.when(on, days).otherwise(0)).alias("days"))

        def floor(acc: Column, i: Column) -> Column:
            least = civil_period(i["event"], i["amount"], i["unit"])
            stopped = F.when(acc["status"] != "calculated", acc["status"]).when((i["protected"] > acc["date"]) | least.isNull(), "needs_review").otherwise("calculated")
            return F.struct(stopped.alias("status"), F.greatest(acc["date"], least).alias("date"), acc["days"].alias("days"))

        floors = F.array_sort(F.transform(of("minimum_after_event", given), lambda i: F.struct(i["protected"].alias("protected"), i["event"].alias("event"), i["amount"].alias("amount"), i["unit"].alias("unit"))))
        return F.aggregate(floors, F.aggregate(pauses_from(first["effective"]), going, pause), floor)

    def finish(first: Column) -> Column:
        def end(done: Column) -> Column:
            date = F.when(F.size(fixed) > 0, F.get(fixed, F.lit(0))["date"]).otherwise(done["date"])
            status = F.when(done["status"] != "calculated", done["status"]).when((F.size(fixed) > 0) & (date < start), "needs_review").otherwise("calculated")
            least = F.array_min(limits)
            good = status == "calculated"
            return F.when(good, outcome("calculated", F.least(date, least), first["effective"], done["days"], F.coalesce(date > least, F.lit(False)))).otherwise(outcome(status, None, first["effective"], done["days"]))

        return _once(run(first), end)

    anew = civil_period(resumed, amount, unit)
    late = F.exists(of("pause", given), lambda i: i["resume"].isNotNull() & i["most"].isNotNull() & civil_period(i["start"], i["most"], i["most_unit"]).isNull())
    return (
        F.when(bad, outcome("invalid"))
        .when((F.size(fixed) > 0) & (F.size(given) != 1), outcome("needs_review"))
        .when(F.exists(deferred, lambda i: i["resume"].isNull()), outcome("open_ended"))
        .when(F.exists(deferred, lambda i: i["resume"] < start), outcome("invalid"))
        .when((F.size(deferred) > 0) & anew.isNull(), outcome("needs_review"))
        .when(late, outcome("needs_review"))
        .otherwise(_once(F.struct(F.when(F.size(deferred) > 0, anew).otherwise(baseline).alias("date"), F.coalesce(resumed, start).alias("effective")), finish))
    )
