"""Deadlines under reviewed adjustments: generated cases against a plain reading, in any order of the adjustments."""

import datetime
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.operators import calculators

FIELDS = [f.split(":")[0] for f in calculators.INSTRUCTION[7:-1].split(",")]
DAY = datetime.timedelta(1)


def add(day, amount, unit):
    if unit == "calendar_days":
        return day + amount * DAY
    m = day.year * 12 + day.month - 1 + amount * (12 if unit == "calendar_years" else 1)
    try:
        return datetime.date(m // 12, m % 12 + 1, day.day)
    except ValueError:
        return None


def supported(amount, unit):
    return amount is not None and 0 < amount <= calculators.LONGEST_PERIOD.get(unit, 0)


def plainly(start, base, amount, unit, given, caps):
    def stop(status):
        return status, None

    if not start or not base or base < start or not supported(amount, unit) or None in caps or len({i["id"] for i in given}) < len(given):
        return stop("invalid")
    for i in given:
        good = bool(i["confirmed"] and i["id"].strip())
        if i["kind"] == "pause":
            good &= bool(i["start"]) and (not i["resume"] or i["resume"] > i["start"]) and (i["most"] is None and i["most_unit"] is None or supported(i["most"], i["most_unit"]))
        elif i["kind"] == "minimum_after_event":
            good &= bool(i["protected"] and i["event"]) and i["event"] >= i["protected"] and supported(i["amount"], i["unit"])
        elif i["kind"] == "fixed_deadline":
            good &= bool(i["date"])
        elif i["kind"] != "defer_start":
            good = False
        if not good:
            return stop("invalid")
    fixed, deferred = [i for i in given if i["kind"] == "fixed_deadline"], [i for i in given if i["kind"] == "defer_start"]
    if fixed and len(given) > 1:
        return stop("needs_review")
    if any(not i["resume"] for i in deferred):
        return stop("open_ended")
    if any(i["resume"] < start for i in deferred):
        return stop("invalid")
    date, effective = base, start
    if deferred:
        effective = max(i["resume"] for i in deferred)
        date = add(effective, amount, unit)
        if not date:
            return stop("needs_review")
    held = {}  # every excluded day, and those of pauses without an end
    spans = []
    for i in (i for i in given if i["kind"] == "pause"):
        end = i["resume"]
        if end and i["most"]:
            most = add(i["start"], i["most"], i["most_unit"])
            if not most:
                return stop("needs_review")
            end = min(end, most)
        if end and end <= effective:
            continue
        spans.append((max(i["start"], effective), end))
    merged = []
    for s, e in sorted(spans, key=lambda x: (x[0], x[1] or datetime.date.min)):
        if merged and (merged[-1][1] is None or s <= merged[-1][1]):
            merged[-1][1] = None if e is None or merged[-1][1] is None else max(e, merged[-1][1])
        else:
            merged.append([s, e])
    for s, e in merged:
        if s > date:
            return stop("needs_review")
        if e is None:
            return stop("open_ended")
        date += e - s
    for i in sorted((i for i in given if i["kind"] == "minimum_after_event"), key=lambda i: i["protected"]):
        least = add(i["event"], i["amount"], i["unit"])
        if i["protected"] > date or not least:
            return stop("needs_review")
        date = max(date, least)
    if fixed:
        date = fixed[0]["date"]
        if date < start:
            return stop("needs_review")
    del held
    return "calculated", min([date, *caps])


def test_generated_cases(spark):
    dice, origin = random.Random(7), datetime.date(2019, 12, 25)

    def day(lo, hi):
        return origin + dice.randint(lo, hi) * DAY

    def instruction(k):
        i = dict.fromkeys(FIELDS) | {"id": f"i{k}", "kind": dice.choice(["pause"] * 5 + ["defer_start", "minimum_after_event", "minimum_after_event", "fixed_deadline"]), "confirmed": dice.random() < 0.98}
        if i["kind"] == "pause":
            i["start"] = day(-50, 500)
            i["resume"] = None if dice.random() < 0.08 else i["start"] + dice.randint(0 if dice.random() < 0.1 else 1, 150) * DAY
            if dice.random() < 0.3:
                i |= {"most": dice.randint(1, 3), "most_unit": dice.choice(["calendar_months", "calendar_days", "calendar_days"])}
        elif i["kind"] == "defer_start":
            i["resume"] = None if dice.random() < 0.1 else day(-5, 120)
        elif i["kind"] == "minimum_after_event":
            i["protected"] = day(0, 500)
            i |= {"event": i["protected"] + dice.randint(0, 200) * DAY, "amount": dice.randint(1, 8), "unit": dice.choice(list(calculators.LONGEST_PERIOD))}
            i["amount"] = min(i["amount"], 1) if i["unit"] == "calendar_years" else i["amount"]
        else:
            i["date"] = day(-20, 900)
        return i

    cases = []
    for _ in range(1000):
        start = day(0, 60)
        unit = dice.choice(list(calculators.LONGEST_PERIOD))
        amount = {"calendar_years": 1, "calendar_months": dice.randint(1, 14), "calendar_days": dice.randint(1, 400)}[unit]
        base = add(start, amount, unit) or start + 365 * DAY
        given = [instruction(k) for k in range(dice.choice([0, 1, 1, 2, 2, 3, 4]))]
        if dice.random() < 0.02 and len(given) > 1:
            given[1]["id"] = given[0]["id"]
        cases.append((start, base if dice.random() < 0.99 else start - DAY, amount, unit, given, [day(100, 900) for _ in range(dice.choice([0, 0, 0, 1, 2]))]))
    schema = T.StructType.fromDDL(f"n int, start date, base date, amount int, unit string, given array<{calculators.INSTRUCTION}>, caps array<date>")
    results = []
    for turn in range(2):
        rows = [(n, *c[:4], [tuple(i[f] for f in FIELDS) for i in (c[4] if turn == 0 else c[4][::-1])], c[5]) for n, c in enumerate(cases)]
        df = spark.createDataFrame(rows, schema).coalesce(2)
        out = calculators.reviewed_deadline(F.col("start"), F.col("base"), F.col("amount"), F.col("unit"), F.col("given"), F.col("caps"))
        results.append({r.n: r.r for r in df.select("n", out.alias("r")).collect()})
    want = [plainly(*c) for c in cases]
    for n, w in enumerate(want):
        assert (results[0][n].status, results[0][n].date) == w, (cases[n], results[0][n])
    assert results[0] == results[1]
    assert {s for s, _ in want} == {"calculated", "invalid", "open_ended", "needs_review"} and sum(s == "calculated" for s, _ in want) > 300
