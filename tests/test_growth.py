"""Steps whose cost was to grow no faster than their input."""

import re
from collections import Counter

from tabulon.functions import text
from tabulon.operators import search, text_index
from tabulon.streaming import cdc

TEXTS = [(1, "The court of the Appeals"), (2, None), (3, ""), (4, " x1—The-x1\nx1 "), (5, "of " * 700), (None, "The end"), (6, "..."), (7, "éclair, Éclair")]


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_an_inverted_index_is_made_text_by_text(spark, monkeypatch):
    monkeypatch.setattr(search, "POSTING_WORDS", 5)
    for more in ([], [(1, "appeals the ruling"), (None, "end of the end")]):  # ids that repeat
        want, first = Counter(), {}
        for i, t in [*TEXTS, *more]:
            for k, w in enumerate(words(t)):
                want[w, i] += 1
                first[w, i] = min(first.get((w, i), k), k)
        found = search.inverted_index(spark.createDataFrame([*TEXTS, *more], "id long, t string"), "id", "t")
        assert sorted((r.term, str(r.id), r.tf, r.first) for r in found.collect()) == sorted((w, str(i), n, first[w, i]) for (w, i), n in want.items())
        assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == bool(more)


def test_ranges_of_an_index_follow_its_words(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(text_index, "RANGE_WORDS", 50)
    docs = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(40))) for k in range(60)]
    index = text_index.build_index(spark.createDataFrame(docs, "id long, t string"), str(tmp_path / "i"), "id", "t")
    assert index.parts == 48 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
    held = {r.range: (r.first, r.last) for r in spark.read.parquet(f"{index.path}/ranges").collect()}
    rows = spark.read.parquet(f"{index.path}/postings").collect()
    assert len(held) > 30 and held == {k: (min(r.term for r in rows if r.range == k), max(r.term for r in rows if r.range == k)) for k in {r.range for r in rows}}
    want = {(w, i): [k for k, x in enumerate(words(t)) if x == w] for i, t in docs for w in set(words(t))}
    assert {(r.term, r.id): r.positions for r in rows} == want and all(r.tf == len(r.positions) for r in rows) and len(rows) == len(want)


def test_docket_dates_match_an_entry_once(spark):
    df = spark.createDataFrame([("Hearing set for 1/5/2027, Jury Trial set for 2/8/2027 at 9:30 is vacated. And more",)], "e string").select(text.docket_dates("e").alias("d"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"due\s+by") == 1 and plan.count("VACATED") == 1 and plan.count("Please") == 1
    assert [(d.label, str(d.date), d.time, d.vacated) for d in df.first().d] == [("Hearing", "2027-01-05", None, False), ("Hearing", "2027-02-08", "9:30", True)]


def test_a_night_marks_records_in_one_grouping(spark, monkeypatch, tmp_path):
    seen, stored = {}, cdc.stored
    monkeypatch.setattr(cdc, "stored", lambda df, name: stored(seen.setdefault(name, df), name))
    state = cdc.PassageState(spark, str(tmp_path / "s"), lambda d: d.selectExpr("id", "posexplode(split(text, ' ')) AS (chunk_no, body)").filter("body <> ''"))
    for docs, cut, sent, gone in (([(1, "a b"), (2, None), (None, "z")], 3, "ab", ""), ([(1, "a b"), (2, "c a"), (3, "")], 2, "c", ""), ([(2, "c a")], 0, "", "b")):
        send, drop, n = state.refresh(spark.createDataFrame(docs, "id long, text string"), "id", "text", lambda body: body)
        assert (n, sorted(r.key for r in send.collect()), sorted(r.key for r in drop.collect())) == (cut, list(sent), list(gone))
        assert "Join" not in seen.pop("marks")._jdf.queryExecution().optimizedPlan().toString() and seen.pop("pieces")
    assert {(r.id, r.chunk_no, r.key) for r in state.held().collect()} == {(2, 0, "c"), (2, 1, "a")}
