import collections
import random
import re

import numpy as np
import pyarrow as pa

from tabulon.llm import collocations as co
from tabulon.llm import wordhash

SCHEMA = "doc_id long, text string, lang string, n string, phrase string, a string, score string"


def plainly(rows, least, top, part_of=80):
    """The contract, read straight."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[k : k + size]) for size in range(1, 5) for k in range(len(w) - size + 1))
    often = {p: a for p, a in f.items() if a >= least}
    out = collections.defaultdict(list)
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        score, _, left, right = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
        inside = any(m == lang and len(x) > len(w) and 100 * b >= part_of * a and any(x[k : k + len(w)] == w for k in range(len(x))) for (m, *x), b in often.items())
        if not inside:
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def mined(df, **how):
    return sorted(tuple(r) for r in co.collocations(df, **how).collect())


def texts(seed=3):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "état", "😀", "the", "of", "a", "B.", "x,y", "and\n", "in\x0bto", "tab\t", "n°"]
    rows = [(k, " ".join(rng.choices(words, [9, 9, 3, 4, 2, 20, 15, 9, 2, 2, 3, 2, 2, 1], k=rng.randint(1, 90))), rng.choice(["en", "fr", None, "und", ""])) for k in range(160)]
    rows += [(1, "strong  tea\tand strong tea; strong TEA " * 8, "en")] * 3 + [(None, None, "en"), (7, "", None), (8, " \t\n", "de"), (9, "one two three four five six " * 400, "la"), (10, "q" * 5000, "la"), (11, "ÀB àb ", "la")]
    return rows


def test_collocations(spark, monkeypatch):
    rows = texts()
    df = spark.createDataFrame([(*r, "z", "z", "z", "z") for r in rows], SCHEMA).repartition(5)
    for least, top in ((3, 2000), (8, 4)):
        assert mined(df, least=least, top=top) == plainly(rows, least, top)
    whole = mined(df, least=4)
    monkeypatch.setattr(co, "CHUNK_WORDS", 7)
    monkeypatch.setattr(co, "SUM_ROWS", 50)
    assert mined(df, least=4) == whole == plainly(rows, 4, 2000)
    assert co.collocations(df.limit(0)).count() == 0 and mined(df.limit(2)) == []


def test_counts_are_right_whatever_numbers_clash(spark, monkeypatch):
    rows = texts(4)
    df = spark.createDataFrame([(*r, "z", "z", "z", "z") for r in rows], SCHEMA).repartition(3)
    want = plainly(rows, 6, 2000)
    honest = wordhash.mix

    def clashing(batches_of):
        def wrapped(*args):
            inner = batches_of(*args)

            def run(batches):
                co.wordhash.mix = lambda x: honest(x) & np.uint64(15)  # in the worker: sixteen numbers in all
                try:
                    yield from inner(batches)
                finally:
                    co.wordhash.mix = honest

            return run

        return wrapped

    monkeypatch.setattr(co, "_sums", clashing(co._sums))
    monkeypatch.setattr(co, "_phrases", clashing(co._phrases))
    assert mined(df, least=6) == want


def test_fingerprints_tell_runs_apart():
    a = co.Words(pa.array(["New  york, a\tb", "", "new york new york"]))
    lang = np.array([1, 1, 1], np.uint64)
    got = collections.defaultdict(list)
    for hi, runs in co.fingerprints(a, lang):
        for n, (first, number) in runs.items():
            for f, x in zip(first, number, strict=True):
                if f < hi:
                    got[int(x)].append((n, bytes(a.raw[a.start[f] : a.end[f + n - 1]])))
    assert all(len(set(v)) == 1 for v in got.values())
    assert sorted((v[0][1], len(v)) for v in got.values()) == sorted([(b"new", 3), (b"york", 3), (b"new york", 3), (b"a", 1), (b"b", 1), (b"a b", 1), (b"york new", 1), (b"york new york", 1), (b"new york new", 1), (b"new york new york", 1)])


def test_scores_pass_64_bits(spark):
    """Counts as a large corpus has them, put in place of counted ones."""
    big = 8 * 10**18
    rows = [("en", 0, "", big), ("en", 1, "x", big), ("en", 1, "y", big // 2), ("en", 2, "x y", big // 4)]
    counts = spark.createDataFrame(rows, "lang string, n int, phrase string, a long")
    real = co.frequent_phrases
    co.frequent_phrases = lambda docs, least: counts
    try:
        got = mined(spark.createDataFrame([(1, "x", "en")], "doc_id long, text string, lang string"))
    finally:
        co.frequent_phrases = real
    assert got == [("en", 1, "x y", big // 4, big, big // 2, big, 2000000 * (big // 4) // (big + big // 2))]


def test_a_part_hands_on_each_phrase_once_however_small_its_chunks(monkeypatch):
    import types

    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(co, "CHUNK_WORDS", 7)
    every = types.SimpleNamespace(value=np.full(16, np.uint64(2**64 - 1)))
    texts = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b c " * 40]})
    rows = [tuple(r.values()) for b in co._phrases(every)([texts]) for r in b.to_pylist()]
    assert len(rows) == len({r[:3] for r in rows}) == 1 + 4 * 3
    assert ("en", 1, "a", 40) in rows and ("en", 2, "c a", 39) in rows and ("en", 4, "a b c a", 39) in rows
