import collections
import hashlib
import random
import re

import numpy as np

from tabulon.llm import near_duplicates as nd
from tabulon.llm import quality_rules
from tabulon.llm import substring_dedup as sd
from tabulon.llm import suffix_array as sa
from tabulon.llm.components import connected
from tests.llm.conftest import DOCUMENTS, ODD


def shingles(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def links_by_force(rows):
    """(class, links) for each row number."""
    sets = [shingles(t) if i is not None else frozenset() for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = collections.Counter()
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                n[a] += 1
                n[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), str(None if i is None else least[find(k)]), n[k]) for k, (i, _) in enumerate(rows))


def near(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in nd.near_duplicates(df).collect())


def test_near_duplicates_of_odd_rows(odd, none):
    assert near(odd) == links_by_force([(r[0], r[1]) for r in ODD])
    assert near(none) == []


def test_near_duplicates_in_a_large_group(spark):
    """More near copies than a small bucket or a block takes, with different texts, beside unrelated ones."""
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for k in range(330):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
        rows.append((1000 - k, " ".join(words)))
    rows += [(2000 + k, " ".join(f"v{r.randint(0, 500)}" for _ in range(40))) for k in range(30)]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == links_by_force(rows)


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(k).count("1") + swap) % 2] for k in range(n))


def test_strings_made_to_clash_stay_apart(spark):
    """Polynomial hashes modulo a power of two take these for one."""
    rows = [(1, thue_morse(1024)), (2, thue_morse(1024, True)), (3, thue_morse(1024) + " x"), (4, " ".join("ab"[c == "b"] * 3 for c in thue_morse(1024))), (5, " ".join("ab"[c == "b"] * 3 for c in thue_morse(1024, True)))]
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == links_by_force(rows)


def test_equal_numbers_do_not_make_equal_contents(spark, monkeypatch):
    """With a hash that nearly everything shares the results are the same."""
    monkeypatch.setattr(nd.wordhash, "mix", lambda x: x & np.uint64(3))
    raw = np.frombuffer(b"one two one two six one two one two", np.uint8)
    values, exact, count = nd.exact_shingles(raw, np.array([0, 15, len(raw)]))
    words = [("one", "two", "one", "two"), ("six", "one", "two", "one", "two")]
    assert len(set(exact.tolist())) == 2 and count.tolist() == [1, 1] and words
    lines = b"aa bb\ncc dd\naa bb\nbb aa\ncc dd"
    got = quality_rules.text_counts(np.frombuffer(lines, np.uint8), np.array([0, len(lines)]))
    assert got["n_dup_lines"].tolist() == [2]


def test_rows_that_share_an_id_are_judged_apart(spark):
    a, b = "one two three four five six seven", "alpha beta gamma delta epsilon zeta"
    rows = [(1, a), (1, b), (2, a.upper()), (3, b + "!"), (1, a), (4, ""), (4, None), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((str(r.doc_id), str(r.text)) for r in nd.distinct_documents(df).collect())
    assert kept == sorted([("1", a), ("1", b), ("4", ""), ("4", "None"), ("None", a)])


def test_pruning_keeps_what_reaches_the_threshold():
    least = nd.fewest_matches()
    assert list(least) == sorted(least) and all(m <= 0.8 * n for m, n in zip(least, range(nd.STEP, 289, nd.STEP), strict=True))
    r = np.random.default_rng(1)
    a = r.integers(0, 2**32, (500, 288), np.uint32)
    b = np.where(r.random(a.shape) < 0.8, a, a + 1)
    assert len(nd.surviving(a, b)) == 500
    assert len(nd.surviving(a, a + (r.random(a.shape) < 0.7))) == 0


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 90, 90: 90, 95: 90}


def test_suffix_array_and_common_prefixes():
    r = random.Random(3)
    for k in range(60):
        b = bytes(r.choice(b"ab\x00\xff" if k % 2 else b"abcdefghij") for _ in range(r.randint(0, 250))) + b"a" * (k % 70)
        x = np.frombuffer(b, np.uint8)
        order = sa.suffix_array(x)
        keys = [b[i : i + sa.DEPTH] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(b))) and keys == sorted(keys)
        padded = [k2.ljust(sa.DEPTH, b"\0") for k2 in keys]
        want = [next((i for i in range(sa.DEPTH) if p[i] != q[i]), sa.DEPTH) for p, q in zip(padded, padded[1:], strict=False)]
        assert sa.common_prefixes(x, order).tolist()[1:] == want


def cut_by_force(rows):
    out, seen = [], {}
    for i, t in sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, x[0])):
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        if i is not None:
            for k in range(len(b) - 49):
                if seen.get(b[k : k + 50], i) < i:
                    gone[k : k + 50] = True
            for k in range(len(b) - 49):
                seen.setdefault(b[k : k + 50], i)
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def cut(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.repeated_substrings(df).collect())


def test_substrings_of_odd_rows(odd, none):
    assert cut(odd) == cut_by_force([(r[0], r[1]) for r in ODD])
    assert cut(none) == []


def test_substrings_that_overlap_and_repeat(spark, monkeypatch):
    r = random.Random(9)
    pool = ["".join(r.choice("abcd ") for _ in range(r.randint(30, 160))) for _ in range(12)]
    rows = [(k, "".join(r.choice(pool) + "".join(r.choice("xyz") for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 9)))) for k in range(150)]
    rows += [(500, "a" * 300), (501, "a" * 120 + "b" * 60), (502, "b" * 70), (503, "x" * 49)]
    monkeypatch.setattr(sd, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(sd, "COMPARED_BYTES", 500)
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == cut_by_force(rows)


def test_substrings_of_rows_that_share_an_id(spark):
    shared = "the passage that several documents share, well over fifty bytes long, word for word"
    rows = [(1, shared), (2, "a " + shared), (2, shared + " b"), (2, "nothing of the kind is in this text, however long it may grow here"), (3, "x"), (2, "a " + shared)]
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == cut_by_force(rows)


def test_one_string_in_thousands_of_surroundings(spark, monkeypatch):
    """A hot minimizer: its windows are dealt by their own hashes; some surroundings repeat in other documents."""
    r = random.Random(21)
    # a string whose hash is small, so that it is the smallest in nearly every window that holds it
    hot = next(s for k in range(10**6) if sd.gram_numbers(np.frombuffer((s := f"twentybytes{k:09}").encode(), np.uint8))[0] < 2**64 // 1000)
    around = ["".join(r.choice("abcdefgh") for _ in range(30)) + hot + "".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(1500)]
    rows = [(k, "".join(r.choice(around) for _ in range(3)) + str(k)) for k in range(900)]
    monkeypatch.setattr(sd, "HOT", 20)
    monkeypatch.setattr(sd, "HOT_WINDOWS", 3000)
    monkeypatch.setattr(sd, "BUCKET_BYTES", 20000)
    monkeypatch.setattr(sd, "CELL_BYTES", 9000)
    assert cut(spark.createDataFrame(rows, "doc_id long, text string")) == cut_by_force(rows)


def test_schema_matches_documents():
    assert DOCUMENTS.startswith("doc_id long")
