"""Passages against a direct reading of the rule; embedding strings; nights of a changing corpus."""

import random
import re

from pyspark.sql import functions as F

from tabulon.functions import text as tf
from tabulon.operators import passages
from tabulon.streaming import cdc


def plainly(text, limit):
    def level(line):
        tabs = len(line) - len(line.lstrip("\t"))
        rest = line[tabs:]
        if rest[:1] == "\x1e":
            return min(tabs, 2)
        for k, p in enumerate((r"\([a-z]{1,2}\)(\s|$)", r"\(\d{1,3}\)(\s|$)", r"\([A-Z]{1,2}\)(\s|$)")):
            if not tabs and re.match(p, rest):
                return k
        return 3

    def cut(t, depth):
        """Parts of a text, each a text, that together are it."""
        if len(t) <= limit:
            return [t]
        if depth < 4:
            lines = re.findall(r"[^\n]*\n|[^\n]+", t)
            parts = [""]
            for n, line in enumerate(lines):
                if n and line.strip() and level(line.rstrip("\n")) <= depth:
                    parts.append("")
                parts[-1] += line
        elif depth == 4:
            parts = re.sub(r"(?<=[.;:?!])(\s+)(?=[A-Z(“\"0-9])", "\\1\0", t).split("\0")
        else:
            out = []
            while len(t) > limit:
                at = max([k for k in range(1, limit + 1) if t[k - 1].isspace()], default=limit)
                out.append(t[:at])
                t = t[at:]
            return [*out, t]
        return [x for p in parts for x in cut(p, depth + 1)]

    spans, at = [], 0
    for part in cut(text, 0):
        a, z = at + len(part) - len(part.lstrip()), at + len(part.rstrip())
        at += len(part)
        if z > a:
            if spans and z - spans[-1][0] <= limit:
                spans[-1] = (spans[-1][0], z)
            else:
                spans.append((a, z))
    return spans


def test_passages_equal_the_rule():
    dice = random.Random(5)
    bits = ["word ", "(a) sub\n", "(12) para ", "(AB) part\n", "\n", "\n\n", "\t\x1ehead\n", "\x1etitle ", "Sentence ends. ", "then;  Next ", "x" * 17, "é😀 ", "\t(a) in\n", "   \n", ". ", "? \n A", "\x0b", "\r\n", "(a)", " 7"]
    for _ in range(3000):
        text = "".join(dice.choices(bits, k=dice.randint(0, 25)))
        limit = dice.choice([4, 9, 20, 45, 400])
        assert passages.passage_spans(text, limit) == plainly(text, limit), (text, limit)
    assert passages.body_limit("x" * 100) == 2800 and passages.body_limit("x" * 900) == 2098 and passages.body_limit("x" * 5000) == 1200


def test_chunked(spark):
    rows = [(1, "(a) One. " * 900, "h" * 900), (2, None, None), (3, " \n", "h"), (4, "y" * 6000, None)]
    df = spark.createDataFrame(rows, "id long, t string, h string")
    got = passages.chunked(df, "id", "t", heading="h", most=2).collect()
    for i, t, h in rows:
        spans = plainly(t, passages.body_limit(h or "")) if t else []
        assert [(r.chunk_no, r.chunk_total, r.start, r.end, r.body) for r in sorted(got) if r.id == i] == [(k, len(spans), a, z, t[a:z]) for k, (a, z) in enumerate(spans[:2])]


def test_embedding_strings(spark):
    def clean(s):
        s = re.sub("\n[\t ]+", "\n", re.sub("[\x1e\x1f]", "", s)).replace("\t", " ")
        return re.sub("\n{3,}", "\n\n", re.sub("[\t ]{2,}", " ", s)).strip()

    def snip(s, n):
        flat = " ".join(clean(s).split())
        if len(flat) <= n:
            return flat
        cut = flat[:n].rfind(" ")
        return flat[: cut if cut > n // 2 else n].rstrip(" ,;:.-") + "…"

    dice = random.Random(1)
    texts = ["".join(dice.choices(["word", " ", "  ", "\n", "\n\n\n", "\t", "\x1e", ", ", ".", "-", "é😀", "\u2003", "\x0b"], k=dice.randint(0, 40))) for _ in range(300)] + ["x" * 50, ", . " * 20, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").coalesce(1)
    for r in df.select("k", tf.cleaned("t").alias("c"), tf.snippet("t", 20).alias("s"), tf.embedding_text(F.lit("a › b"), "t").alias("e"), tf.embedding_text(F.lit(None).cast("string"), "t").alias("n")).collect():
        assert (r.c, r.s) == (clean(texts[r.k]), snip(texts[r.k], 20)), texts[r.k]
        assert r.e == "a › b\n\n" + clean(texts[r.k]) and r.n == clean(texts[r.k])


def test_nights_equal_a_full_rebuild(spark, tmp_path):
    def cut(docs):
        return passages.chunked(docs, "id", "text", longest=40)

    def key(body):
        return tf.embedding_key(body, "m")

    dice = random.Random(8)
    bank = ["(a) First sentence here. Then more words follow it.", "Common passage that many share.", "Another one; Short. ", "x " * 60]
    docs = {k: " ".join(dice.choices(bank, k=dice.randint(0, 4))) for k in range(30)} | {77: None}
    state, store = cdc.PassageState(spark, str(tmp_path / "s"), cut), set()
    for night in range(4):
        df = spark.createDataFrame(list(docs.items()), "id long, text string")
        before = dict(docs)
        send, gone, n = state.refresh(df, "id", "text", key)
        send, gone = {(r.key, r.body) for r in send.collect()}, {r.key for r in gone.collect()}
        assert not {k for k, _ in send} & store and gone <= store
        store = (store | {k for k, _ in send}) - gone
        full = cut(df.select("id", "text")).select("id", "chunk_no", key(F.col("body")).alias("key"))
        assert {tuple(r) for r in state.held().filter("key is not null").select("id", "chunk_no", "key").collect()} == {tuple(r) for r in full.collect()}
        assert store == {r.key for r in full.collect()}
        assert n == (len(docs) if night == 0 else changed)
        changed = 0
        for k in list(docs):
            luck = dice.random()
            if luck < 0.2:
                docs[k] = (docs[k] or "") + " " + dice.choice(bank)
                changed += 1
            elif luck < 0.3:
                del docs[k]
        docs[100 + night] = bank[night % 4]
        changed += 1
        assert before != docs
