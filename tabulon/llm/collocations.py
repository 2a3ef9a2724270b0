"""Phrase collocations: runs of two to four words that belong together, per language.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and the pieces into words.  Rabin-Karp
fingerprints find what is frequent: prefix sums of a polynomial over a text's bytes give the number of any run of words
in constant time.

1. Words and pairs: each task adds up the fingerprints of some text at a time, the shuffle adds up the sums.  A number
   is at least the count of every phrase that has it, so what stays below the least count is not frequent.
2. Longer runs likewise, but only those whose pairs are all frequent by number.
3. Every occurrence whose number is frequent is pointed at in its text; occurrences with one number are held against the
   text they point at and part where they differ, and one of each kind is materialised.  Counts are then added up by
   the phrase itself: they are exact whatever numbers clash.

Steps 2 and 3 look numbers up in a bitmap, 16 bits a frequent number and no more than MAP_BITS in all (128 MB): it can
only let too much through, which costs shuffle, never a result.

Scores then are joins: each candidate is cut after its first, second and third word and meets the counts of both parts.

Defined results: a null text is empty, a null language is `und`; repeated rows count each time; ids and further columns
are not read; an empty table, or nothing frequent, gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.shared import shuffle_width, slices, stored, tidy

LEAST, LONGEST, TOP, PART_OF = 30, 4, 2000, 80
CHUNK_BYTES = 3_000_000  # text that a task looks at in one go (one text at least)
CHUNK_WORDS = 100_000  # words whose polynomials are held at once
SUM_ROWS = 3_000_000  # numbers a task adds up before it hands them on
MAP_BITS = 1 << 30
_SPLIT = np.isin(np.arange(256), [*b".,;:!?", *range(10, 14)])
_BETWEEN = _SPLIT | np.isin(np.arange(256), [32, 9])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts, one blank after each, and where they begin and end; `piece` numbers their pieces."""

    def __init__(self, texts: pa.Array):
        raw, offsets = wordhash.buffers(texts)
        kept = ~_BETWEEN[raw]
        start, end, per_text = wordhash.runs(kept, offsets)
        cuts = np.concatenate([np.zeros(1, np.int32), np.cumsum(_SPLIT[raw], dtype=np.int32)])
        self.text = np.repeat(np.arange(len(texts)), per_text)
        self.piece = cuts[start] + self.text  # another text is another piece
        size = end - start
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        letters = np.ones(int(size.sum()) + len(size), bool)
        letters[self.end] = False
        self.raw = np.full(len(letters), 32, np.uint8)
        self.raw[letters] = _LOWER[raw[kept]]

    def __len__(self) -> int:
        return len(self.start)


def fingerprints(words: Words, lang: np.ndarray):
    """For some words at a time {n: (first word, number) of each run of n words within a piece}, n = 1 to LONGEST, and the
    word at which they end: pairs go on a little beyond, as far as runs that begin before it reach.

    The number of a run is the polynomial of its bytes, mixed with its size and its text's language.
    """
    for lo in range(0, len(words), CHUNK_WORDS):
        hi = min(lo + CHUNK_WORDS, len(words))
        to = min(hi + LONGEST - 1, len(words))
        at = words.start[lo]
        polynomial = wordhash.Polynomial(words.raw[at : words.end[to - 1]])
        out = {}
        for n in range(1, LONGEST + 1):
            first = np.arange(lo, to - 1 if n == 2 else min(hi, len(words) - n + 1))
            first = first[words.piece[first] == words.piece[first + n - 1]] if n > 1 else first
            a, z = words.start[first] - at, words.end[first + n - 1] - at
            out[n] = first, wordhash.mix(polynomial.of(a, z) + wordhash.mix((z - a).astype(np.uint64) + lang[words.text[first]]))
        yield hi, out


def _languages(column: pa.Array) -> np.ndarray:
    coded = column.dictionary_encode()
    own = np.array([int.from_bytes(_digest(x), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return own[coded.indices.to_numpy()] if len(own) else own


def _digest(lang: str) -> bytes:
    return hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _parts(batches):
    """(languages, texts) of about CHUNK_BYTES."""
    for batch in batches:
        for lo, hi in slices(np.diff(wordhash.buffers(batch.column("text"))[1]), CHUNK_BYTES):
            yield batch.column("lang").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo)


def _in_map(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _runs(words: Words, lang: np.ndarray, longer: bool, bitmap: np.ndarray | None):
    """Numbers of all runs of 1 and 2 words, or of all longer ones whose pairs are in the bitmap."""
    for hi, runs in fingerprints(words, lang):
        if not longer:
            for n in (1, 2):
                first, number = runs[n]
                yield number[: np.searchsorted(first, hi)]
            continue
        first, number = runs[2]
        pairs = np.zeros(len(words) + 1, bool)
        pairs[first] = _in_map(bitmap, number)
        for n in range(3, LONGEST + 1):
            first, number = runs[n]
            yield number[np.logical_and.reduce([pairs[first + k] for k in range(n - 1)])]


def _sums(longer: bool, bitmap):
    def sums(batches):
        """(number, how often), added up over SUM_ROWS occurrences or a little more."""
        held, n_held = [], 0

        def batch():
            number = np.concatenate(held)
            held.clear()
            number.sort()
            at = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(number[at].view(np.int64)), pa.array(np.diff(np.append(at, len(number))))], names=["number", "a"])

        for langs, texts in _parts(batches):
            for number in _runs(Words(texts), _languages(langs), longer, bitmap.value if longer else None):
                held.append(number)
                n_held += len(number)
                if n_held > SUM_ROWS:
                    yield batch()
                    n_held = 0
        if n_held:
            yield batch()

    return sums


def _phrases(bitmap):
    def phrases(batches):
        """(lang, n, phrase, how often) of all runs whose number is in the bitmap; and n = 0 for all words of a language."""
        for langs, texts in _parts(batches):
            words, coded = Words(texts), langs.dictionary_encode()
            code = coded.indices.to_numpy().astype(np.int64)[words.text]

            def rows(n: int, own: np.ndarray, count: np.ndarray, text: pa.Array, names=coded.dictionary):
                return pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(np.full(len(own), n), pa.int32()), text, pa.array(count, pa.int64())], names=["lang", "n", "phrase", "a"])

            total = np.bincount(code, minlength=len(coded.dictionary))
            yield rows(0, np.arange(len(total)), total, pa.array([""] * len(total)))
            found = {n: ([], []) for n in range(1, LONGEST + 1)}
            for hi, runs in fingerprints(words, _languages(langs)):
                for n, (first, number) in runs.items():
                    keep = _in_map(bitmap.value, number) & (first < hi)
                    found[n][0].append(first[keep])
                    found[n][1].append(number[keep])
            for n, (first, number) in found.items():
                if first:
                    first, number = np.concatenate(first), np.concatenate(number)
                    a, z, own = words.start[first], words.end[first + n - 1], code[first]
                    head = wordhash.exact_groups(number, lambda i, j, a=a, z=z, own=own: _equal(words.raw, a, z, own, i, j))
                    at, count = np.unique(head, return_counts=True)
                    size = z[at] - a[at]
                    flat = words.raw[np.arange(int(size.sum())) + np.repeat(a[at] - (np.cumsum(size) - size), size)]
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    yield rows(n, own[at], count, pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(flat)))

    return phrases


def _equal(raw: np.ndarray, a: np.ndarray, z: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = (own[i] == own[j]) & (z[i] - a[i] == z[j] - a[j])
    at = np.flatnonzero(out)
    out[at] = wordhash.equal_ranges(raw, a[i[at]], a[j[at]], (z - a)[i[at]])
    return out


def _bitmap(numbers: DataFrame) -> np.ndarray:
    """A bit for each number, 16 times as many as numbers and MAP_BITS at most; made of words that the shuffle joins."""
    n = numbers.count()
    bits = min(MAP_BITS, 1 << max(10, math.ceil(math.log2(16 * max(n, 1)))))
    at = F.col("number").bitwiseAND(F.lit(bits - 1))
    words = numbers.select(F.shiftrightunsigned(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast((number & {bits - 1}) & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, np.uint64)
    for batch in words.select("w", "b").toArrow().to_batches():  # MAP_BITS / 64 rows at most
        out[batch.column("w").to_numpy()] = batch.column("b").to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, n, phrase, a) of every run of 1 to LONGEST words that a language has `least` times or more, and one row with
    n = 0 for each language, which holds all its words.  docs: (lang, text) without nulls."""
    spark = docs.sparkSession

    def often(longer: bool, bitmap) -> DataFrame:
        return docs.mapInArrow(_sums(longer, bitmap), "number long, a long").groupBy("number").agg(F.sum("a").alias("a")).filter(F.col("a") >= least).select("number")

    short = stored(often(False, None), "frequent-pairs")
    pairs = spark.sparkContext.broadcast(_bitmap(short))  # MAP_BITS at most
    long = stored(often(True, pairs), "frequent-runs")
    every = spark.sparkContext.broadcast(_bitmap(short.unionByName(long)))  # MAP_BITS at most
    counts = docs.mapInArrow(_phrases(every), "lang string, n int, phrase string, a long").groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a"))
    return stored(counts.filter((F.col("a") >= least) | ((F.col("n") == 0) & (F.col("a") > 0))), "frequent-phrases")


def _first(df: DataFrame, top: int, width: int) -> DataFrame:
    """Each language's first `top` with their rank: first among shares of its phrases, then among what those leave, so that
    no task ranks more than a few times `top` rows for it."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(width * 16))
    while width > 0:
        own = F.pmod(share, F.lit(width)) if width > 1 else F.lit(0)
        ranked = df.withColumn("share", own).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
        df = ranked.filter(F.col("rank") <= top).drop("share")
        width //= 16
    return df


@tidy
def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, part_of: int = PART_OF) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to LONGEST words with `least` occurrences.

    a, l, r are the occurrences of the phrase and of its parts at the cut with the lowest floor(2000000 a / (l + r)), n all
    words of the language.  A phrase goes if one that contains it has at least `part_of` per cent of its occurrences.
    """
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = frequent_phrases(docs, least)
    phrases = counts.filter("n > 0").select("lang", "phrase", "a")
    candidates = counts.filter("n > 1")
    w = F.split("phrase", " ")

    def run(at, size):
        return F.array_join(F.slice(w, at, size), " ")

    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1))
    cuts = candidates.select("lang", "phrase", "a", "n", cut.alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", run(F.lit(1), F.col("k")).alias("left"), run(F.col("k") + 1, F.col("n") - F.col("k")).alias("right"))
    parts = parts.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(phrases.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    score = F.expr("CAST((2000000 * CAST(a AS DECIMAL(19, 0))) div (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    scored = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    sizes = F.explode(F.filter(F.sequence(F.lit(2), F.lit(LONGEST)), lambda s: s < F.col("n")))
    inner = candidates.filter("n > 2").select("phrase", "lang", "a", "n", sizes.alias("size"))
    inner = inner.select("phrase", "lang", "a", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", run(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR 100 * CAST(longer AS DECIMAL(19, 0)) < {part_of} * CAST(a AS DECIMAL(19, 0))"))
    best = _first(kept.select("lang", "phrase", "a", "cut.*"), top, 4096)
    words = counts.filter("n = 0").select("lang", F.col("a").alias("n"))
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
