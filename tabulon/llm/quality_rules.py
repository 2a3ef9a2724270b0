"""Quality rules whose thresholds adapt to each language and source.

The texts' base counts are taken in one pass.  Ratios of them are then, for texts that pass the base rules, summarised
per (language, source) by mergeable quantile sketches: counts of logarithmic bins, each 2 % wide, which add up exactly
whatever the partitioning and lose at most 1 % of a value.  A group's sketch is mixed with PRIOR texts that are spread
as its language is, and that one with PRIOR texts spread as the whole table is: small groups lean on their parents, and
no group size switches anything.

Each ratio's threshold comes from its mixed sketch alone, the lower of two: a fence, the 90 % quantile and SPREAD times
its distance from the median, which stands where up to a tenth of a group is junk; and MARGIN times the quantile TAIL,
which finds what is far out in a clean group.  Where quantiles are 0 the step between a ratio's values takes their
place: the least count that can occur (one symbol, one line, RUN + 1 repeated words) in a text of the group's median
length.  The filter joins the thresholds to the texts.

Words are runs of anything but blanks, tabs and line ends (U+0020, U+0009-U+000D).  Defined results: a null or empty
text has no words and fails the base rules; null languages and sources are groups of their own; repeated rows count as
often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.shared import SLICE_BYTES, slices, stored, tidy

SYMBOLS = b"#*$%&|<>"
RUN = 8  # words of a window
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
BIN = 1.02
PRIOR = 50
#: ratio -> (numerator, denominator, least positive numerator)
RATIOS = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_words", 1), "repeats": ("n_repeat_words", "n_words", RUN + 1), "word_length": ("word_chars", "n_words", 0)}
LENGTH = "words"  # sketched beside the ratios: the texts' numbers of words
SPREAD = 4.0
TAIL, MARGIN = 0.99, 1.25


def _marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _SYMBOL = _marks(bytes([32, *range(9, 14)])), _marks(SYMBOLS)


def _again(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items given by the first that equals each: which occur twice or more, and which repeat an earlier one."""
    return (np.bincount(first, minlength=len(first)) > 1)[first], first != np.arange(len(first))


def text_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every text.  Lines are told apart by their bytes, words too, and windows by their words."""
    n = len(offsets) - 1
    space = _SPACE[raw]
    starts, ends, n_words = wordhash.runs(~space, offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def apart(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return wordhash.mix(keys + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    chars = per_text(~space & ((raw & 0xC0) != 0x80))
    symbols = per_text(_SYMBOL[raw])
    # lines with a word: runs of anything but \n in which a word begins
    lo, hi, lines = wordhash.runs(raw != 10, offsets)
    worded = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    owner, lo, hi = np.repeat(np.arange(n), lines)[worded], lo[worded], hi[worded]

    def same_line(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = (owner[i] == owner[j]) & (hi[i] - lo[i] == hi[j] - lo[j])
        at = np.flatnonzero(out)
        out[at] = wordhash.equal_ranges(raw, lo[i[at]], lo[j[at]], hi[i[at]] - lo[i[at]])
        return out

    _, later = _again(wordhash.exact_groups(apart(owner, wordhash.of_ranges(raw, lo, hi)), same_line))
    dup_lines = np.bincount(owner[later], minlength=n)
    # windows of RUN words
    hashed = wordhash.of_ranges(raw, starts, ends)
    word = wordhash.exact_ranges(raw, starts, ends, hashed)
    first = np.cumsum(n_words) - n_words
    windows = np.maximum(n_words - RUN + 1, 0)
    of = np.repeat(np.arange(n), windows)
    at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + first[of]

    def same_window(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = of[i] == of[j]
        for k in range(RUN):
            out &= word[at[i] + k] == word[at[j] + k]
        return out

    twice, _ = _again(wordhash.exact_groups(apart(of, wordhash.of_windows(hashed, at, RUN)), same_window))
    cover = np.zeros(len(starts) + 1, np.int64)
    cover[at[twice]] += 1
    np.subtract.at(cover, at[twice] + RUN, 1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    repeats = covered[first + n_words] - covered[first]
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeats}


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def base_counts(df: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def count(batches):
        for batch in batches:
            for lo, hi in slices(np.diff(wordhash.buffers(batch.column("text"))[1]), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                got = text_counts(*wordhash.buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), part.column("source"), *[pa.array(got[x].astype(np.int64)) for x in names]], names=["doc_id", "lang", "source", *names])

    rows = df.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, source string, " + ", ".join(f"{x} long" for x in names))


def _bin(value: Column) -> Column:
    """Bin of a value: -100000 for 0; the value of bin b is BIN ** (b - 0.5)."""
    return F.when(value > 0, F.ceil(F.round(F.log(value) / F.lit(math.log(BIN)), 6))).otherwise(F.lit(-100000)).cast("int")


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, bin, n) of the texts that pass the base rules."""
    ratios = [F.struct(F.lit(k).alias("ratio"), _bin(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias("bin")) for k, (a, b, _) in RATIOS.items()]
    ratios.append(F.struct(F.lit(LENGTH).alias("ratio"), _bin(F.col("n_words").cast("double")).alias("bin")))
    return counts.filter(~_base_failed()).select("lang", "source", F.inline(F.array(*ratios))).groupBy("lang", "source", "ratio", "bin").agg(F.count("*").alias("n"))


def _bins(keys: list[str], sketch: DataFrame, weight: Column) -> DataFrame:
    """One row per sketch: its bins in order, each with its weight."""
    return sketch.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", weight.cast("double").alias("w")))).alias("bins"))


def parents(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(lang, ratio, bins): `prior` texts spread as the language's are, these mixed with `prior` spread as all are."""
    by_lang = sketch.groupBy("lang", "ratio", "bin").agg(F.sum("n").alias("n"))
    every = sketch.groupBy("ratio", "bin").agg(F.sum("n").alias("n"))
    langs = sketch.filter(F.col("ratio") == LENGTH).groupBy("lang").agg(F.sum("n").alias("lang_texts"))
    total = langs.agg(F.sum("lang_texts").alias("all_texts"))  # one row
    langs = langs.crossJoin(F.broadcast(total)).withColumnRenamed("lang", "l")
    of_all = langs.withColumn("ratio", F.explode(F.array(*map(F.lit, [*RATIOS, LENGTH])))).join(every, "ratio").select("l", "ratio", "bin", (prior * F.col("n") / F.col("all_texts")).alias("w"))
    of_lang = by_lang.select(F.col("lang").alias("l"), "ratio", "bin", F.col("n").cast("double").alias("w"))
    parent = of_lang.unionByName(of_all).groupBy("l", "ratio", "bin").agg(F.sum("w").alias("w"))
    parent = parent.join(langs.select(F.col("l").alias("k"), "lang_texts"), F.col("l").eqNullSafe(F.col("k")))
    return _bins(["l", "ratio"], parent, prior * F.col("w") / (F.col("lang_texts") + prior)).withColumnRenamed("l", "lang")


def _quantiles(bins: Column, shares: dict[str, float]) -> Column:
    """The values below which these shares of a sketch lie, in one walk over its bins."""
    total = F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + b["w"])
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("upto"), *[none.alias(k) for k in shares])

    def step(acc: Column, b: Column) -> Column:
        upto = acc["upto"] + b["w"]
        value = F.when(b["bin"] == -100000, 0.0).otherwise(F.pow(F.lit(BIN), b["bin"] - 0.5))
        return F.struct(upto.alias("upto"), *[F.when(acc[k].isNull() & (upto >= b["need"] * (p - 1e-9)), value).otherwise(acc[k]).alias(k) for k, p in shares.items()])

    with_total = F.element_at(F.transform(F.array(total), lambda t: F.transform(bins, lambda b: F.struct(b["bin"].alias("bin"), b["w"].alias("w"), t.alias("need")))), 1)
    return F.aggregate(with_total, start, step)


def thresholds(sketch: DataFrame, prior: float = PRIOR) -> DataFrame:
    """(lang, source, one column max_<ratio> each) of every group.

    A language's sketch is one array per ratio; a group's own bins meet it when its quantiles are looked up, so nothing of
    the language is copied to its groups but in passing.
    """
    parent = parents(sketch, prior).withColumnsRenamed({"lang": "_lang", "ratio": "_ratio", "bins": "_bins"})
    own = _bins(["lang", "source", "ratio"], sketch, F.col("n"))
    met = own.join(parent, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("ratio") == F.col("_ratio")))
    # a group without texts of some ratio does not occur: every text has them all
    q = met.select("lang", "source", "ratio", _quantiles(F.sort_array(F.concat("bins", "_bins")), {"q50": 0.5, "q90": 0.9, "tail": TAIL}).alias("q"))
    wide = q.groupBy("lang", "source").agg(*[F.max(F.when(F.col("ratio") == k, F.col("q"))).alias(k) for k in [*RATIOS, LENGTH]])

    def limit(k: str, least: int) -> Column:
        step = least / F.greatest(F.col(f"{LENGTH}.q50"), F.lit(1.0))
        fence = F.col(f"{k}.q90") + SPREAD * F.greatest(F.col(f"{k}.q90") - F.col(f"{k}.q50"), step)
        return F.round(F.least(fence, MARGIN * F.greatest(F.col(f"{k}.tail"), step)), 6)

    return wide.select("lang", "source", *[limit(k, least).alias(f"max_{k}") for k, (_, _, least) in RATIOS.items()])


@tidy
def judge_quality(df: DataFrame) -> DataFrame:
    """base_counts() with base_failed and kept.  A group none of whose texts passes the base rules has no thresholds."""
    counts = stored(base_counts(df), "counts")
    found = stored(thresholds(stored(sketches(counts), "sketches")), "thresholds").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = counts.join(found, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = _base_failed()
    within = F.lit(True)
    for k, (a, b, _) in RATIOS.items():
        within = within & (F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 6) <= F.col(f"max_{k}"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select("doc_id", *names, failed.alias("base_failed"), (~failed & F.coalesce(within, F.lit(False))).alias("kept"), "lang", "source")
