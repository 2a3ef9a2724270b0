"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows (ten consecutive words; one window for a shorter item) are sequences of shingles of three words.  A
document contains a window only if it contains its rarest shingle, so that shingle is the window's prefix.  A first pass
over the documents counts the benchmark's shingles in all of them, which orders them by rarity; a window with a shingle
that no document has is out.  A second pass joins the documents' positions with the prefixes alone.  A prefix's place in
the window fixes where the window would begin and end in the document (positional and length bounds), and the document's
words there are then compared with the window's.  Shingles are joined by hashes of their words; only that comparison
decides.

Defined results: null or empty texts have no words; an item without words has no window; repeated rows each get their
result, rows that share a doc_id but not the text are judged apart (by a 64-bit hash of the text: only rows of one
doc_id could be taken for each other); a null doc_id is kept; item ids may repeat and then count once per id, a null one
as an empty one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import stored, tidy

WINDOW, SHINGLE = 10, 3
#: beyond so many benchmark shingles they are joined by shuffle instead of broadcast (about 200 bytes each with their windows)
BROADCAST_SHINGLES = 400_000
#: between words; capitals A-Z still count as parts of words here
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    """Words before A-Z are lower-cased; the array may hold one empty string at either end of the text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BETWEEN), lambda w: w != "")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded(text: Column) -> Column:
    """Lower case of all letters, whatever stands around them: a sigma's small form depends on what follows the word."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, len): every distinct window of every item, its words joined by blanks."""
    words = items.select("item_id", raw_words(lowered(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s, F.lit(window)))).alias("w"))
    return windows.select("item_id", F.array_join("w", " ").alias("win"), F.size("w").alias("len")).distinct()


def _shingles_of(windows: DataFrame, shingle: int) -> DataFrame:
    """(win, len, k, size, h): hashes of every shingle, in order k, of every distinct window."""
    w = windows.select("win", "len").distinct().withColumn("w", F.split(folded(F.col("win")), " "))
    size = F.least(F.size("w"), F.lit(shingle))
    parts = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda s: F.slice("w", s, size))
    placed = w.select("win", "len", size.alias("size"), F.posexplode(parts).alias("k", "s"))
    h = F.lit(None).cast("long")
    for n in range(1, shingle + 1):
        h = F.when(F.col("size") == n, _hash([F.get("s", F.lit(i)) for i in range(n)])).otherwise(h)
    return placed.select("win", "len", "k", "size", h.alias("h"))


def _hash(words: list[Column]) -> Column:
    """Of words in lower case; the number of words counts, so sizes do not meet."""
    return F.xxhash64(*words, F.lit(len(words)))


MARKS = 4096  # keys from 0 under which the rows' own entries go among the positions: no key holds them all


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, tk, n_words, pos, h): the hash of each size at each position, and one entry per row with pos -1.

    Lower case beyond A-Z may bring more together; it takes nothing apart and leaves the bounds of words alone.
    """
    w = F.array_remove(F.split(folded(F.coalesce("text", F.lit(""))), BETWEEN), "")
    d = docs.select("doc_id", F.xxhash64("text").alias("tk"), F.concat(F.array(F.lit("")), w).alias("w0"))
    most = max(sizes, default=1)
    names = [f"w{i}" for i in range(most)]
    zipped = F.arrays_zip("w0", *[F.slice("w0", F.lit(i + 1), F.size("w0")).alias(names[i]) for i in range(1, most)])
    at = d.select("doc_id", "tk", (F.size("w0") - 1).alias("n_words"), F.posexplode(zipped).alias("pos", "z"))
    own = [F.when(F.col("pos") == 0, F.pmod(F.xxhash64("doc_id", "tk"), F.lit(MARKS)))]
    keys = [F.when(F.col(f"z.{names[n - 1]}").isNotNull(), _hash([F.col(f"z.{x}") for x in names[:n]])) for n in sizes]
    every = [F.coalesce(own[0], keys[0]) if keys else own[0], *[F.when(F.col("pos") > 0, k) for k in keys[1:]]]
    h = every[0] if len(every) == 1 else F.explode(F.array(*every))
    return at.select("doc_id", "tk", "n_words", (F.col("pos") - 1).alias("pos"), h.alias("h")).filter("h is not null")


def _scanned(df: DataFrame, benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Every row as (doc_id, tk, n_words), and what is found: (doc_id, tk, win, start, len)."""
    windows = stored(_shingles_of(benchmark_windows(benchmark, window), shingle), "windows")
    facts = windows.agg(F.countDistinct("h").alias("n"), F.collect_set("size").alias("sizes")).first()  # `shingle` sizes at most
    small, sizes = facts["n"] <= BROADCAST_SHINGLES, sorted(facts["sizes"])

    def sent(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if small else keys

    counts = _positions(df, sizes).filter("pos >= 0").select("h").join(sent(windows.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("cnt"))
    rarest = F.min(F.struct(F.coalesce("cnt", F.lit(0)).alias("cnt"), "h", "k"))
    prefix = windows.join(counts, "h", "left").groupBy("win", "len").agg(rarest.alias("p")).filter("p.cnt > 0").select("win", "len", F.col("p.h").alias("h"), F.col("p.k").alias("k"))
    prefix = stored(prefix, "prefixes")
    keys = prefix.select("h").unionByName(df.sparkSession.range(MARKS).select(F.col("id").alias("h"))).distinct()
    met = stored(_positions(df, sizes).join(sent(keys), "h"), "prefix-hits")  # a shingle that has a mark's number finds no prefix
    start = F.col("pos") - F.col("k")
    cand = met.filter("pos >= 0").join(sent(prefix), "h").withColumn("start", start).filter("start >= 0 and start + len <= n_words")
    cand = cand.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "len", "win")).alias("c"))  # of one text's own positions
    cand = cand.select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), "c")
    texts = df.select("doc_id", F.xxhash64("text").alias("tk"), "text").join(cand, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")))
    texts = texts.select("doc_id", "tk", raw_words(lowered(F.col("text"))).alias("w"), "c")
    there = F.filter("c", lambda c: F.array_join(F.slice("w", c["start"] + 1, c["len"]), " ") == c["win"])
    found = texts.select("doc_id", "tk", F.inline(there)).select("doc_id", "tk", "win", "start", "len").distinct()
    return met.filter("pos < 0").select("doc_id", "tk", "n_words"), found


def find_contamination(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tk, item_id, start, len): every occurrence of a window; start counts words from 0, tk tells texts apart."""
    _, found = _scanned(df, benchmark, window, shingle)
    return found.join(benchmark_windows(benchmark, window).select("item_id", "win"), "win").select("doc_id", "tk", "item_id", "start", "len")


@tidy
def contaminated_texts(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tk) of the texts that hold a window of any item; tk is the text's xxhash64."""
    return _scanned(df, benchmark, window, shingle)[1].select("doc_id", "tk").distinct()


@tidy
def contamination_report(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, tk, n_words, n_hit, items) per row: words hit, and the items with occurring windows as sorted strings."""
    rows, found = _scanned(df, benchmark, window, shingle)
    found = stored(found, "windows-found")
    spans = found.select("doc_id", "tk", "start", "len").distinct()
    n_hit = spans.select("doc_id", "tk", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("doc_id", "tk").agg(F.count("*").alias("n_hit"))
    named = found.select("doc_id", "tk", "win").distinct().join(benchmark_windows(benchmark, window).select("item_id", "win"), "win")
    items = named.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    hit = n_hit.select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), "n_hit").join(items.select(F.col("doc_id").alias("d2"), F.col("tk").alias("t2"), "items"), F.col("d").eqNullSafe(F.col("d2")) & (F.col("t") == F.col("t2"))).select("d", "t", "n_hit", "items")
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tk") == F.col("t")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "tk", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
