"""Text search and retrieval over token arrays and vectors."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HONORIFICS = frozenset({"mr", "mrs", "ms", "dr", "hon", "judge", "justice"})


def lexemes(c: Column | str) -> Column:
    """Distinct lower-case words of a text."""
    text = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def query_terms(q: str) -> list[str]:
    terms = [t for t in re.split(r"[\W_]+", q.lower()) if t]
    return [t for t in terms if t not in HONORIFICS] or terms


def _any_begins(words: Column, term: str) -> Column:
    return F.exists(words, lambda w: F.startswith(w, F.lit(term)))


def prefix_match(words: Column, q: str) -> Column:
    """Every term of the query begins some word."""
    out = F.lit(True)
    for t in query_terms(q):
        out &= _any_begins(words, t)
    return out


def prefix_search(c: Column | str, q: str) -> Column:
    """prefix_match() on a text itself: no text is split.  A term that does not occur at all costs one plain search."""
    text = F.lower(F.col(c) if isinstance(c, str) else c)
    out = F.lit(True)
    for t in query_terms(q):
        out &= F.contains(text, F.lit(t))
    for t in query_terms(q):
        out &= text.rlike(rf"(?:^|[^\p{{L}}\p{{N}}]){re.escape(t)}")
    return out


@dataclass(frozen=True)
class WebQuery:
    """What a search line asks for: words and phrases that must occur, groups of alternatives, exclusions."""

    groups: tuple[tuple[tuple[str, ...], ...], ...]
    excluded: tuple[tuple[str, ...], ...]


def parse_web_query(q: str) -> WebQuery:
    """Quoted phrases, OR between neighbours, a leading minus excludes."""
    if q.count('"') % 2:
        raise ValueError("a quotation mark is not closed")
    groups: list[list[tuple[str, ...]]] = []
    excluded, joined = [], False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', q):
        if word == "OR" and not minus:
            joined = bool(groups)
            continue
        part = tuple(query_terms(phrase or word))
        if not part:
            continue
        if minus:
            excluded.append(part)
        elif joined:
            groups[-1].append(part)
        else:
            groups.append([part])
        joined = False
    return WebQuery(tuple(map(tuple, groups)), tuple(excluded))


def web_match(c: Column | str, q: str) -> Column:
    """Does a text match a search line?  Phrases match as word sequences."""
    text = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " "), F.lit(" "))
    parsed = parse_web_query(q)

    def has(part: tuple[str, ...]) -> Column:
        return F.contains(text, F.lit(f" {' '.join(part)} "))

    out = F.lit(True)
    for group in parsed.groups:
        any_of = F.lit(False)
        for part in group:
            any_of |= has(part)
        out &= any_of
    for part in parsed.excluded:
        out &= ~has(part)
    return out


def phrase_match(c: Column | str, phrases: list[str]) -> Column:
    """Does a text hold any of the phrases as a sequence of whole words?"""
    words = F.filter(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    text = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out |= F.contains(text, F.lit(f" {' '.join(t for t in re.split(r'[\W_]+', p.lower()) if t)} "))
    return out


def query_problem(c: Column | str, longest: int = 2000) -> Column:
    """Why a search line would be misread, or null: empty, too long, quotes or parentheses that do not pair, a range
    without TO in capitals, a wildcard after fewer than three letters."""
    q = F.col(c) if isinstance(c, str) else c
    bare = F.regexp_replace(q, '"[^"]*"', "")
    marks = F.filter(F.split(F.regexp_replace(bare, "[^()]", ""), ""), lambda m: m != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(acc: Column, m: Column) -> Column:
        depth = acc["depth"] + F.when(m == "(", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.least(acc["least"], depth).alias("least"))

    level = F.aggregate(marks, start, step)
    problem = F.when(F.coalesce(F.trim(q), F.lit("")) == "", "empty").when(F.length(q) > longest, "too long")
    problem = problem.when((F.length(q) - F.length(F.replace(q, F.lit('"'), F.lit("")))) % 2 == 1, "quotes")
    problem = problem.when((level["least"] < 0) | (level["depth"] != 0), "parentheses")
    problem = problem.when(q.rlike(r"\[[^\]]*\s+to\s+[^\]]*\]") & ~q.rlike(r"\[[^\]]*\sTO\s[^\]]*\]"), "range")
    return problem.when(q.rlike(r"(^|[\s(:])(!\p{L}{1,2}(?=[\s)]|$)|\p{L}{1,2}\*(?=[\s)]|$))"), "wildcard")


def inverted_index(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(term, id, tf, first): one row per term and document.  Rows of one id, where there are such, count as one document."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    found = postings(df, id_col, words, "tf", "first")
    if df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return found
    return found.groupBy("term", "id").agg(F.sum("tf").alias("tf"), F.min("first").alias("first"))


POSTING_WORDS = 500_000  # words that a worker groups at a time, or one text's
_POSTING = {"tf": "long", "first": "int", "positions": "array<int>"}


def postings(df: DataFrame, id_col: str, words: Column, *wanted: str) -> DataFrame:
    """(term, id, and what is wanted of tf, first and positions): one row per row of df and distinct word in it.  Every
    text is grouped where it lies, so nothing is shuffled."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join(["term string", f"id {kind}", *(f"{w} {_POSTING[w]}" for w in wanted)])
    return df.select(F.col(id_col).alias("id"), words.alias("words")).mapInArrow(_grouped_words(wanted), schema)


def _grouped_words(wanted: tuple[str, ...]):
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def group(ids: pa.Array, lists: pa.Array, sizes: np.ndarray) -> pa.RecordBatch:
        coded = lists.flatten().dictionary_encode()
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        place = np.arange(len(code), dtype=np.int32) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.int32)
        order = np.argsort(code.astype(np.uint16) if len(coded.dictionary) <= 1 << 16 else code, kind="stable")  # rows and places stay in order
        code, row, place = code[order], row[order], place[order]
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])][: len(code)])
        out = {"term": coded.dictionary.take(pa.array(code[start])), "id": ids.take(pa.array(row[start]))}
        for w in wanted:
            if w == "positions":
                out[w] = pa.ListArray.from_arrays(pa.array(np.r_[start, len(place)], pa.int32()), pa.array(place))
            else:
                out[w] = pa.array(np.diff(np.r_[start, len(place)]) if w == "tf" else place[start])
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        for batch in batches:
            lists = batch.column("words")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            part = (np.cumsum(size) - size) // POSTING_WORDS
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(size) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                yield group(batch.column("id").slice(lo, hi - lo), lists.slice(lo, hi - lo), size[lo:hi])

    return run


def tiered(df: DataFrame, title: str, body: str, q: str, ordinal: str) -> DataFrame:
    """Rows that match in title or body, titles first, then by ordinal."""
    in_title, in_any = prefix_search(title, q), prefix_search(F.concat_ws(" ", title, body), q)
    return df.filter(in_any).withColumn("tier", F.when(in_title, 0).otherwise(1)).orderBy("tier", ordinal)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


ROW_BLOCK = 20_000  # rows that meet a block of queries in one task


def nearest(df: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, block: int = 2_000) -> DataFrame:
    """(query, id, score, place): exact cosine neighbours of the queries among all rows, a query itself left out.

    Queries are dealt into blocks, rows into blocks, and every block of queries meets every block of rows in a group of
    its own, which keeps its best k per query; these are merged by query.  Nothing goes through the driver but two
    counts; a group holds `block` queries and ROW_BLOCK rows or a little more, whatever the data.  Ties go to the
    smaller id; rows without a vector are left out.
    """
    import math

    rows = df.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    asked = queries.filter(F.col(vector).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    n_rows, n_asked = max(1, math.ceil(rows.count() / ROW_BLOCK)), max(1, math.ceil(asked.count() / block))
    rows = rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(n_rows))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_asked - 1).cast("long"))))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_asked))).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
    kind = df.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    best = asked.groupBy("q", "r").cogroup(rows.groupBy("q", "r")).applyInArrow(_best_of_blocks(k), f"query {kind}, id {kind}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.withColumn("place", place).filter(F.col("place") <= k)


def _best_of_blocks(k: int):
    import numpy as np
    import pyarrow as pa

    def unit(table: pa.Table) -> np.ndarray:
        x = table.column("v").combine_chunks()
        m = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        a, b, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if asked.num_rows and rows.num_rows:
            rows = rows.sort_by("id")
            x, found = unit(rows).T, []
            own = unit(asked)
            for lo in range(0, len(own), 20):
                scores = np.round(own[lo : lo + 20] @ x, 9)
                keep = min(k + 1, scores.shape[1])  # one more: the query itself may be among them
                edge = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
                i, j = np.nonzero(scores >= edge)
                order = np.lexsort([j, -scores[i, j], i])  # rows stand in order of their ids
                i, j = i[order], j[order]
                nth = np.arange(len(i)) - np.searchsorted(i, i)
                found.append((i[nth <= k] + lo, j[nth <= k], scores[i, j][nth <= k]))
            a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
        query, other = asked.column("id").take(pa.array(a)), rows.column("id").take(pa.array(b))
        apart = np.array([x != y for x, y in zip(query.to_pylist(), other.to_pylist(), strict=True)], bool)
        return pa.table({"query": query, "id": other, "score": s}).filter(pa.array(apart))

    return best


def retrieval_scores(found: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(queries, recall, mrr): found (query, id, place, good), in which `good` marks what was wanted, held against wanted
    (query, n), how many rows each query wants; queries that want none are left out."""
    good = F.col("good") & (F.col("place") <= k)
    per = found.groupBy("query").agg(F.count_if(good).alias("hits"), F.min(F.when(good, F.col("place"))).alias("first"))
    both = wanted.filter("n > 0").join(per, "query", "left")
    return both.agg(F.count("*").alias("queries"), F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def best_passages(passages: DataFrame, record: str, passage: str, score: str, k: int) -> DataFrame:
    """(record, passage, score, place): the k records with the best passages, each with that passage; of equally good ones
    the first passage, the smaller record.  What a record has is aggregated before anything is sorted."""
    best = passages.filter(F.col(score).isNotNull()).groupBy(F.col(record).alias("record")).agg(F.max(F.struct(F.col(score).alias("score"), (-F.col(passage)).alias("n"))).alias("b"))
    top = best.select("record", (-F.col("b.n")).alias("passage"), "b.score").orderBy(F.desc("score"), "record").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "record")))  # k rows
