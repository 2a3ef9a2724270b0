"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are its words (A-Z lower-cased) and the shapes of its blank-separated tokens (runs of lower case,
upper case, digits and of each other sign shrunk to one; a word repeated at once counts as a shape too), hashed to a fixed number of dimensions, damped by logarithms
and weighted by inverse document frequency over all texts.  A truncated singular value decomposition of a bounded
sample of labelled texts gives the latent space.  The sample's vectors are broadcast; every text's cosine with every
one of them is computed exactly, in blocks, and the nearest vote with weights that grow with their similarity.

Only rows whose crc32(doc_id as text) mod 4 is not 2 teach.  FIT_ROWS bounds the sample (the rows with the smallest
hashes of their id); document frequencies come from all texts.  Defined results: a null, empty or wordless text scores
the sample's share of label 1; without usable labels every score is 0.5; labels of repeated rows that contradict each
other teach nothing; of several texts with one id the smallest teaches; labels
of ids that `documents` lacks take no place in the sample; cosines count to five digits, and of equally near rows the first
of the sample vote; repeated rows are scored alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import wordhash
from tabulon.llm.shared import SLICE_BYTES, documents_of, slices, stored, text_of

WORD_DIMS, SHAPE_DIMS = 3072, 1024
DIMS = WORD_DIMS + SHAPE_DIMS
FIT_ROWS, RANK, NEIGHBOURS, SHARPNESS = 4000, 64, 15, 4
CUT = 0.7


def _shape_classes() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 97, 65, 48, 97
    return kind


_SHAPE = _shape_classes()
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def term_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, DIMS) counts of hashed words and token shapes."""
    n = len(offsets) - 1
    words, per_text = wordhash.plain_words(raw, offsets)
    at = np.repeat(np.arange(n), per_text) * DIMS + (words % np.uint64(WORD_DIMS)).astype(np.int64)
    lo, hi, tokens = wordhash.runs(~_BLANK[raw], offsets)
    shape = _SHAPE[raw]
    kept = np.ones(len(raw), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[lo] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    shapes = wordhash.of_ranges(shape[kept], place[lo], place[hi])
    at2 = np.repeat(np.arange(n), tokens) * DIMS + WORD_DIMS + (shapes % np.uint64(SHAPE_DIMS)).astype(np.int64)
    owner = np.repeat(np.arange(n), per_text)
    again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
    at3 = owner[again] * DIMS + DIMS - 1  # a word just said counts as one more shape
    return np.bincount(np.concatenate([at, at2, at3]), minlength=n * DIMS).reshape(n, DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted and scaled: words and shapes each have length 1."""
    x = (np.log1p(counts) * idf).astype(np.float32)
    for part in (x[:, :WORD_DIMS], x[:, WORD_DIMS:]):
        part /= np.maximum(np.sqrt((part * part).sum(1, keepdims=True)), 1e-9)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k columns with the largest values, in order of their numbers; of equal values the first columns."""
    least = np.partition(near, -k, axis=1)[:, [-k]]
    above, level = near > least, near == least
    chosen = above | (level & (np.cumsum(level, axis=1) <= k - above.sum(1, keepdims=True)))
    return np.nonzero(chosen)[1].reshape(len(near), k)


@dataclass
class NeighbourModel:
    idf: np.ndarray
    basis: np.ndarray  # DIMS x rank
    vectors: np.ndarray  # labelled rows x rank, unit length
    labels: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(counts), prior)
        if not len(self.labels):
            return out
        near = np.round(_unit(weighted(counts, self.idf) @ self.basis) @ self.vectors.T, 5)
        top = nearest(near, min(NEIGHBOURS, near.shape[1]))
        weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(1)
        some = (total > 1e-12) & (counts.sum(1) > 0)
        out[some] = ((weight * self.labels[top]).sum(1) / np.maximum(total, 1e-12))[some]
        return np.clip(np.round(out, 6), 0, 1)


def latent_basis(x: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    rank = min(rank, *x.shape)
    q = np.linalg.qr(x.T @ np.random.default_rng(7).standard_normal((x.shape[0], rank)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    return q.astype(np.float32)


def _blocks(batch: pa.RecordBatch):
    for lo, hi in slices(np.diff(wordhash.buffers(batch.column("text"))[1]), SLICE_BYTES):
        for a in range(lo, hi, 128):
            part = batch.slice(a, min(128, hi - a))
            yield part, term_counts(*wordhash.buffers(part.column("text")))


def _frequencies(batches):
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for _, counts in _blocks(batch):
            total += (counts > 0).sum(0)
            n += len(counts)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["dim", "n"])


def _sparse(batches):
    for batch in batches:
        for part, counts in _blocks(batch):
            rows = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([r.astype(np.uint16).tobytes() for r in rows]), pa.array([c[r].astype(np.int32).tobytes() for c, r in zip(counts, rows, strict=True)])], names=["label", "at", "counts"])


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> NeighbourModel:
    """docs: (doc_id, text); labels: (doc_id, quality)."""
    spread = docs.select("doc_id", "text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # DIMS + 1 rows at most
    freq = {r["dim"]: r["n"] for r in spread}
    idf = np.log((1 + freq.get(-1, 0)) / (1 + np.array([freq.get(k, 0) for k in range(DIMS)], np.float64))) + 1
    taught = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other")
    there = docs.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct()
    taught = stored(taught.join(there, "doc_id", "left_semi").filter(~is_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select("doc_id", "label"), "fit-rows")
    # fit_rows is the bound of what is broadcast and of what comes to the driver
    rows = docs.join(F.broadcast(taught), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "label", "text").mapInArrow(_sparse, "label int, at binary, counts binary").collect()
    rows.sort(key=lambda r: (bytes(r["at"]), bytes(r["counts"]), r["label"]))
    x = np.empty((len(rows), DIMS), np.float32)  # 64 MB with FIT_ROWS rows; filled some rows at a time
    for lo in range(0, len(rows), 128):
        counts = np.zeros((min(128, len(rows) - lo), DIMS), np.int32)
        for own, r in zip(counts, rows[lo : lo + 128], strict=True):
            own[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["counts"], np.int32)
        x[lo : lo + 128] = weighted(counts, idf)
    basis = latent_basis(x) if len(rows) else np.zeros((DIMS, 1), np.float32)
    return NeighbourModel(idf, basis, _unit(x @ basis), np.array([r["label"] for r in rows], np.float64))


def accepted(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """df's rows, all columns kept, whose score reaches CUT."""
    docs = documents_of(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))  # about 2 MB, whatever the data
    rows, at = df.select(F.struct("*").alias("row")), df.columns.index(text_col)

    def choose(batches):
        for batch in batches:
            row = batch.column("row")
            for part, counts in _blocks(pa.RecordBatch.from_arrays([row, text_of(row, at)], names=["row", "text"])):
                good = np.flatnonzero(model.value.scores(counts) >= CUT)
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(good))], names=["row"])

    return rows.mapInArrow(choose, T.StructType([rows.schema["row"]])).select("row.*")


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text."""
    docs = documents_of(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))  # about 2 MB, whatever the data

    def score(batches):
        for batch in batches:
            for part, counts in _blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.value.scores(counts))], names=["doc_id", "score"])

    scored = docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
