"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

At every position the automaton's output links list the pieces that end there; each relaxes the best score of the
position.  The model file is of SentencePiece's BPE kind, where a segmentation scores 0 if every two neighbours would
also stay apart alone and minus infinity otherwise: exactly one piece per position survives, and following these pieces
back from the end of a word gives the library's ids.  (Adding up the pieces' stored scores, as for a unigram model,
would not: they only number the merges.)  The relaxations are kept as transitions of a deterministic automaton, so
that all words of a batch advance in lockstep.

Defined results: a null or empty text has no ids and decodes to an empty text; characters without a piece become one
byte piece per UTF-8 byte; order, repetition of rows and further columns do not matter.  decode() gives back any text
but for the character U+2581, which stands for a blank.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.automaton import LazyTransducer, MergeVocabulary
from tabulon.llm.shared import SLICE_BYTES, documents_of, slices

BLANK = "▁"
NORMAL, BYTE, BPE = 1, 6, 2  # fixed values: piece types and the model kind of the model format


def _fields(buf: bytes):
    """(field number, value) of a protocol-buffer message: an int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, buf[at : at + n]
            at += n


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id.  Models of another kind than BPE, and such that change characters first, are refused."""
    pieces = []
    for number, value in _fields(data):
        if number == 2 and dict(_fields(value)).get(3, 1) != BPE:
            raise ValueError("a model of SentencePiece's BPE kind is expected")
        if number == 3:
            f = dict(_fields(value))
            if f.get(2) or not f.get(3, 1) or f.get(4, 1) or not f.get(5, 1):
                raise ValueError("the model changes characters before it encodes; only a blank put first is supported")
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
    return pieces


class PieceCodec:
    """Encoder and decoder of one worker."""

    def __init__(self, data: bytes):
        pieces = read_model(data)
        self.byte_id = np.full(256, 0, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        normal = {i: p for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        chars = sorted({c for p in normal.values() for c in p})
        number = {c: k for k, c in enumerate(chars)}
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(c) for c in chars]] = np.arange(len(chars))
        self.symbol[ord(" ")] = self.symbol[ord(BLANK)]
        order = sorted(normal, key=lambda i: (-pieces[i][1], i))
        rank = {i: r for r, i in enumerate(order)}
        ids = {p: i for i, p in normal.items()}

        @lru_cache(200_000)
        def pair_rank(a: int, b: int) -> int | None:
            joined = ids.get(normal[a] + normal[b])
            return None if joined is None else rank[joined]

        # a character that is only part of longer pieces cannot be a symbol of its own
        single = {c for c in chars if c in ids}
        self.symbol[[ord(c) for c in chars if c not in single]] = -1
        usable = {i: tuple(number[c] for c in p) for i, p in normal.items() if set(p) <= single}
        self.machine = LazyTransducer(MergeVocabulary(usable, pair_rank), len(chars))
        self.length = np.zeros(len(pieces), np.int64)
        for i, p in normal.items():
            self.length[i] = len(p)
        self.spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode() if kind == NORMAL else b"" for p, _, kind in pieces]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids end."""
        self.machine.tidy()
        joined = "".join(" " + s if s else "" for s in texts)  # a blank is put before a text that is not empty
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        symbols = self.symbol[cp].astype(np.int64)
        known = symbols >= 0
        blank = symbols == self.symbol[ord(BLANK)]
        text_ends = np.cumsum([len(s) + 1 if s else 0 for s in texts])
        # words: blanks and what follows them; no piece has a blank after another character
        fresh = np.ones(len(cp), bool)
        fresh[1:] = (blank[1:] & ~blank[:-1]) | ~known[1:] | ~known[:-1]
        fresh[text_ends[text_ends < len(cp)]] = True
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(cp))
        word = known[starts]
        starts, ends = starts[word], ends[word]
        tokens = np.full(len(cp), -1, np.int32)
        self.machine.run(symbols, starts, ends, np.zeros(len(starts), np.int32), tokens)
        taken = np.zeros(len(cp), bool)
        at, low = ends - 1, starts
        while len(at):
            taken[at] = True
            at = at - self.length[tokens[at]]
            more = at >= low
            at, low = at[more], low[more]
        odd = np.flatnonzero(~known)
        width = taken.astype(np.int64)
        if len(odd):
            spelled = [chr(c).encode() for c in cp[odd].tolist()]
            width[odd] = [len(b) for b in spelled]
        before = np.concatenate([[0], np.cumsum(width)])
        ids = np.empty(before[-1], np.int32)
        ids[before[:-1][taken]] = tokens[taken]
        if len(odd):
            flat = np.frombuffer(b"".join(spelled), np.uint8)
            n = width[odd]
            ids[np.repeat(before[odd] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = self.byte_id[flat]
        return ids, before[text_ends]

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def _codec(data: bytes) -> PieceCodec:
    return PieceCodec(data)


def _model(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text."""
    model = _model(df, model_path)

    def run(batches):
        codec = _codec(model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(np.array([len(s) for s in texts], np.int64), SLICE_BYTES):
                ids, ends = codec.encode(texts[lo:hi])
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    docs = documents_of(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the inverse of encode(); null ids are an empty text."""
    model = _model(df, model_path)

    def run(batches):
        codec = _codec(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x) if x else "" for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encode_and_check(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), and decode() of its result held against the text, in one pass over the rows.

    (doc_id, n_chars, n_ids, ids_sha256 of the ids joined by commas, round_trip: decoding gives the text back).
    """
    model = _model(df, model_path)

    def run(batches):
        codec = _codec(model.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(np.array([len(s) for s in texts], np.int64), SLICE_BYTES):
                ids, ends = codec.encode(texts[lo:hi])
                flat, out, at = ids.tolist(), [], 0
                for s, to in zip(texts[lo:hi], ends.tolist(), strict=True):
                    own, at = flat[at:to], to
                    out.append((len(s), len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), codec.decode(own) == s.replace(BLANK, " ")))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3])], names=["doc_id", "n_chars", "n_ids", "ids_sha256", "round_trip"])

    docs = documents_of(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, n_ids long, ids_sha256 string, round_trip boolean")
