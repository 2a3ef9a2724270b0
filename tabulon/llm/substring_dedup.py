"""Exact removal of repeated substrings across documents, by suffix arrays over the places that can matter.

Every window of 50 bytes is assigned the smallest hash of the 20-byte strings inside it, so equal windows have equal
minimizers.  Neighbouring windows with one minimizer form a run, about 16 windows.  Hashes only deal out the work:

1. Documents are dealt into buckets of bounded size.  A bucket tells the shards (ranges of minimizers, mixed once more,
   as minima crowd at the low end) its distinct runs, 8 bytes each: 48 bits of the minimizer, a fingerprint, and whether
   several of its documents have the run.
2. A shard answers which minimizers are met again anywhere, and which are hot: around them stand more than HOT different
   runs.  All other windows are settled: no other document can have them.
3. A bucket sends the bytes of its runs with such minimizers to cells, each distinct run once; what repeats inside the
   bucket, byte for byte, is cut there for all but the smallest document.  Runs go to their minimizer's cell.  Around a
   hot minimizer the single windows go, each to the cell of its own hash, so a frequent string in ever new surroundings
   spreads over all cells.
4. In a cell runs that are equal byte for byte become one, of the smallest document; over all that are left a suffix
   array (two-stage sorting) brings equal windows together, the common prefixes of neighbours delimit them, and all but
   those of the smallest document are cut.
5. Cuts return to the buckets, which remove them.

The plan shuffles the texts once.  A bucket sends a cell or a shard at most one row, and no more rows than it has runs.
A passage that every bucket holds costs its cell one run of about 70 bytes and 26 of bookkeeping per bucket.

Defined results: a null text is empty; texts under 50 bytes keep everything; rows with one doc_id do not affect each
other; rows whose doc_id is null keep everything and affect nothing; an empty table gives no rows; further columns are
ignored.  doc_id must be an integer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm import suffix_array, wordhash
from tabulon.llm.shared import SLICE_BYTES, documents_of, shuffle_width, slices

LENGTH, GRAM = 50, 20
#: texts per bucket; texts whose runs meet in one shard, and in one cell; bytes under one suffix array
BUCKET_BYTES, SHARD_BYTES, CELL_BYTES, COMPARED_BYTES = 8_000_000, 64_000_000, 12_000_000, 1_000_000
HOT, HOT_WINDOWS = 2048, 500_000  # windows around hot minimizers that a bucket works on at once
KEY_BITS = 48  # of minimizers and windows' hashes
SMALL_BITS = np.uint64(64 - KEY_BITS)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def gram_numbers(raw: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A number for each string of `width` bytes: numbers of strings twice as long come from two halves."""
    x, have, out, done = wordhash.byte_values(raw), 1, None, 0
    while True:
        if width & have:
            if out is None:
                out = x
            else:
                out = wordhash.mix(out[: len(x) - done] * np.uint64(0x9FB21C651E98DF25) + x[done:])
            done += have
        have *= 2
        if have > width:
            return out[: len(raw) - width + 1]
        x = wordhash.mix(x[: len(x) - have // 2] * np.uint64(0x9FB21C651E98DF25) + x[have // 2 :])


def find_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, end, minimizer, hash) of every run; start and end are byte positions in `raw`."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = gram_numbers(raw)
    least = _sliding_min(grams, LENGTH - GRAM + 1)
    valid = np.zeros(len(least) + 1, np.int64)
    lo, hi = offsets[:-1], offsets[1:] - LENGTH + 1
    some = hi > lo
    np.add.at(valid, lo[some], 1)
    np.add.at(valid, hi[some], -1)
    valid = np.cumsum(valid[:-1]) > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + LENGTH
    # the strings at both ends, and one in the middle for longer runs, tell most runs apart
    own = wordhash.mix(grams[start] + wordhash.mix(grams[end - GRAM] + wordhash.mix(grams[(start + end - GRAM) // 2] + (end - start).astype(np.uint64))))
    return np.searchsorted(offsets, start, side="right") - 1, start, end, wordhash.mix(least[start]) >> SMALL_BITS, own


def _texts(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of a bucket in order of both, so that a row has the same place whenever the bucket is read."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table
    column = table.column("text").combine_chunks()
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return table.column("doc_id").to_numpy().astype(np.int64), column


class _Bucket:
    """All runs of a bucket in order of (minimizer, hash, document, place), and where its distinct ones begin: entries."""

    def __init__(self, table: pa.Table):
        self.ids, self.texts = _texts(table)
        sizes = np.diff(wordhash.buffers(self.texts)[1])
        parts = []
        for lo, hi in slices(sizes, SLICE_BYTES):
            raw, offsets = wordhash.buffers(self.texts.slice(lo, hi - lo))
            row, start, end, least, own = find_runs(raw, offsets)
            parts.append((row + lo, start - offsets[row], end - offsets[row], least, own))
        row, start, end, least, own = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 5
        order = np.lexsort([row, own, least])  # rows stand in order of their ids
        self.row, self.start, self.end, self.least, self.own = row[order], start[order], end[order], least[order].astype(np.uint64), own[order].astype(np.uint64)
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.least[1:] != self.least[:-1]) | (self.own[1:] != self.own[:-1])
        self.entry_at = np.flatnonzero(fresh)
        self.entry = np.cumsum(fresh) - 1

    def several(self) -> np.ndarray:
        """Of each entry: do several documents have it?"""
        last = np.append(self.entry_at[1:], len(self.row)) - 1 if len(self.entry_at) else self.entry_at
        return self.ids[self.row[last]] > self.ids[self.row[self.entry_at]]


def _ranges(keys: np.ndarray, n: int):
    """(range, from, to) of ordered keys dealt into n ranges, those that hold some."""
    bounds = np.searchsorted(keys, np.array([(k << KEY_BITS) // n for k in range(n + 1)], np.uint64))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, int(bounds[k]), int(bounds[k + 1])


def _united(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, from, to) with overlapping and touching ranges of one owner made one, in order."""
    order = np.lexsort([lo, owner])
    owner, lo, hi = owner[order], lo[order], hi[order]
    if not len(owner):
        return owner, lo, hi
    fresh = np.append(True, owner[1:] != owner[:-1])
    group = np.cumsum(fresh) - 1
    lift = int(hi.max()) + 1  # so that a running maximum does not reach from one owner into the next
    reach = np.maximum.accumulate(hi + group * lift) - group * lift
    fresh[1:] |= lo[1:] > reach[:-1]
    return owner[fresh], lo[fresh], reach[np.append(fresh[1:], True)]


def _bytes_at(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """raw[begin:begin + size] of all ranges, one after another."""
    total = int(size.sum())
    return raw[np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)] if total else raw[:0]


_KINDS = (np.uint8, np.uint16, np.int32, np.int64)


def _packed(content: np.ndarray) -> bytes:
    return len(content).to_bytes(8, "little") + pa.compress(content.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"), np.uint8)


def _short(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest type that holds them, which the first byte names."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    kind = next(k for k, t in enumerate(_KINDS) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([kind]) + x.astype(_KINDS[kind]).tobytes()


def _long(rows: list[dict], column: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(r[column], _KINDS[r[column][0]], offset=1).astype(np.int64) for r in rows]) if rows else np.empty(0, np.int64)


def _narrow(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // (KEY_BITS // 8), 8), np.uint8)
    out[:, : KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BITS // 8)
    return out.view("<u8").ravel()


ENTRIES = "shard int, bucket int, least binary, print binary, several binary"
REPLIES = "bucket int, shard int, flags binary"
SENT = "key int, kind int, bucket int, least binary, ids binary, places binary, starts binary, sizes binary, content binary"
CUTS = "bucket int, places binary, starts binary, sizes binary"


def _rows(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _schema(ddl)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def _repeated(text: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of the windows that a segment of a smaller document has too; segments stand one after another."""
    begin = np.cumsum(size) - size
    segment = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(text)) - begin[segment]
    order = suffix_array.suffix_array(text)
    order = order[offset[order] <= size[segment[order]] - LENGTH]
    fresh = suffix_array.common_prefixes(text, order) < LENGTH
    owner = ids[segment[order]]
    gone = order[owner > np.minimum.reduceat(owner, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]] if len(order) else order
    gone = np.sort(gone)  # windows of a segment in order: neighbours become one cut
    seg, off = segment[gone], offset[gone]
    head = np.ones(len(gone), bool)
    head[1:] = (seg[1:] != seg[:-1]) | (off[1:] > off[:-1] + LENGTH)
    tail = np.append(head[1:], True) if len(gone) else head
    return seg[head], off[head], off[tail] + LENGTH


def _steps(n_shards: int, n_cells: int):
    def entries(table: pa.Table) -> pa.Table:
        b = _Bucket(table)
        least, mark, several = b.least[b.entry_at], (b.own[b.entry_at] >> np.uint64(48)).astype(np.uint16), b.several()
        bucket = table.column("bucket")[0].as_py()
        return _rows([(k, bucket, _narrow(least[lo:hi]), mark[lo:hi].tobytes(), np.packbits(several[lo:hi]).tobytes()) for k, lo, hi in _ranges(least, n_shards)], ENTRIES)

    def reply(table: pa.Table) -> pa.Table:
        """Per entry: 0 if no other document can have its windows, 1 if one may, 2 if the minimizer is hot besides."""
        rows = table.to_pylist()
        least = np.concatenate([_wide(r["least"]) for r in rows])
        mark = np.concatenate([np.frombuffer(r["print"], np.uint16) for r in rows])
        size = [len(r["least"]) // (KEY_BITS // 8) for r in rows]
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=n).astype(bool) for r, n in zip(rows, size, strict=True)])
        order = np.lexsort([mark, least])
        fresh = np.ones(len(order), bool)
        fresh[1:] = least[order][1:] != least[order][:-1]
        other = fresh.copy()
        other[1:] |= mark[order][1:] != mark[order][:-1]
        group = np.cumsum(fresh) - 1
        again = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0)
        hot = np.bincount(group, other) > HOT
        flags = np.empty(len(order), np.uint8)
        flags[order] = (again.astype(np.uint8) + (again & hot))[group]
        cut = np.cumsum([0, *size])
        return _rows([(r["bucket"], r["shard"], flags[a:z].tobytes()) for r, a, z in zip(rows, cut, cut[1:], strict=False) if flags[a:z].any()], REPLIES)

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        """Kind 0: cuts that are settled, to their bucket.  Kind 1: bytes whose windows are to be compared, to a cell."""
        if not table.num_rows:
            return _rows([], SENT)
        b = _Bucket(table)
        bucket = table.column("bucket")[0].as_py()
        flags = np.zeros(len(b.entry_at), np.uint8)
        told = {r["shard"]: r["flags"] for r in replies.to_pylist()}
        for k, lo, hi in _ranges(b.least[b.entry_at], n_shards):
            if k in told:
                flags[lo:hi] = np.frombuffer(told[k], np.uint8)
        flag = flags[b.entry]
        raw, offsets = wordhash.buffers(b.texts)
        out, gone = [], []

        def asked(row: np.ndarray, start: np.ndarray, end: np.ndarray, least: np.ndarray, keys: np.ndarray) -> None:
            """Ranges in order of (least, document): cut what a smaller document of the bucket has, send the others."""
            begin = offsets[row] + start
            first = wordhash.exact_ranges(raw, begin, begin + end - start, keys)
            own = b.ids[row]
            repeated = own > own[first]
            gone.append((row[repeated], start[repeated], end[repeated]))
            row, start, end, least, begin = (x[~repeated] for x in (row, start, end, least, begin))
            for k, lo, hi in _ranges(least, n_cells):
                out.append((k, 1, bucket, _narrow(least[lo:hi]), _short(b.ids[row[lo:hi]]), _short(row[lo:hi]), _short(start[lo:hi]), _short(end[lo:hi] - start[lo:hi]), _packed(_bytes_at(raw, begin[lo:hi], end[lo:hi] - start[lo:hi]))))

        at = np.flatnonzero(flag == 1)
        asked(b.row[at], b.start[at], b.end[at], b.least[at], b.own[at])
        hot = np.flatnonzero(flag == 2)
        windows = b.end[hot] - b.start[hot] - LENGTH + 1
        for lo, hi in slices(windows, HOT_WINDOWS):  # what repeats across slices is for the cells to find
            at, n = hot[lo:hi], windows[lo:hi]
            row, start = np.repeat(b.row[at], n), np.repeat(b.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            number = wordhash.of_windows(raw, offsets[row] + start, LENGTH)
            order = np.lexsort([row, number])
            asked(row[order], start[order], start[order] + LENGTH, number[order] >> SMALL_BITS, number[order])
        row, lo, hi = _united(*(np.concatenate(x) for x in zip(*gone, strict=True)))
        if len(row):
            out.append((bucket, 0, bucket, b"", b"", _short(row), _short(lo), _short(hi - lo), b""))
        return _rows(out, SENT)

    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [(r["bucket"], r["places"], r["starts"], r["sizes"]) for r in rows if r["kind"] == 0]
        rows = [r for r in rows if r["kind"] == 1]
        if not rows:
            return _rows(out, CUTS)
        least = np.concatenate([_wide(r["least"]) for r in rows])
        ids, places, starts, size = (_long(rows, c) for c in ("ids", "places", "starts", "sizes"))
        bucket = np.repeat([r["bucket"] for r in rows], [len(r["least"]) // (KEY_BITS // 8) for r in rows])
        text = np.concatenate([_unpacked(r.pop("content")) for r in rows])
        del rows
        begin = np.cumsum(size) - size
        order = np.lexsort([ids, least])  # equal windows have equal keys: these stay together
        least, ids, places, starts, size, bucket, begin = (x[order] for x in (least, ids, places, starts, size, bucket, begin))
        ends8 = np.lib.stride_tricks.sliding_window_view(text, 8)
        head, tail = (np.ascontiguousarray(ends8[at]).view(np.uint64).ravel() for at in (begin, begin + size - 8))
        keys = wordhash.mix(least + wordhash.mix(head + wordhash.mix(tail + size.astype(np.uint64))))
        first = wordhash.exact_ranges(text, begin, begin + size, keys)
        whole = np.flatnonzero(ids > ids[first])
        found = [(whole, np.zeros(len(whole), np.int64), size[whole])]
        alone = np.flatnonzero(first == np.arange(len(first)))
        twins = np.flatnonzero((first != np.arange(len(first))) & (ids == ids[first]))
        twins = twins[np.argsort(first[twins], kind="stable")]
        last = np.flatnonzero(np.append(least[alone][1:] != least[alone][:-1], True))
        total = np.cumsum(size[alone])
        x = 0
        while x < len(alone):
            reach = np.searchsorted(total, (total[x - 1] if x else 0) + COMPARED_BYTES)
            y = int(last[np.searchsorted(last, min(reach, len(alone) - 1))]) + 1
            own = alone[x:y]
            x = y
            seg, lo, hi = _repeated(_bytes_at(text, begin[own], size[own]), size[own], ids[own])
            seg = own[seg]
            found.append((seg, lo, hi))
            # the same document's other runs of these bytes fare alike
            a, z = (np.searchsorted(first[twins], seg, side=s) for s in ("left", "right"))
            n = z - a
            each = np.repeat(np.arange(len(seg)), n)
            found.append((twins[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], lo[each], hi[each]))
        seg, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
        to = bucket[seg]
        order = np.argsort(to, kind="stable")
        seg, lo, hi, to = seg[order], lo[order], hi[order], to[order]
        for k in np.unique(to).tolist():
            at = slice(np.searchsorted(to, k), np.searchsorted(to, k, side="right"))
            out.append((k, _short(places[seg[at]]), _short(starts[seg[at]] + lo[at]), _short(hi[at] - lo[at])))
        return _rows(out, CUTS)

    def cut(table: pa.Table, cuts: pa.Table) -> pa.Table:
        ids, texts = _texts(table)
        rows = cuts.to_pylist()
        which, lo, size = (_long(rows, c) for c in ("places", "starts", "sizes"))
        which, lo, hi = _united(which, lo, lo + size)
        first, last = (np.searchsorted(which, np.arange(len(ids)), side=s) for s in ("left", "right"))
        out = []
        for k, s in enumerate(texts.to_pylist()):
            data = s.encode()
            begin, end = lo[first[k] : last[k]].tolist(), hi[first[k] : last[k]].tolist()
            kept = b"".join(data[x:y] for x, y in zip([0, *end], [*begin, len(data)], strict=True))
            out.append((len(data), len(data) - len(kept), len(begin), begin, end, hashlib.sha256(kept).hexdigest()))
        n_bytes, n_removed, n_spans, begin, end, digest = zip(*out, strict=True) if out else [[]] * 6
        spans = pa.list_(pa.int64())
        return pa.table({"doc_id": pa.array(ids), "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "span_starts": pa.array(begin, spans), "span_ends": pa.array(end, spans), "kept_sha256": pa.array(digest, pa.string())})

    return entries, reply, send, compare, cut


def repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, span_starts, span_ends, kept_sha256): spans are the removed byte ranges."""
    docs = documents_of(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    width = shuffle_width(df.sparkSession)
    n = max(1, width, -(-total // BUCKET_BYTES))
    entries, reply, send, compare, cut = _steps(max(1, min(width, n), -(-total // SHARD_BYTES)), max(1, width, -(-total // CELL_BYTES)))
    dealt = docs.filter("doc_id is not null").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))
    replies = dealt.groupBy("bucket").applyInArrow(entries, ENTRIES).groupBy("shard").applyInArrow(reply, REPLIES)
    sent = dealt.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(send, SENT)
    cuts = sent.groupBy("key", "kind").applyInArrow(compare, CUTS)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, span_starts array<long>, span_ends array<long>, kept_sha256 string"
    judged = dealt.groupBy("bucket").cogroup(cuts.groupBy("bucket")).applyInArrow(cut, out)
    none = F.array().cast("array<long>")
    whole = docs.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), none.alias("span_starts"), none.alias("span_ends"), F.sha2("text", 256).alias("kept_sha256"))
    return judged.unionByName(whole)
