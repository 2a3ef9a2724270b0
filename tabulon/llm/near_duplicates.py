"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two link if the sets' Jaccard similarity is 0.8 or more.  Texts with the same
words are collapsed first, by a 128-bit digest of the words (a node and its number of rows).  Nodes that agree in a
band of six of 288 MinHash values are candidates; at the threshold 48 bands miss a pair with probability 5e-7.  Their
values are then compared 32 at a time, and a pair is dropped as soon as the posterior probability (uniform prior) that
its similarity reaches the threshold falls below the tolerance.  What stays is verified on the shingles themselves:
words are told apart by their bytes, shingles by their words; hashes only bring together what may be equal.

Candidates are found in rounds that emit no quadratic number of rows.  First every node of a bucket meets the bucket's
smallest node.  Only buckets whose nodes are not one component after that are looked at again: their nodes are dealt
into blocks, each pair of blocks is a group of its own, nodes of different components are compared there, and a group
gives a spanning forest of what survives.  So a component holds just nodes that surviving pairs connect, whatever the
buckets' sizes.  Inside components the texts are dealt into blocks of bounded bytes and rows; pairs are counted where
they are compared, never emitted.  The work inside one family of n near copies with different texts stays quadratic in
n, and each of its texts is sent to n / 512 groups; exact copies cost nothing.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  Defined results: fewer than five words
make one shingle; a null, empty or wordless text has no links and is its own class, as has a row whose id is null
(class null); repeated rows link to each other as copies; rows that share an id but not the text are judged apart; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import wordhash
from tabulon.llm.components import connected
from tabulon.llm.shared import SLICE_BYTES, documents_of, shuffle_width, slices, stored, text_of, tidy

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 48, 6, 32
BUCKET_BLOCK, BLOCK, BLOCK_BYTES = 256, 512, 2_000_000


@lru_cache(4)
def fewest_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, hashes: int = BANDS * ROWS) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ...: fewest of n equal MinHash values with which P(similarity >= threshold) >= tolerance."""
    out = []
    for n in range(STEP, hashes + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:  # with a uniform prior the posterior tail is a binomial one
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return tuple(out)


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    seeds = wordhash.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)


def _places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and end of every shingle, and shingles per text, from the texts' numbers of words."""
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    count = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    start = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return start, np.minimum(start + WORDS, first[1:][owner]), count


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle numbers of all texts, and shingles per text."""
    words, n = wordhash.plain_words(raw, offsets)
    start, end, count = _places(n)
    return wordhash.of_windows(words, start, WORDS, end), count


def exact_shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shingles(), with a third array in the middle: the same number for equal shingles only, by words and bytes."""
    plain, lo, hi, n = wordhash.plain_ranges(raw, offsets)
    words = wordhash.of_ranges(plain, lo, hi)
    word = wordhash.exact_ranges(plain, lo, hi, words)
    start, end, count = _places(n)
    values = wordhash.of_windows(words, start, WORDS, end)
    return values, wordhash.exact_ranges(word, start, end, values), count


def signatures(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of every text that has shingles, in order."""
    a, b = _hashes()
    at = (np.cumsum(count) - count)[count > 0]
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out, work = np.empty((len(at), len(a)), np.uint32), np.empty(len(low), np.uint32)
    for k in range(len(a)):
        np.multiply(low, a[k], out=work)
        np.add(work, b[k], out=work)
        np.bitwise_xor(work, work >> np.uint32(15), out=work)
        if len(at):
            out[:, k] = np.minimum.reduceat(work, at)
    return out


def _sketch(batches):
    """doc_id, text -> doc_id, digest, bands, bytes of the signature; wordless texts give no row."""
    for batch in batches:
        raw_sizes = np.diff(wordhash.buffers(batch.column(1))[1])
        for lo, hi in slices(raw_sizes, SLICE_BYTES):
            part = batch.slice(lo, hi - lo)
            raw, offsets = wordhash.buffers(part.column(1))
            values, count = shingles(raw, offsets)
            digests = wordhash.plain_digests(raw, offsets)
            some = np.flatnonzero(count > 0)
            sig = signatures(values, count)
            salt = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            keys = salt[None, :] + np.zeros((len(some), 1), np.uint64)
            for r in range(ROWS):
                keys = wordhash.mix(keys ^ sig[:, r::ROWS])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(keys.astype(np.int64).ravel()))
            small = sig.astype(np.uint8)  # the low byte: equal by chance in one of 256
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array([digests[k] for k in some.tolist()], pa.binary()), bands, pa.array([x.tobytes() for x in small], pa.binary()), pa.array(raw_sizes[lo:hi][some])], names=["doc_id", "digest", "bands", "sig", "size"])


def surviving(left: np.ndarray, right: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which rows of two signature matrices stay, comparing STEP values at a time."""
    alive, same = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(fewest_matches(threshold, tolerance, left.shape[1])):
        cut = slice(k * STEP, (k + 1) * STEP)
        same = same + (left[alive, cut] == right[alive, cut]).sum(1)
        stay = same >= least
        alive, same = alive[stay], same[stay]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _surviving_pairs(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ok = np.concatenate([c + surviving(sig[i[c : c + 20000]], sig[j[c : c + 20000]]) for c in range(0, max(len(i), 1), 20000)])
    return i[ok], j[ok]


def _roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number among all that pairs (i, j) connect with each place."""
    while len(i):
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        if (low == root).all():
            break
        root = low
    return root


def _groups(batches, names: tuple[str, ...]):
    """Tables of the rows with equal `names`, of batches in their order."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in names], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if lo == hi:
                continue
            if held and held_key != tuple(keys[lo].tolist()):
                yield pa.Table.from_batches(held)
                held = []
            held_key = tuple(keys[lo].tolist())
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _prune(batches):
    for batch in batches:
        keep = pa.array(surviving(_matrix(batch.column("sa")), _matrix(batch.column("sb"))))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], names=["a", "b"])


def _bridges(batches):
    """Rows (key, bi, bj, block, label, sig) in group order -> edges between components, a spanning forest a group."""
    for table in _groups(batches, ("key", "bi", "bj")):
        label, block = table.column("label").to_numpy(), table.column("block").to_numpy()
        sig = _matrix(table.column("sig"))
        i, j = np.triu_indices(len(label), 1)
        apart = label[i] != label[j]
        if table.column("bi")[0].as_py() != table.column("bj")[0].as_py():
            apart &= block[i] != block[j]
        i, j = _surviving_pairs(sig, i[apart], j[apart])
        names, at = np.unique(label, return_inverse=True)
        root = _roots(np.arange(len(names)), at[i], at[j])
        moved = np.flatnonzero(root != np.arange(len(names)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(names[root[moved]]), pa.array(names[moved])], names=["a", "b"])


def _dealt(df: DataFrame, blocks: Column) -> DataFrame:
    """df with block, and a copy for each pair (bi, bj) that its block is in."""
    df = df.withColumn("nb", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return df.withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))


def _components(nodes: DataFrame) -> DataFrame:
    """(node, label): components of the pairs that share a band and survive the pruning; lone nodes have no row.

    Joins whose smaller side grows with the data are merge joins at every size.
    """
    width = shuffle_width(nodes.sparkSession)
    exploded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("c")).filter("c > 1")
    members = stored(exploded.join(buckets.hint("merge"), "key").select("key", "node", "least", "c"), "members")
    pairs = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    sig = nodes.select("node", "sig")
    pairs = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    stars = stored(pairs.select("a", "b", "sa", "sb").mapInArrow(_prune, "a long, b long"), "stars")
    labels = connected(stars)
    placed = stored(members.filter("c > 2").join(labels, "node", "left").select("key", "node", "c", F.coalesce("label", "node").alias("label")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
    rest = _dealt(placed.join(open_keys, "key"), F.ceil(F.col("c") / BUCKET_BLOCK).cast("int")).join(sig, "node").select("key", "bi", "bj", "block", "label", "sig")
    rest = rest.repartition(width, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    bridges = rest.mapInArrow(_bridges, "a long, b long").distinct()
    return connected(stored(stars.unionByName(bridges), "candidates"))


def _links(sets: list[np.ndarray], sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that reach the threshold, pruned by signature, then exact."""
    size = np.array([len(s) for s in sets])
    able = np.minimum(size[i], size[j]) >= THRESHOLD * np.maximum(size[i], size[j]) - 1e-9
    i, j = _surviving_pairs(sig, i[able], j[able])
    if len(i) <= 3 * len(sets):
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], np.int64)
    else:  # dense: products of 0/1 matrices, some columns at a time
        flat, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        column, where = np.unique(column[shared], return_inverse=True)[1], where[shared]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for c in range(0, int(column.max(initial=-1)) + 1, 4096):
            own = (column >= c) & (column < c + 4096)
            m = np.zeros((len(sets), 4096), np.float32)
            m[where[own], column[own] - c] = 1
            total += m @ m.T
        both = total[i, j].astype(np.int64)
    yes = both >= THRESHOLD * (size[i] + size[j] - both) - 1e-9
    return i[yes], j[yes]


def _compare(batches):
    """Rows (component, bi, bj, block, node, copies, digest, text) in group order -> (node, links, root) of each group."""
    for table in _groups(batches, ("component", "bi", "bj")):
        text = table.column("text").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        raw, offsets = wordhash.buffers(text)
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        # one row per node: rows that repeat it go, and rows that only share its id
        true = np.flatnonzero([a == b for a, b in zip(wordhash.plain_digests(raw, offsets), table.column("digest").to_pylist(), strict=True)])
        first = np.sort(true[np.unique(node[true], return_index=True)[1]])
        values, exact, count = exact_shingles(raw, offsets)
        starts = np.cumsum(count) - count
        sets, hashed = [], []
        for r in first.tolist():
            own, at = np.unique(exact[starts[r] : starts[r] + count[r]], return_index=True)
            sets.append(own)
            hashed.append(values[starts[r] + at])
        node, copies, block = node[first], copies[first], block[first]
        sig = signatures(np.concatenate(hashed), np.array([len(s) for s in sets], np.int64)).astype(np.uint8)
        i, j = np.triu_indices(len(sets), 1)
        if table.column("bi")[0].as_py() != table.column("bj")[0].as_py():
            across = block[i] != block[j]
            i, j = i[across], j[across]
        i, j = _links(sets, sig, i, j)
        links = np.bincount(i, copies[j], len(sets)) + np.bincount(j, copies[i], len(sets))
        root = _roots(node, i, j)
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "root"])


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with words (doc_id, digest), and their digests' facts (digest, doc_id: the smallest, class_id, class_digest, n_links)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = stored(docs.filter("doc_id is not null").mapInArrow(_sketch, f"doc_id {kind}, digest binary, bands array<long>, sig binary, size long"), "sketches")
    nodes = base.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.max("size").alias("size"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    groups = _components(nodes)
    facts = stored(groups.join(nodes.select("node", "least_id", "copies", "digest", "size"), "node"), "grouped")
    size = facts.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    placed = facts.join(size, "label").select(F.col("label").alias("component"), "node", F.col("least_id").alias("doc_id"), "copies", "digest", blocks.alias("blocks"))
    placed = _dealt(docs.join(placed.hint("merge"), "doc_id"), F.col("blocks")).select("component", "bi", "bj", "block", "node", "copies", "digest", "text")
    placed = placed.repartition(shuffle_width(docs.sparkSession), "component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    compared = stored(placed.mapInArrow(_compare, "node long, links long, root long"), "compared")
    labels = connected(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = labels.join(nodes.select("node", "least_id", "digest"), "node")
    class_of = named.join(named.groupBy("label").agg(F.min(F.struct("least_id", "digest")).alias("c")), "label").select("node", F.col("c.least_id").alias("class_id"), F.col("c.digest").alias("class_digest"))
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    facts = nodes.select("node", "digest", "least_id", "copies").join(class_of, "node", "left").join(links, "node", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return base.select("doc_id", "digest"), facts.select("digest", F.col("least_id").alias("doc_id"), F.coalesce("class_id", "least_id").alias("class_id"), F.coalesce("class_digest", "digest").alias("class_digest"), n_links.alias("n_links"))


@tidy
def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) per row: the class is the connected component of links, named by its smallest id;
    n_links counts the other rows whose similarity to this one reaches the threshold."""
    docs = documents_of(df, id_col, text_col)
    base, facts = _judged(docs)
    judged = base.join(facts.drop("doc_id"), "digest").select("doc_id", "class_id", "n_links")
    rest = docs.filter(F.col("doc_id").isNull() | ~F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return judged.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


@tidy
def distinct_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows, all columns kept, but of each class only one: a row with the class's smallest id and, of several texts
    with that id, the smallest digest.  Rows without words or without an id all stay."""
    _, facts = _judged(documents_of(df, id_col, text_col))
    firsts = facts.filter("digest = class_digest").select("digest", "doc_id")
    rows, at = df.select(F.struct("*").alias("row")), df.columns.index(text_col)

    def digest(batches):
        for batch in batches:
            row = batch.column("row")
            texts = text_of(row, at)
            for lo, hi in slices(np.diff(wordhash.buffers(texts)[1]), SLICE_BYTES):
                found = wordhash.plain_digests(*wordhash.buffers(texts.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), row.slice(lo, hi - lo)], names=["digest", "row"])

    seen = rows.mapInArrow(digest, T.StructType([T.StructField("digest", T.BinaryType()), rows.schema["row"]])).withColumn("doc_id", F.col(f"row.{id_col}"))
    alone = seen.filter((F.octet_length("digest") == 0) | F.col("doc_id").isNull()).select("row.*")
    kept = seen.filter(F.octet_length("digest") > 0).join(firsts, ["digest", "doc_id"], "left_semi").dropDuplicates(["digest", "doc_id"])
    return kept.select("row.*").unionByName(alone)
