"""Language-model scores: a hidden Markov model over word classes, and words within their class.

A text is its words (A-Z lower-cased) and one end.  The chain moves among STATES latent states; each emits a class, and a
class emits a word.  A word's class is a number of its bytes, the end has class 0; so the emission table has a fixed size
whatever the vocabulary.  Words within a class go by their counts over all training texts, with 0.1 added to each and
to one that stands for every unknown word: P(w | s) = P(class | s) * (c + 0.1) / (N_class + 0.1 * (V_class + 1)).

Baum-Welch trains states: every round reads all training texts, each task adds up expected starts, moves and emissions of
its texts, the shuffle adds up the tasks' sums, and the driver, which gets STATES * (CLASSES + STATES + 2) numbers, makes
the next model.  For training a text is read in runs of SEGMENT tokens, of which later ones begin with the states'
average; sums are whole numbers (2^20 to one), so the order of adding does not matter.

Scores are exact: the scaled forward recursion over the whole text.  Texts advance together, one token at a time; what
remains when fewer than STATES texts go on is cut into segments, whose transfer matrices are made together and then
applied in turn, which gives the same sums.

Texts are numbered once: a block of texts holds its distinct words and, packed, its words' numbers.  A block's words meet
the counts in a join over words and come back as one row a word; counts know no cap, and no vocabulary goes anywhere
whole.

Defined results: a null text is empty, and an empty one is an end alone; a null id is not held out; repeated rows teach
and are scored each; without training texts every word is unknown; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import wordhash
from tabulon.llm.shared import documents_of, slices, stored, tidy

STATES, CLASSES, ROUNDS = 8, 8192, 5
BLOCK_BYTES = 8_000_000  # text of a block (one text at least)
SEGMENT = 128  # tokens that training reads as one run
STEP_TOKENS = 250_000  # tokens whose probabilities are held at once
UNIT = float(1 << 20)
ADD = 0.1
PRIOR = 100.0  # emissions of each state that go by the classes' overall shares

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


@dataclass
class Chain:
    start: np.ndarray  # by state
    entry: np.ndarray  # by state, for runs within a text
    move: np.ndarray  # from state, to state
    emission: np.ndarray  # by class, state


def first_chain(share: np.ndarray, states: int) -> Chain:
    """Before training: states that tend to last, and emissions around the classes' shares, each state's own way."""
    noise = wordhash.mix(np.arange(1, len(share) * states + 1, dtype=np.uint64)) >> np.uint64(11)
    emission = share[:, None] * (0.1 + -np.log((noise.reshape(len(share), states) + 1) / 2.0**53))
    even = np.full(states, 1 / states)
    return Chain(even, even, 0.9 * np.eye(states) + 0.1 / states, emission / emission.sum(0))


def next_chain(expected: np.ndarray, share: np.ndarray, states: int) -> Chain:
    """From expected starts, occupations, moves and emissions, one after another."""
    start, entry, rest = expected[:states], expected[states : 2 * states], expected[2 * states :]
    move, emission = rest[: states * states].reshape(states, states) + 1, rest[states * states :].reshape(len(share), states) + PRIOR * share[:, None]
    return Chain((start + 1) / (start + 1).sum(), (entry + 1) / (entry + 1).sum(), move / move.sum(1, keepdims=True), emission / emission.sum(0))


def _together(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs from the longest to the shortest, and how many of them have a token at each step."""
    order = np.argsort(-size, kind="stable")
    return order, np.searchsorted(-size[order], -np.arange(int(size.max()) if len(size) else 0))


def expected_counts(tokens: np.ndarray, size: np.ndarray, chain: Chain) -> np.ndarray:
    """One Baum-Welch step's expectations over texts of `size` tokens (classes) that stand one after another."""
    states, classes = len(chain.start), len(chain.emission)
    n_runs = -(-size // SEGMENT)
    owner = np.repeat(np.arange(len(size)), n_runs)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    begin = (np.cumsum(size) - size)[owner] + number * SEGMENT
    length = np.minimum(SEGMENT, size[owner] - number * SEGMENT)
    starts, entries, moves, emitted = np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
    move, emission = chain.move.astype(np.float32), chain.emission.astype(np.float32)
    for lo, hi in slices(length, STEP_TOKENS):
        order, active = _together(length[lo:hi])
        at, fresh = begin[lo:hi][order], number[lo:hi][order] == 0
        a = np.where(fresh[:, None], chain.start, chain.entry).astype(np.float32)
        seen, forward, emit, scale = [], [], [], []
        for t, n in enumerate(active.tolist()):
            seen.append(tokens[at[:n] + t])
            emit.append(emission[seen[-1]])
            a = (a[:n] @ move if t else a) * emit[-1]
            scale.append(a.sum(1, keepdims=True))
            a = a / scale[-1]
            forward.append(a)
        back, gammas, n_next = None, [None] * len(active), 0
        for t in range(len(active) - 1, -1, -1):
            b = np.ones((int(active[t]), states), np.float32)
            if n_next:
                onward = emit[t + 1] * back / scale[t + 1]
                moves += forward[t][:n_next].T @ onward
                b[:n_next] = onward @ move.T
            gammas[t] = forward[t] * b
            back, n_next = b, len(b)
        gamma, cls = np.concatenate(gammas), np.concatenate(seen)
        starts += gammas[0][fresh].sum(0)
        entries += gamma.sum(0, dtype=np.float64)
        for s in range(states):
            emitted[s] += np.bincount(cls, gamma[:, s], classes)
    return np.concatenate([starts, entries, (moves * chain.move).ravel(), emitted.T.ravel()])


def log_likelihoods(tokens: np.ndarray, size: np.ndarray, chain: Chain) -> np.ndarray:
    """log10 of each text's probability under the chain, by the scaled forward recursion."""
    states = len(chain.start)
    begin = np.cumsum(size) - size
    order, active = _together(size)
    out, at = np.zeros(len(size)), begin[order]
    head = len(active) if len(active) == 0 else max(1, int((active >= states).sum()))
    a = np.tile(chain.start, (len(size), 1))
    for t, n in enumerate(active[:head].tolist()):
        last, a = a, (a[:n] @ chain.move if t else a[:n]) * chain.emission[tokens[at[:n] + t]]
        scale = a.sum(1)
        out[order[:n]] += np.log10(scale)
        a = a / scale[:, None]
    for k in range(int(active[head]) if head < len(active) else 0):  # fewer than `states` texts, of which the rest is cut
        text = order[k]
        state, total = a[k], 0.0
        for lo in range(head, int(size[text]), STEP_TOKENS):
            hi = min(lo + STEP_TOKENS, int(size[text]))
            for matrix, power in zip(*_transfers(tokens[begin[text] + lo : begin[text] + hi], chain), strict=True):
                state = state @ matrix
                scale = state.sum()
                state, total = state / scale, total + np.log10(scale) + power
        out[text] += total
    return out


def _transfers(tokens: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """For each SEGMENT of the tokens the product of its steps, scaled, and log10 of the scale."""
    states = len(chain.start)
    n = -(-len(tokens) // SEGMENT)
    product, power = np.tile(np.eye(states), (n, 1, 1)), np.zeros(n)
    for t in range(min(SEGMENT, len(tokens))):
        own = tokens[t::SEGMENT]
        x = (product[: len(own)].reshape(-1, states) @ chain.move).reshape(len(own), states, states) * chain.emission[own][:, None, :]
        scale = x.sum((1, 2))
        product[: len(own)], power[: len(own)] = x / scale[:, None, None], power[: len(own)] + np.log10(scale)
    return product, power


def _packed(numbers: np.ndarray) -> bytes:
    """Small numbers: their bytes by weight, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


_BLOCK = ["block", "ids", "held", "sizes", "numbers", "words", "classes", "taught"]


def _numbering(classes: int):
    def number(batches):
        """Blocks: ids, which are held out, words per text, numbers of the words, and of each distinct word, the most
        frequent first, its class and how often training texts have it."""
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi in slices(np.diff(wordhash.buffers(batch.column("text"))[1]), BLOCK_BYTES):
                rows = batch.slice(lo, hi - lo)
                raw, offsets = wordhash.buffers(rows.column("text"))
                raw = _LOWER[raw]
                start, end, size = wordhash.runs(~_BLANK[raw], offsets)
                key = wordhash.of_stretches(raw, start, end)
                first = wordhash.exact_ranges(raw, start, end, key)
                head = np.flatnonzero(first == np.arange(len(first)))
                place = np.empty(len(first), np.int64)
                place[head] = np.arange(len(head))
                index = place[first]
                order = np.argsort(-np.bincount(index, minlength=len(head)), kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                head, numbers = head[order], place[index]
                held = rows.column("held").to_numpy(zero_copy_only=False).astype(bool)
                taught = np.bincount(numbers[~np.repeat(held, size)], minlength=len(head))
                a, n = start[head], (end - start)[head]
                flat = raw[np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)]
                words = pa.StringArray.from_buffers(len(head), pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.py_buffer(flat))
                cls = 1 + (key[head] % np.uint64(classes - 1)).astype(np.int64)

                def one(values: pa.Array) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

                columns = [pa.array([(part << 32) + count], pa.int64()), one(rows.column("doc_id")), one(rows.column("held")), pa.array([size.astype("<i4").tobytes()]), pa.array([_packed(numbers)]), one(words), one(pa.array(cls, pa.int32())), one(pa.array(taught, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=_BLOCK)
                count += 1

    return number


def _sequences(sizes: bytes, numbers: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, the words' numbers, and the classes of all tokens, each text's end among them."""
    size = np.frombuffer(sizes, "<i4").astype(np.int64)
    word = _unpacked(numbers, int(size.sum()))
    tokens = np.zeros(len(word) + len(size), np.int64)
    tokens[np.arange(len(word)) + np.repeat(np.arange(len(size)), size)] = classes[word] if len(word) else word
    return size, word, tokens


def _expectations(chain, states: int, classes: int):
    def expect(batches):
        total = np.zeros(states * (2 + states + classes))
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                size, _, tokens = _sequences(row.column("sizes")[0].as_py(), row.column("numbers")[0].as_py(), row.column("classes").flatten().to_numpy())
                taught = ~row.column("held").flatten().to_numpy(zero_copy_only=False).astype(bool)
                if taught.any():
                    total += np.rint(UNIT * expected_counts(tokens[np.repeat(taught, size + 1)], size[taught] + 1, chain.value))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["at", "v"])

    return expect


def train(blocks: DataFrame, share: np.ndarray, states: int, rounds: int) -> Chain:
    classes = len(share)
    chain = first_chain(share, states)
    for _ in range(rounds):
        known = blocks.sparkSession.sparkContext.broadcast(chain)  # a table of states * classes
        sums = blocks.select("sizes", "numbers", "classes", "held").mapInArrow(_expectations(known, states, classes), "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        expected = np.zeros(states * (2 + states + classes))
        expected[sums.column("at").to_numpy()] = sums.column("v").to_numpy() / UNIT
        chain = next_chain(expected, share, states)
        known.unpersist()
    return chain


def _scoring(chain, in_class: np.ndarray, n_all: int, n_kinds: int, n_ends: int):
    base_of = 1 / (n_all + ADD * (n_kinds + 1))

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        row = block.slice(0, 1)
        cls = row.column("classes").combine_chunks().flatten().to_numpy()
        size, word, tokens = _sequences(row.column("sizes")[0].as_py(), row.column("numbers")[0].as_py(), cls)
        c = np.zeros(len(cls), np.int64)
        c[replies.column("at").to_numpy()] = replies.column("c").to_numpy()
        base, within = np.log10((c + ADD) * base_of), np.log10((c + ADD) / in_class[cls])
        text = np.repeat(np.arange(len(size)), size)
        n = len(size)
        base_score = np.bincount(text, base[word], n) + np.log10((n_ends + ADD) * base_of)
        known = np.bincount(text, c[word] > 0, n).astype(np.int64) + (n_ends > 0)
        model = np.bincount(text, within[word], n) + log_likelihoods(tokens, size + 1, chain.value)
        columns = [row.column("ids").combine_chunks().flatten(), row.column("held").combine_chunks().flatten(), size + 1, known, np.full(n, n_all), base_score, model]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


@tidy
def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities of
    the whole text, the base one from single tokens' counts, the other from the chain."""
    spark, docs = df.sparkSession, documents_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"block long, ids array<{kind}>, held array<boolean>, sizes binary, numbers binary, words array<string>, classes array<int>, taught array<long>"
    blocks = stored(docs.select("doc_id", is_held_out().alias("held"), "text").mapInArrow(_numbering(classes), schema), "numbered")
    n_ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")).first()["n"] or 0
    words = blocks.select("block", F.posexplode(F.arrays_zip("words", "classes", "taught")).alias("at", "x")).select("block", "at", "x.*")
    counts = stored(words.groupBy("words", "classes").agg(F.sum("taught").alias("c")).filter("c > 0"), "counts")
    c, kinds = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for row in counts.groupBy("classes").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # a row a class
        c[row["classes"]], kinds[row["classes"]] = row["c"], row["v"]
    in_class = c + ADD * (kinds + 1)
    share = np.append(n_ends + ADD, in_class[1:])
    chain = spark.sparkContext.broadcast(train(blocks, share / share.sum(), states, rounds if n_ends else 0))  # states * classes
    replies = words.select("block", "at", "words").join(counts.select("words", "c"), "words").select(F.col("block").alias("of"), "at", "c")
    score = _scoring(chain, in_class, int(c.sum()) + n_ends, int(kinds.sum()) + (n_ends > 0), n_ends)
    whole = blocks.select("block", "ids", "held", "sizes", "numbers", "classes")
    return whole.groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
