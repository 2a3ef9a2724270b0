import collections
import math
import random
import re
import zlib

import numpy as np

from tabulon.llm import hidden_markov as hm
from tabulon.llm import wordhash

SCHEMA = "doc_id long, text string, block string, words string, score string, c string"


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def class_of(word, classes):
    if word is None:
        return 0
    raw = np.frombuffer(word.encode(), np.uint8)
    return 1 + int(wordhash.of_stretches(raw, np.array([0]), np.array([len(raw)]))[0] % np.uint64(classes - 1))


def forward_backward(seq, start, chain):
    """Expected starts, occupations, moves, emissions of one run, without scaling; and its probability."""
    k = len(start)
    alpha = [[start[s] * chain.emission[seq[0]][s] for s in range(k)]]
    for x in seq[1:]:
        alpha.append([sum(alpha[-1][r] * chain.move[r][s] for r in range(k)) * chain.emission[x][s] for s in range(k)])
    beta = [[1.0] * k]
    for x in reversed(seq[1:]):
        beta.insert(0, [sum(chain.move[s][r] * chain.emission[x][r] * beta[0][r] for r in range(k)) for s in range(k)])
    p = sum(alpha[-1])
    gamma = np.array(alpha) * np.array(beta) / p
    moves = sum((np.outer(alpha[t], [chain.emission[seq[t + 1]][r] * beta[t + 1][r] for r in range(k)]) * chain.move / p for t in range(len(seq) - 1)), np.zeros((k, k)))
    return gamma, moves, p


def plainly(rows, states, classes, rounds):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    texts = [tokens(t) for _, t in rows]
    c = collections.Counter(w for x, h in zip(texts, held, strict=True) if not h for w in x)
    total, kinds, ends = sum(c.values()), len(c), c[None]
    in_class = np.full(classes, 0.1)
    for w, n in c.items():
        in_class[class_of(w, classes)] += n + 0.1
    share = np.append(ends + 0.1, in_class[1:])
    share /= share.sum()
    chain = hm.first_chain(share, states)
    for _ in range(rounds if ends else 0):
        starts, entries, moves, emitted = np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
        for x in (x for x, h in zip(texts, held, strict=True) if not h):
            seq = [class_of(w, classes) for w in x]
            for lo in range(0, len(seq), hm.SEGMENT):
                gamma, m, _ = forward_backward(seq[lo : lo + hm.SEGMENT], chain.entry if lo else chain.start, chain)
                starts += 0 if lo else gamma[0]
                entries += gamma.sum(0)
                moves += m
                np.add.at(emitted, seq[lo : lo + hm.SEGMENT], gamma)
        chain = hm.next_chain(np.concatenate([starts, entries, moves.ravel(), emitted.ravel()]), share, states)
    out = []
    for (i, _), h, x in zip(rows, held, texts, strict=True):
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in x)
        within = sum(math.log10((c[w] + 0.1) / in_class[class_of(w, classes)]) for w in x if w is not None)
        state, model = None, within
        for w in x:
            state = (chain.start if state is None else state @ chain.move) * chain.emission[class_of(w, classes)]
            model += math.log10(state.sum())
            state = state / state.sum()
        out.append((str(i), h, len(x), sum(c[w] > 0 for w in x), total, round(base, 6), round(model, 3)))
    return sorted(out)


def scored(df, **how):
    return sorted((str(r.doc_id), *tuple(r)[1:5], round(r.base_score, 6), round(r.score, 3)) for r in hm.score_texts(df, **how).collect())


def near(got, want):
    return len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 2e-3 * max(1, abs(b[6]) / 100) for a, b in zip(got, want, strict=True))


def rows_of(seed=2):
    rng = random.Random(seed)
    bags = [["the", "of", "And", "house", "été", "x"], ["der", "und", "HAUS", "😀", "x"], ["#", "1", "2", "3", "x"]]
    rows = [(k, " ".join(rng.choices(bags[k % 3], k=rng.randint(1, 40)))) for k in range(60)]
    return rows + [(3, "the of\tthe\n\x0bof"), (3, "the of\tthe\n\x0bof"), (None, "und der"), (None, None), (70, ""), (71, None), (72, " \t\n"), (73, "der die das " * 300), (74, "the " * 900), (75, "y" * 3000)]


def test_scores(spark, monkeypatch):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "z", "z", "z", "z") for r in rows], SCHEMA).repartition(3)
    want = plainly(rows, 3, 64, 3)
    assert near(scored(df, states=3, classes=64, rounds=3), want)
    monkeypatch.setattr(hm, "BLOCK_BYTES", 300)
    assert near(scored(df, states=3, classes=64, rounds=3), want)
    assert near(scored(df, states=1, classes=8, rounds=1), plainly(rows, 1, 8, 1))
    assert hm.score_texts(df.limit(0), states=2, classes=8).count() == 0
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0]
    only = spark.createDataFrame([(*r, "z", "z", "z", "z") for r in held], SCHEMA)
    assert held and near(scored(only, states=2, classes=16), plainly(held, 2, 16, 0))


def test_long_texts_by_transfer_matrices(monkeypatch):
    rng = np.random.default_rng(0)
    chain = hm.Chain(*(x / x.sum(-1, keepdims=True) for x in (rng.random(4), rng.random(4), rng.random((4, 4)))), rng.random((30, 4)))
    size = np.array([1, 700, 5, 2000, 130, 1, 131, 129, 128, 1000])
    seq = rng.integers(0, 30, size.sum())

    def plain(x):
        state, out = chain.start * chain.emission[x[0]], 0.0
        for t in range(1, len(x) + 1):
            out += math.log10(state.sum())
            state = state / state.sum()
            if t < len(x):
                state = (state @ chain.move) * chain.emission[x[t]]
        return out

    want = [plain(x) for x in np.split(seq, np.cumsum(size)[:-1])]
    assert np.allclose(hm.log_likelihoods(seq, size, chain), want, rtol=1e-12)
    monkeypatch.setattr(hm, "STEP_TOKENS", 300)
    assert np.allclose(hm.log_likelihoods(seq, size, chain), want, rtol=1e-12)
    assert len(hm.log_likelihoods(seq[:0], size[:0], chain)) == 0


def test_training_learns_on_held_out_texts(spark):
    rng = random.Random(9)
    bags = [[f"a{k}" for k in range(40)], [f"b{k}" for k in range(40)], [f"c{k}" for k in range(40)]]
    rows = [(k, " ".join(rng.choices(bags[k % 3], k=30))) for k in range(300)]
    got = hm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), states=4, classes=512).filter("held_out").collect()
    assert len(got) > 15 and sum(r.score > r.base_score + 5 for r in got) > 0.9 * len(got)
