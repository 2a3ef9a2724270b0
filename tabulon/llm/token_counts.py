"""Token counts by a compiled tokenizer: one deterministic transducer, chunk state maps, parallel prefix composition.

The tokenizer file (tokenizers library, byte-pair encoding with word ends) is compiled to a transducer over bytes whose
transitions carry the number of tokens that they emit.  A text is cut into chunks of fixed length.  A chunk's state map
says, for any state at its entry, the state at its exit and the tokens emitted between: after the first word end the
entry does not matter, so a map is a short head to be replayed from the entry state, and a fixed tail.  Maps compose
associatively, so the chunks of all texts of a batch are run side by side and then composed pairwise, level by level.

Defined results: a null or empty text has no bytes and no tokens; the order and repetition of rows, and further columns,
do not matter.  Texts are neither cut nor padded, no begin, end or other special tokens are added, and special strings
inside a text count as one token each, as the library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tabulon.llm.automaton import LazyTransducer, MergeVocabulary
from tabulon.llm.shared import SLICE_BYTES, documents_of, slices

WORD_END = 256  # added to the last byte of a word
CHUNK = 768
# fixed values: what Unicode calls white space, and the endings that the tokenizer's pattern splits off
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
# fixed values: letters and numbers that Unicode 16.0, which the library follows, has beyond Python's tables (first, last),
# and the small forms of the new capitals
NEW_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEW_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
_NEW_CAPITAL = re.compile("[" + "".join(map(chr, NEW_SMALL)) + "]")
# fixed values: marks that combine in Python's tables but not yet in those by which the library composes (first, last), and
# the two signs of the one composition that it does not know
NEWER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C),
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42),
    (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF), (0x11930, 0x11930), (0x11938, 0x11938),
)
_NEWER_MARK = re.compile("([" + "".join(f"{chr(a)}-{chr(z)}" for a, z in NEWER_MARKS) + "])")


def composed(text: str) -> str:
    """Canonical composition as the library does it: marks newer than its tables are ordinary characters to it, which stay
    where they are and part what stands around them."""
    return "".join(unicodedata.normalize("NFC", x) for x in _NEWER_MARK.split(text))


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 anything else, by code point."""
    kind = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            kind[c] = 1 if major == "L" else 2
    for ranges, k in ((NEW_LETTERS, 1), (NEW_NUMBERS, 2)):
        for first, last in ranges:
            kind[first : last + 1] = k
    kind[WHITE] = 0
    return kind


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins for bytes that byte-level vocabularies use: printable Latin-1 itself, the rest from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenCounter:
    """The compiled tokenizer of one worker."""

    def __init__(self, spec: str):
        t = json.loads(spec)
        model, byte_of = t["model"], _byte_of_char()
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix:
            raise ValueError("a byte-level BPE file with an end-of-word suffix is expected")
        self.specials = [a["content"] for a in t["added_tokens"]]
        # leftmost, of those that begin at one place the longest; without any, a pattern that never matches
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")

        def symbols(token: str) -> tuple[int, ...]:
            ended = token.endswith(suffix) and token != suffix
            out = [byte_of[c] for c in (token[: -len(suffix)] if ended else token)]
            return (*out[:-1], out[-1] + WORD_END) if ended else tuple(out)

        vocab = {x: i for x, i in model["vocab"].items() if x not in self.specials}
        ranks: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault((vocab[a], vocab[b]), rank)
        vocabulary = MergeVocabulary({i: symbols(x) for x, i in vocab.items()}, lambda a, b: ranks.get((a, b)))
        self.machine = LazyTransducer(vocabulary, 2 * WORD_END, resets=WORD_END)

    def _stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts without white space, word ends marked, and where each text's symbols end."""
        clean = []
        for s in texts:
            if not s.isascii():
                s = composed(s).replace("Σ", "σ")  # noqa: PLW2901  the library lowers sigma without context
                if _NEW_CAPITAL.search(s):
                    s = s.translate(NEW_SMALL)  # noqa: PLW2901
            clean.append(s.lower())
        joined = "\n".join([*clean, ""])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _classes()[cp]
        before = np.concatenate([[np.uint8(0)], kind[:-1]])
        start = (kind != 0) & ((kind != before) | (kind == 2))
        quotes = np.flatnonzero((cp == 0x27) & start)
        if len(quotes):
            ahead = np.minimum(quotes[:, None] + np.arange(1, 4), len(cp) - 1)
            c1, c2 = cp[ahead[:, 0]], cp[ahead[:, 1]]
            for ending in ENDINGS:
                hit = c1 == ord(ending[0])
                if len(ending) > 1:
                    hit &= c2 == ord(ending[1])
                at = quotes[hit]
                start[at + 1] = False
                after = np.minimum(at + 1 + len(ending), len(cp) - 1)
                start[after] |= kind[after] == 1
        last = (kind != 0) & np.concatenate([start[1:] | (kind[1:] == 0), [True]])
        raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
        if len(raw) == len(cp):
            symbols = raw.astype(np.int64)
            symbols[last] += WORD_END
            kept = kind != 0
        else:
            width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
            symbols = raw.astype(np.int64)
            symbols[np.cumsum(width)[last] - 1] += WORD_END
            kept = np.repeat(kind != 0, width)
        sizes = np.array([len(s.encode()) + 1 for s in clean], np.int64)
        ends = np.cumsum(kept)[np.cumsum(sizes) - 1] if len(sizes) else sizes
        return symbols[kept], ends

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        cut = [self.special.subn("\n", s) for s in texts]
        plain, extra = [s for s, _ in cut], np.array([n for _, n in cut], np.int64)
        symbols, ends = self._stream(plain)
        self.machine.tidy()
        return extra + self._compose(symbols, ends)

    def _compose(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        machine, begins = self.machine, np.concatenate([[0], ends[:-1]]).astype(np.int64)
        per_text = np.maximum(1, -(-(ends - begins) // CHUNK))
        owner = np.repeat(np.arange(len(ends)), per_text)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        lo = begins[owner] + nth * CHUNK
        hi = np.minimum(lo + CHUNK, ends[owner])
        resets = np.flatnonzero(symbols >= WORD_END)
        first = np.searchsorted(resets, lo)
        reset = np.append(resets, len(symbols))[first] + 1
        fixed = (reset <= hi) | (nth == 0)  # from here on the entry state does not matter; a text's entry is START
        head_lo, head_hi = lo.copy(), np.where(nth == 0, lo, np.minimum(reset, hi))
        start_states = np.full(len(lo), machine.START, np.int32)
        exit_state, count = machine.run(symbols, head_hi, np.where(fixed, hi, head_hi), start_states)
        while len(owner) > len(ends):
            left = np.flatnonzero((nth % 2 == 0) & np.append(owner[1:] == owner[:-1], False))
            right = left + 1
            whole = fixed[left]  # else the left map is all head, and the right one's head continues it
            a, b = left[whole], right[whole]
            state, emitted = machine.run(symbols, head_lo[b], head_hi[b], exit_state[a], needed=(exit_state,))
            exit_state[a] = np.where(fixed[b], exit_state[b], state)
            count[a] += emitted + count[b]
            a, b = left[~whole], right[~whole]
            head_hi[a], fixed[a], exit_state[a], count[a] = head_hi[b], fixed[b], exit_state[b], count[b]
            stay = np.ones(len(owner), bool)
            stay[right] = False
            owner, nth, head_lo, head_hi, fixed, exit_state, count = (x[stay] for x in (owner, nth // 2, head_lo, head_hi, fixed, exit_state, count))
        return count


@lru_cache(2)
def _counter(spec: str) -> TokenCounter:
    return TokenCounter(spec)


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text; tokenizer_path is read on the driver."""
    spark: SparkSession = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the data

    def count(batches):
        counter = _counter(spec.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)).astype(np.int64) if pa.types.is_string(texts.type) else np.array([len(x.encode()) for x in texts.to_pylist()], np.int64)
            for lo, hi in slices(sizes, SLICE_BYTES):
                n = counter.counts(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes[lo:hi], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = documents_of(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
