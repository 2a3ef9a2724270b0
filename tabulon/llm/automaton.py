"""Merge vocabularies (byte-pair encodings) as a deterministic automaton that is determinised on demand.

A byte-pair encoding of a word is the only segmentation into vocabulary tokens in which every two neighbours would
also stay apart if they were encoded alone.  So one left-to-right pass suffices: an Aho-Corasick trie over the tokens
tells which tokens end at a position, and of these exactly one fits the best segmentation of the text before it.  What
the future can depend on is finite: the trie node, and for each of the last `depth` boundaries the token that ends
there and its token count relative to now.  These configurations are the states; a transition is computed once, is
annotated with the number of tokens it emits, and from then on is a table look-up that numpy does for many texts in
lockstep.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MOST_FITS = 300_000  # remembered pairs of neighbours; beyond this they are found anew


class MergeVocabulary:
    """Tokens as symbol tuples, and which neighbours merge in which order.

    symbols_of: token -> tuple of symbols.  pair_rank(a, b): order of the merge of tokens a and b, or None.
    """

    def __init__(self, symbols_of: dict[int, tuple[int, ...]], pair_rank):
        self.symbols_of = symbols_of
        self.pair_rank = pair_rank
        self.token_of = {s: t for t, s in symbols_of.items()}
        self._parts: dict[int, tuple[int, int, int] | None] = {}
        self.known_fits: dict[tuple[int, int], bool] = {}

    def merge(self, symbols: tuple[int, ...]) -> tuple[list[int], tuple[int, int, int] | None]:
        """Plain byte-pair merging of a short symbol string: the tokens, and the last merge (left, right, rank)."""
        seq = [self.token_of[(s,)] for s in symbols]
        last = None
        while len(seq) > 1:
            ranks = [(r, i) for i in range(len(seq) - 1) if (r := self.pair_rank(seq[i], seq[i + 1])) is not None]
            if not ranks:
                break
            rank, i = min(ranks)
            last = (seq[i], seq[i + 1], rank)
            seq[i : i + 2] = [self.token_of[self.symbols_of[seq[i]] + self.symbols_of[seq[i + 1]]]]
        return seq, last

    def parts(self, token: int) -> tuple[int, int, int] | None:
        """Left part, right part and rank of the merge that makes the token; rank -1 for a symbol, None if none does."""
        if token not in self._parts:
            symbols = self.symbols_of[token]
            if len(symbols) == 1:
                self._parts[token] = (token, token, -1)
            else:
                seq, last = self.merge(symbols)
                self._parts[token] = last if seq == [token] else None
        return self._parts[token]

    def fits(self, a: int, b: int) -> bool:
        """Do a and b stay apart side by side?  Undo their merges, latest first, and look for an earlier one across."""
        key = (a, b)
        if key not in self.known_fits:
            limit, verdict = None, True
            while True:
                across = self.pair_rank(a, b)
                if across is not None and (limit is None or across < limit):
                    verdict = False
                    break
                (_, right, rank_a), (left, _, rank_b) = self.parts(a), self.parts(b)
                if rank_a < 0 and rank_b < 0:
                    break
                if rank_a > rank_b:
                    limit, a = rank_a, right
                else:  # of equal merges the left one comes first, so the right one is undone first
                    limit, b = rank_b + 1, left
            self.known_fits[key] = verdict
        return self.known_fits[key]


class LazyTransducer:
    """States and transitions of a MergeVocabulary, made when first met.

    resets: symbols from this number on end a word; after them the state is START.
    max_states: the tables are emptied beyond this, in the midst of a run too, as lazy regular-expression automata do;
    the states that are still needed are numbered anew.
    """

    START = 0

    def __init__(self, vocabulary: MergeVocabulary, n_symbols: int, resets: int | None = None, max_states: int = 150_000):
        self.vocabulary, self.n_symbols, self.max_states = vocabulary, n_symbols, max_states
        self.resets = n_symbols if resets is None else resets
        self._build_trie()
        self._clear()

    def _build_trie(self) -> None:
        edge: dict[int, int] = {}
        n, depth, ends = self.n_symbols, [0], [-1]
        for token, symbols in self.vocabulary.symbols_of.items():
            node = 0
            for s in symbols:
                key = node * n + s
                nxt = edge.get(key)
                if nxt is None:
                    nxt = edge[key] = len(depth)
                    depth.append(depth[node] + 1)
                    ends.append(-1)
                node = nxt
            ends[node] = token
        fail, output = [0] * len(depth), [0] * len(depth)
        # keys were made parent first, and sorting by depth keeps every fail link's target ahead of its use
        for key, node in sorted(edge.items(), key=lambda kv: depth[kv[1]]):
            parent, s = divmod(key, n)
            if parent:
                f = fail[parent]
                while f and f * n + s not in edge:
                    f = fail[f]
                fail[node] = edge.get(f * n + s, 0)
            f = fail[node]
            output[node] = f if ends[f] >= 0 else output[f]
        self._edge, self._depth, self._ends, self._fail, self._output = edge, depth, ends, fail, output

    def _clear(self) -> None:
        self._states: list[tuple[int, tuple, tuple]] = [(0, (-1,), (0,))]
        self._number = {self._states[0]: 0}
        self._most = self.max_states
        self.last_token = np.full(1024, -1, np.int32)
        self._allocate(1 << 16)

    def _allocate(self, size: int) -> None:
        self._keys = np.full(size, -1, np.int64)
        self._next = np.zeros(size, np.int32)
        self._emit = np.zeros(size, np.int16)
        self._shift, self._mask, self._filled = np.uint64(64 - size.bit_length() + 1), size - 1, 0

    def tidy(self, *needed: np.ndarray) -> None:
        """Empty the tables if they are large; arrays of states that are still needed are changed to the new numbers."""
        if len(self.vocabulary.known_fits) > MOST_FITS:
            self.vocabulary.known_fits.clear()
        if len(self._states) <= self._most:
            return
        used = np.unique(np.concatenate([np.zeros(1, np.int32), *needed]))
        kept = [self._states[k] for k in used.tolist()]
        self._clear()
        numbers = np.array([self._register(c) for c in kept], np.int32)
        for states in needed:
            states[:] = numbers[np.searchsorted(used, states)]
        self._most = max(self.max_states, 2 * len(kept))

    def _register(self, config: tuple[int, tuple, tuple]) -> int:
        number = self._number.get(config)
        if number is None:
            number = self._number[config] = len(self._states)
            self._states.append(config)
            if number >= len(self.last_token):
                self.last_token = np.concatenate([self.last_token, np.full(len(self.last_token), -1, np.int32)])
            self.last_token[number] = config[1][0]
        return number

    def _goto(self, node: int, symbol: int) -> int:
        n, edge = self.n_symbols, self._edge
        while node and node * n + symbol not in edge:
            node = self._fail[node]
        return edge.get(node * n + symbol, 0)

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """Relax over the tokens that end here, longest first, along the output links."""
        node, tokens, counts = self._states[state]
        new = self._goto(node, symbol)
        parts, fits, symbols_of = self.vocabulary.parts, self.vocabulary.fits, self.vocabulary.symbols_of
        at = new if self._ends[new] >= 0 else self._output[new]
        while at:
            token = self._ends[at]
            before = tokens[len(symbols_of[token]) - 1]
            if parts(token) is not None and (before < 0 or fits(before, token)):
                break
            at = self._output[at]
        if not at:
            raise ValueError(f"no token ends with symbol {symbol}: every symbol must be a token")
        emitted = counts[len(symbols_of[token]) - 1] + 1
        if symbol >= self.resets:
            return self.START, emitted
        keep = self._depth[new]
        return self._register((new, (token, *tokens[:keep]), (0, *(c - emitted for c in counts[:keep])))), emitted

    def _insert(self, keys: np.ndarray, nxt: np.ndarray, emit: np.ndarray) -> None:
        if 2 * (self._filled + len(keys)) > self._mask:
            used = self._keys >= 0
            old = self._keys[used], self._next[used], self._emit[used]
            size = self._mask + 1
            while 4 * (self._filled + len(keys)) > size:
                size *= 2
            self._allocate(size)
            self._insert(*old)
        slot = ((keys.astype(np.uint64) * _GOLDEN) >> self._shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self._keys[s] < 0
            winners = todo[free]
            self._keys[slot[winners]] = keys[winners]  # of several at one slot the last one stays
            placed = self._keys[slot[todo]] == keys[todo]
            done = todo[placed]
            self._next[slot[done]], self._emit[slot[done]] = nxt[done], emit[done]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self._mask
        self._filled += len(keys)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and which keys have none."""
        slot = ((keys.astype(np.uint64) * _GOLDEN) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        odd = np.flatnonzero(found != keys)
        absent = [np.empty(0, np.int64)]
        while len(odd):
            empty = found[odd] < 0
            absent.append(odd[empty])
            odd = odd[~empty]
            slot[odd] = (slot[odd] + 1) & self._mask
            found[odd] = self._keys[slot[odd]]
            odd = odd[found[odd] != keys[odd]]
        return slot, np.concatenate(absent)

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One symbol for every lane: the new states and the emitted counts."""
        keys = states.astype(np.int64) * self.n_symbols + symbols
        slot, absent = self._find(keys)
        if len(absent):
            fresh = np.unique(keys[absent])
            made = [self._step(*divmod(k, self.n_symbols)) for k in fresh.tolist()]
            self._insert(fresh, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))
            slot, _ = self._find(keys)
        return self._next[slot], self._emit[slot]

    def run(self, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray, tokens: np.ndarray | None = None, needed: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Run over symbols[starts:ends] of every lane from its entry state: exit states and emitted counts.

        needed: further arrays of states that must stay valid if the tables are emptied on the way.
        tokens: if given, gets at each symbol's place the token that ends there in the best segmentation up to it.
        """
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        at, left = starts[order], length[order]
        state, count = entry[order].astype(np.int32), np.zeros(len(order), np.int64)
        if len(order):
            alive_at = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
            for step, alive in enumerate(alive_at.tolist()):
                self.tidy(state, *needed)
                new, emitted = self.advance(state[:alive], symbols[at[:alive] + step])
                state[:alive] = new
                count[:alive] += emitted
                if tokens is not None:
                    tokens[at[:alive] + step] = self.last_token[new]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]
