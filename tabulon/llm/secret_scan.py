"""Secret scans: fixed patterns, and strings that tests find too random for an ordinary name.

Beside the patterns' matches, every run of 24 or more characters of the base64 alphabets with letters and digits in it
is a candidate; "=" ends a run, two at most are its padding.  What an assignment's span leaves of a run is a run of its
own.  Of a run that holds other patterns' spans the parts outside them are candidates if long enough, and so is the
whole run if a part is not.

A candidate's encoding is inferred (hexadecimal, base32, base36, alphanumeric, base64), and four tests measure how far
it is from independent, uniform characters of that alphabet: Pearson's chi-squared on the characters and on the kinds
of characters (digits, vowels, consonants, by case, signs), the number of runs of one kind, and the lag-1 serial
correlation.  Fisher's method combines them.  What is to be kept low is the share of ordinary strings among those
reported, so the null hypothesis is "ordinary": the same battery is run on made names of every style, and on names made
of each text's own words, one for each NULL_EVERY characters; their combined values, counted on a grid per encoding and
length class, give each candidate's p-value.  A weighted Benjamini-Hochberg step over all candidates of all texts then
reports spans of kind "random" at the false-discovery rate RATE; weights grow with the length class, for only long
strings give the tests power, and their mean is 1.  The step needs only counts on the grid.

Defined results: a null or empty text has no spans; a run that lies in patterns' spans has no span of kind random;
repeated rows are scanned alike and count as often in the step; an empty table gives no rows; further columns are
ignored.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.shared import SLICE_BYTES, slices, stored, text_of

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # of maximal runs only those that long stay
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
LEAST = 24
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS = 12, 18
#: encoding -> alphabet, smallest first
ALPHABETS = {
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "base64": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: length classes by their least length, and their weights before scaling to mean 1
CLASSES, WEIGHTS, RATE = (24, 32, 48, 96), (0.25, 0.5, 1.0, 2.0), 0.05
GRID, TOP = 20, 320  # combined p-values count as floor(GRID * -log10 p), TOP at most
NULL_EVERY, NULL_MADE, NULL_PRIOR = 4096, 12_000, 300
NAME_WORDS = 12  # words of a made name at most, drawn from all words of its NULL_EVERY characters
_ENCODINGS = tuple(ALPHABETS)
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"


def _kind_of(c: str) -> int:
    """0 digit, 1 and 2 small vowel and consonant, 3 and 4 capital ones, 5 sign."""
    if c.isdigit():
        return 0
    if not c.isalpha():
        return 5
    return (1 if c in _VOWELS else 2) if c.islower() else (3 if c.lower() in _VOWELS else 4)


@lru_cache(8)
def _alphabet(name: str) -> tuple[dict[str, int], np.ndarray, np.ndarray, int]:
    """Place of each letter, kind of each place, share of each kind, and how many letters a string draws from."""
    letters = ALPHABETS[name]
    size = 64 if name == "base64" else len(letters)  # both spellings of the last two signs are listed
    kinds = np.array([_kind_of(c) for c in letters])
    share = np.bincount(kinds, minlength=6).astype(np.float64)
    share[5] = size - share[:5].sum()
    return {c: k for k, c in enumerate(letters)}, kinds, share / size, size


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _upper_chi(chi2: float, cells: int, n: int) -> float:
    """About P(X >= chi2) for n draws into equal or unequal cells, by the statistic's mean and variance."""
    return 0.5 * math.erfc((chi2 - (cells - 1)) / math.sqrt(2 * (cells - 1) * (n - 1) / n) / math.sqrt(2))


def encoding_of(body: str) -> str | None:
    if not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
        return None
    own = set(body)
    return next((k for k, letters in ALPHABETS.items() if own <= set(letters)), None)


def battery(s: str) -> tuple[str, float] | None:
    """Encoding and combined p-value of a candidate under independent, uniform characters; None if no encoding fits."""
    body = s.rstrip("=")
    name = encoding_of(body)
    if name is None:
        return None
    place, kinds, share, size = _alphabet(name)
    n = len(body)
    x = np.array([place[c] for c in body])
    counts = np.bincount(x, minlength=len(place))
    chi2 = float(((counts - n / size) ** 2).sum() * size / n) - (len(place) - size) * n / size
    kind = kinds[x]
    used = share > 0
    expected = n * share[used]
    by_kind = float(((np.bincount(kind, minlength=6)[used] - expected) ** 2 / expected).sum())
    p2, p3 = float((share**2).sum()), float((share**3).sum())
    stays = int((kind[1:] == kind[:-1]).sum())
    spread = (n - 1) * (p2 - p2 * p2) + 2 * (n - 2) * (p3 - p2 * p2)
    dev = x - x.mean()
    square = float((dev * dev).sum())
    tests = (
        _upper_chi(chi2, size, n),
        _upper_chi(by_kind, int(used.sum()), n),
        _two_sided((stays - (n - 1) * p2) / math.sqrt(max(spread, 1e-9))),
        _two_sided(float((dev[1:] * dev[:-1]).sum()) / square * math.sqrt(n)) if square else 0.0,
    )
    half = -sum(math.log(max(p, 1e-300)) for p in tests)
    return name, min(1.0, math.exp(-half) * sum(half**k / math.factorial(k) for k in range(len(tests)))) if half < 700 else 0.0


STYLES = ("{0}_{1}", "{0}-{1}", "{0}{1}", "{0}/{1}", "Camel", "UPPER")


def named(words: list[str], numbers: list[int], style: int, length: int) -> str:
    """A name of at least `length` characters, made of words and numbers in one of the STYLES."""
    sign = ("_", "-", "", "/", "", "_")[style % len(STYLES)]
    parts, at, total = [], 0, 0
    while total < length:
        w = words[at % len(words)]
        parts.append(w.capitalize() if style % len(STYLES) == 4 and parts else w.upper() if style % len(STYLES) == 5 else w.lower())
        if at % 2 or at == 0:
            parts.append(str(numbers[at % len(numbers)]))
        at += 1
        total = len(sign.join(parts))
    return sign.join(parts)


def _syllables(dice: random.Random) -> str:
    return "".join(dice.choice(_CONSONANTS) + dice.choice(_VOWELS) + (dice.choice("nrstlm") if dice.random() < 0.3 else "") for _ in range(dice.randint(1, 4)))


@lru_cache(1)
def made_names(count: int = NULL_MADE, seed: int = 11) -> Counter:
    """(encoding, length class, bin) -> n of ordinary strings: names in all styles, dates, codes of digits and few letters."""
    dice, out = random.Random(seed), Counter()
    for k in range(count):
        length = CLASSES[k % len(CLASSES)] + dice.randint(0, 14)
        if k % 10 == 9:  # codes: digits in groups, few letters
            letters = ("abcdef", "ABCDEF", "ABCXYZ")[k // 10 % 3]
            s = "".join(str(dice.randint(1900, 2099)) + f"{dice.randint(1, 12):02}" + (dice.choice(letters) if dice.random() < 0.5 else "") for _ in range(length // 6 + 1)) + letters[0]
        else:
            s = named([_syllables(dice) for _ in range(8)], [dice.choice((dice.randint(0, 99), dice.randint(1900, 2099))) for _ in range(4)], k, length)
        found = battery(s)
        if found:
            out[found[0], length_class(len(s)), grid_bin(found[1])] += 1
    return out


_WORD = re.compile(r"[A-Za-z]{2,}")


def names_of(text: str) -> list[tuple[int, int, int]]:
    """(encoding, length class, bin) of names made of a text's own words, one for each NULL_EVERY characters begun."""
    out = []
    for k, lo in enumerate(range(0, len(text), NULL_EVERY)):
        words = [w for w in _WORD.findall(text, lo, lo + NULL_EVERY) if len(w) < LEAST]
        words = words[:: -(-len(words) // NAME_WORDS)] if words else words  # evenly from the whole of them
        if len(words) > 3:
            turn = len(text) + k
            s = named(words, [turn % 97, 1900 + turn % 190, turn % 7], turn, CLASSES[turn % len(CLASSES)])
            found = battery(s)
            if found:
                out.append((_ENCODINGS.index(found[0]), length_class(len(s)), grid_bin(found[1])))
    return out


def grid_bin(p: float) -> int:
    return min(TOP, int(GRID * -math.log10(max(p, 1e-300))))


def length_class(n: int) -> int:
    return sum(n >= c for c in CLASSES) - 1


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the spans, in order, overlapping ones together."""
    begins, ends = [], []
    for lo, _, hi in spans:
        if ends and lo <= ends[-1]:
            ends[-1] = max(ends[-1], hi)
        else:
            begins.append(lo)
            ends.append(hi)
    return begins, ends


def _outside(merged: tuple[list[int], list[int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """The parts of lo ... hi outside the merged spans."""
    begins, ends = merged
    out = []
    for k in range(bisect_right(ends, lo), len(begins)):
        if begins[k] >= hi:
            break
        if begins[k] > lo:
            out.append((lo, begins[k]))
        lo = ends[k]
    return [*out, (lo, hi)] if lo < hi else out


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Pattern spans (start, kind, end), and candidates (start, end, encoding, length class, bin)."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    assigned, inner = _merged([x for x in base if x[1] == 0]), _merged([x for x in base if x[1] > 0])
    more = []
    for m in CANDIDATE.finditer(text):
        for run in _outside(assigned, *m.span()):
            parts = _outside(inner, *run)
            tested = [x for x in parts if x[1] - x[0] >= LEAST]
            if len(tested) < len(parts):
                tested.append(run)
            for lo, hi in tested:
                if hi - lo >= LEAST and (found := battery(text[lo:hi])):
                    more.append((lo, hi, _ENCODINGS.index(found[0]), length_class(hi - lo), grid_bin(found[1])))
    return base, more


def p_values(null: Counter) -> dict[tuple[str, int], np.ndarray]:
    """(encoding, length class) -> p-value of each bin: the share of ordinary strings that look as random or more.

    A stratum's counts are joined by NULL_PRIOR strings spread as all encodings' strings of that length class are.
    """
    out = {}
    for c in range(len(CLASSES)):
        own = {e: np.zeros(TOP + 1) for e in _ENCODINGS}
        for (e, cls, b), n in null.items():
            if cls == c:
                own[e][b] += n
        pooled = sum(own.values())
        pooled = pooled / max(pooled.sum(), 1.0)
        for e in _ENCODINGS:
            seen = own[e] + NULL_PRIOR * pooled
            out[e, c] = np.minimum((1 + np.cumsum(seen)) / (1 + own[e].sum() + NULL_PRIOR * pooled.sum()), 1.0)
    return out


def reported_up_to(counts: dict[tuple[str, int, int], int], null: Counter, rate: float = RATE) -> dict[tuple[str, int], int]:
    """Per encoding and length class the last bin whose candidates are reported, -1 for none: a weighted step-up.

    counts: (encoding, length class, bin) -> candidates.
    """
    total = sum(counts.values())
    if not total:
        return {}
    p = p_values(null)
    scale = sum(n * WEIGHTS[c] for (_, c, _), n in counts.items()) / total
    ranked = sorted((p[e, c][b] * scale / WEIGHTS[c], n) for (e, c, b), n in counts.items())
    seen, limit = 0, -1.0
    for k, (q, n) in enumerate(ranked):
        seen += n
        if (k + 1 == len(ranked) or ranked[k + 1][0] > q) and q <= rate * seen / total:
            limit = q
    return {(e, c): int((p[e, c] * scale / WEIGHTS[c] <= limit).sum()) - 1 for e, c in p}


_SPAN = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])
_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("enc", pa.int32()), ("cls", pa.int32()), ("bin", pa.int32())])
_NULL = pa.struct([("enc", pa.int32()), ("cls", pa.int32()), ("bin", pa.int32())])


def _listed(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    return pa.array([[dict(zip(kind.names, x, strict=True)) for x in r] for r in rows], pa.list_(kind))


def _scan(batches):
    """doc_id, text -> doc_id, base, more, ordinary; some texts at a time."""
    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices(np.asarray(pc.binary_length(texts)).astype(np.int64), SLICE_BYTES):
            own = texts.slice(lo, hi - lo).to_pylist()
            base, more = zip(*map(scan_text, own), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), _listed(base, _SPAN), _listed(more, _CANDIDATE), _listed(list(map(names_of, own)), _NULL)], names=["doc_id", "base", "more", "ordinary"])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """(doc_id, base, spans) per row: arrays of (start, rank, end) by start and kind; rank is the kind's place in KINDS.

    keep_row: a further column `row` holds the whole row of df.
    """
    kept = df if keep_row else df.select(F.col(id_col), F.col(text_col))
    rows, at = kept.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row")), kept.columns.index(text_col)

    def scan(batches):
        for batch in batches:
            row, done = batch.column("row"), 0
            for found in _scan([pa.RecordBatch.from_arrays([batch.column("doc_id"), text_of(row, at)], names=["doc_id", "text"])]):
                own = [row.slice(done, found.num_rows)] if keep_row else []
                done += found.num_rows
                yield pa.RecordBatch.from_arrays([*found.columns, *own], names=[*found.schema.names, *(["row"] if keep_row else [])])

    ddl = "base array<struct<start:int,rank:int,end:int>>, more array<struct<start:int,end:int,enc:int,cls:int,bin:int>>, ordinary array<struct<enc:int,cls:int,bin:int>>"
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(ddl).fields, *([rows.schema["row"]] if keep_row else [])])
    found = stored(rows.mapInArrow(scan, schema), "secrets")
    grid = found.select(F.explode(F.concat(F.transform("more", lambda m: F.struct(F.lit(0).alias("ordinary"), m["enc"], m["cls"], m["bin"])), F.transform("ordinary", lambda m: F.struct(F.lit(1).alias("ordinary"), m["enc"], m["cls"], m["bin"])))).alias("g"))
    grid = grid.groupBy("g.ordinary", "g.enc", "g.cls", "g.bin").count().collect()  # at most 2 * encodings * length classes * bins rows
    counts = {(_ENCODINGS[r["enc"]], r["cls"], r["bin"]): r["count"] for r in grid if not r["ordinary"]}
    limits = reported_up_to(counts, made_names() + Counter({(_ENCODINGS[r["enc"]], r["cls"], r["bin"]): r["count"] for r in grid if r["ordinary"]})) if counts else {}
    last = F.array(*[F.lit(limits.get((e, c), -1)) for e in _ENCODINGS for c in range(len(CLASSES))])
    random_spans = F.transform(F.filter("more", lambda m: m["bin"] <= F.get(last, m["enc"] * len(CLASSES) + m["cls"])), lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("rank"), m["end"].alias("end")))
    out = found.withColumn("spans", F.sort_array(F.concat("base", random_spans)))
    return out.select("doc_id", "base", "spans", *(["row"] if keep_row else []))


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by the mark."""
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(F.concat(acc["out"], gap, F.lit(mark)).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
