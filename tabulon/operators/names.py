"""Personal names: parts, suffixes, and a crosswalk that lets initials stand for middle names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what stands before and after names, and how suffixes are spelled
BEFORE = ("hon", "honorable", "judge", "justice", "magistrate", "mr", "mrs", "ms", "dr")
AFTER = ("esq", "phd", "md", "ret")
SUFFIXES = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "2nd": "ii", "iii": "iii", "3rd": "iii", "iv": "iv", "4th": "iv"}


def name_parts(name: Column | str) -> Column:
    """struct(first, middle array, last, suffix array) of a written name; all null without two parts."""
    text = F.col(name) if isinstance(name, str) else name
    plain = F.regexp_replace(F.translate(F.lower(text), "áàâäãåéèêëíìîïóòôöõúùûüñç'’", "aaaaaaeeeeiiiiooooouuuunc"), r"[^a-z0-9]+", " ")
    plain = F.regexp_replace(F.trim(plain), rf"^(?:(?:{'|'.join(BEFORE)}) )+", "")
    plain = F.regexp_replace(plain, rf"(?: (?:{'|'.join(AFTER)}))+$", "")
    words = F.filter(F.split(plain, " "), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    later = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    suffix = F.array_sort(F.array_distinct(F.transform(F.filter(later, lambda w: F.map_contains_key(known, w)), lambda w: F.try_element_at(known, w))))
    rest = F.concat(F.slice(words, F.lit(1), F.lit(1)), F.filter(later, lambda w: ~F.map_contains_key(known, w)))
    n = F.size(rest)
    return F.when(n >= 2, F.struct(F.get(rest, F.lit(0)).alias("first"), F.slice(rest, F.lit(2), F.greatest(n - 2, F.lit(0))).alias("middle"), F.get(rest, n - 1).alias("last"), suffix.alias("suffix")))


def compatible_middles(a: Column, b: Column) -> Column:
    """Either side has none, or as many of each and every two are equal or one is the other's initial."""
    def fit(p: Column) -> Column:
        return (p["x"] == p["y"]) | ((F.length(p["x"]) == 1) & F.startswith(p["y"], p["x"])) | ((F.length(p["y"]) == 1) & F.startswith(p["x"], p["y"]))

    pairs = F.arrays_zip(a.alias("x"), b.alias("y"))
    return (F.size(a) == 0) | (F.size(b) == 0) | ((F.size(a) == F.size(b)) & F.forall(pairs, fit))


def crosswalk(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str) -> DataFrame:
    """(left_id, right_id, candidates, state): persons with one first and last name, equal suffixes and compatible middles.

    state: matched for exactly one candidate, else ambiguous (right_id null) or unmatched.  The join is on first and last
    name; what is not decided by these is a filter, and candidates are counted per left row before anything is kept.
    """
    a = left.select(F.col(left_id).alias("l"), name_parts(name).alias("p"))
    b = right.select(F.col(right_id).alias("r"), name_parts(name).alias("q"))
    a, b = a.select("l", "p", F.col("p.first").alias("f"), F.col("p.last").alias("z")), b.select("r", "q", F.col("q.first").alias("f"), F.col("q.last").alias("z"))
    met = a.join(b, ["f", "z"]).filter((F.col("p.suffix") == F.col("q.suffix")) & compatible_middles(F.col("p.middle"), F.col("q.middle")))
    one = met.groupBy("l").agg(F.countDistinct("r").alias("n"), F.min("r").alias("r"))
    out = a.select("l").join(one, "l", "left")
    state = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("matched")
    return out.select(F.col("l").alias(left_id), F.when(F.col("n") == 1, F.col("r")).alias(right_id), F.coalesce("n", F.lit(0)).alias("candidates"), state.alias("state"))
