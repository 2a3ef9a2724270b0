"""Text functions: keys, titles, categories, negation-aware mentions, sentences, numbers, snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeezed(c: Column | str) -> Column:
    """White space shrunk to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def plain_key(c: Column | str) -> Column:
    """Lower case, ASCII letters and digits only, words one blank apart: a key for exact name matching."""
    return squeezed(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9 ]", " "))


FIRM_ENDINGS = ("inc", "llc", "llp", "corp", "co", "ltd", "plc", "company", "corporation", "incorporated", "limited")


def firm_key(c: Column | str) -> Column:
    """plain_key() with "and" for "&", a leading "the" and trailing legal forms left out."""
    key = plain_key(F.regexp_replace(F.lower(_col(c)), "&", " and "))
    key = F.regexp_replace(key, "^the ", "")
    return F.regexp_replace(key, rf"( ({'|'.join(FIRM_ENDINGS)}))+$", "")


def category(c: Column | str, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first pattern that is found in the text."""
    text, out = _col(c), None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(other) if out is None else out.otherwise(other)


def mentions(c: Column | str, pattern: str, negated: str = r"(?i)\b(no|not|without|never|denies|denied)\b[^.;]{0,40}?") -> Column:
    """Is the pattern found after negated mentions are taken out?"""
    return F.regexp_replace(_col(c), negated + f"(?:{pattern})", " ").rlike(pattern)


ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "No", "vs", "v", "Inc", "Co", "Corp", "Ltd", "St", "U.S", "e.g", "i.e")


def sentences(c: Column | str) -> Column:
    """Split after ., ! or ? and white space, but not after a known abbreviation or a single capital."""
    guard = "".join(rf"(?<!\b{a.replace('.', chr(92) + '.')}\.)" for a in ABBREVIATIONS)
    return F.filter(F.split(_col(c), rf"(?<=[.!?]){guard}(?<!\b[A-Z]\.)\s+"), lambda s: F.trim(s) != "")


def numbers(c: Column | str) -> Column:
    """All numbers of a text, thousands separators removed, scaled by a following thousand, million or billion."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(\d[\d,]*(?:\.\d+)?(?:\s*(?:thousand|million|billion))?)"), F.lit(1))

    def value(s: Column) -> Column:
        x = F.regexp_replace(F.regexp_extract(s, r"^[\d,.]+", 0), ",", "").try_cast("double")
        return x * F.when(s.endswith("thousand"), 1e3).when(s.endswith("million"), 1e6).when(s.endswith("billion"), 1e9).otherwise(1.0)

    return F.transform(found, value)


def window_around(c: Column | str, phrase: str, reach: int) -> Column:
    """The text around the first occurrence of a phrase, `reach` code points each way; null without one."""
    text = _col(c)
    at = F.instr(F.lower(text), phrase.lower())
    start = F.greatest(at - reach, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + len(phrase) + reach))


def short(c: Column | str, most: int) -> Column:
    """At most so many code points, cut at a blank and marked."""
    text = _col(c)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most - 1), r"\s+\S*$", ""), F.lit("…")))


def token_estimate(c: Column | str) -> Column:
    """About 3.4 characters a token, rounded up; a budgeting figure only."""
    return F.floor((F.length(_col(c)) * 10 + 33) / 34)


def without_tags(html: Column | str) -> Column:
    """Visible text of an HTML page: no scripts, styles, comments or tags; common entities decoded."""
    t = F.regexp_replace(_col(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return squeezed(t)


# fixed values: how docket entries announce a date, take one back, and lead up to what it is for
DATE_SETTING = r"(?i)\b(due\s+by|is\s+set\s+for|set\s+for|reset\s+for|continued\s+to)\s+(\d{1,2})/(\d{1,2})/(\d{4})\b(?:,?\s+(?:at\s+)?(\d{1,2}:\d{2}\s*(?:[AP]\.?\s?M\.?)?))?"
VACATED = r"(?i)^[\s,]*(?:(?:is|are|has\s+been|have\s+been|was|were)\s+)?(?:hereby\s+)?VACATED\b"
LEAD_IN = r"(?i)^(?:You\s+are\s+hereby\s+notified\s+that|It\s+is\s+(?:hereby\s+)?ordered\s+that|ORDERED\s+that|Please\s+take\s+notice\s+that|and|or|the|with)\s+"
CLAUSE_END = r"(?:[.;:]\s+|\)\s+|\n)"
LABEL_WORDS, SNIPPET_CHARS = 12, 200


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: inside a lambda Spark works an expression out again wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _label(clause: Column) -> Column:
    """What a date is for: the clause before it without lead-ins, its last words; null if nothing is left."""
    s = F.trim(F.regexp_replace(squeezed(clause), "[,;:]+$", ""))
    s = F.aggregate(F.sequence(F.lit(1), F.lit(4)), s, lambda acc, _: F.trim(F.regexp_replace(acc, LEAD_IN, "")))

    def last_words(words: Column) -> Column:
        return F.when(F.size(words) > LABEL_WORDS, F.concat(F.lit("… "), F.array_join(F.slice(words, -LABEL_WORDS, LABEL_WORDS), " "))).otherwise(F.array_join(words, " "))

    return _once(s, lambda s: F.when(s != "", _once(F.split(s, " "), last_words)))


def docket_dates(c: Column | str) -> Column:
    """array<struct<date, printed, phrase, label, time, vacated, snippet>>: the dates that a docket entry sets, in order.

    A date that directly goes on with "is vacated" is taken back, and only that one.  Its label is what its clause says
    before it; a further date in one clause is for the same thing.  Impossible days are left out.
    """

    def clause_of(text: Column) -> Column:
        return F.regexp_replace(text, f"(?s)^.*{CLAUSE_END}", "")

    def fact(p: Column, onward: Column) -> Column:
        """What a date's own match says: p is the match, its five groups, and the text up to the next one."""
        day = F.when(p[4].cast("int").between(1900, 2100), F.try_to_date(F.concat_ws("/", p[2], p[3], p[4]), "M/d/yyyy"))
        text = F.concat(p[0], p[6])
        return F.struct(day.alias("date"), F.concat_ws("/", p[2], p[3], p[4]).alias("printed"), F.regexp_replace(F.lower(p[1]), r"\s+", " ").alias("phrase"), F.nullif(squeezed(p[5]), F.lit("")).alias("time"), p[6].rlike(VACATED).alias("vacated"), text.alias("text"), text.rlike(CLAUSE_END).alias("ends"), onward.alias("onward"))

    def facts(parts: Column) -> Column:
        onward = lambda k: F.array_join(F.transform(F.slice(parts, k + 1, F.size(parts)), lambda q: F.concat(q[0], q[6])), "")
        return F.transform(parts, lambda p, k: fact(p, onward(k)))

    def step(acc: Column, f: Column) -> Column:
        real = f["date"].isNotNull()

        def told(label: Column) -> Column:
            snippet = F.substring(squeezed(F.regexp_replace(F.concat(acc["clause"], f["onward"]), r"(?s)\.\s+[A-Z(].*$", "")), 1, SNIPPET_CHARS)
            found = F.struct(f["date"].alias("date"), f["printed"].alias("printed"), f["phrase"].alias("phrase"), label.alias("label"), f["time"].alias("time"), f["vacated"].alias("vacated"), snippet.alias("snippet"))
            return F.struct(
                F.when(f["ends"], clause_of(f["text"])).otherwise(F.concat(acc["clause"], f["text"])).alias("clause"),
                (~f["ends"] & (real | acc["same"])).alias("same"),
                F.when(real, label).otherwise(acc["label"]).alias("label"),
                F.when(real, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"),
            )

        return _once(F.when(real & acc["same"], acc["label"]).when(real, _label(acc["clause"])), told)

    def dates(marked: Column) -> Column:
        none = F.array().cast("array<struct<date:date,printed:string,phrase:string,label:string,time:string,vacated:boolean,snippet:string>>")
        start = F.struct(clause_of(marked[0]).alias("clause"), F.lit(False).alias("same"), F.lit(None).cast("string").alias("label"), none.alias("out"))
        parts = F.transform(F.slice(marked, 2, F.size(marked)), lambda p: F.split(p, "\x02"))
        return F.aggregate(_once(parts, facts), start, step, lambda acc: acc["out"])

    groups = "".join(f"\x02${k}" for k in range(1, 6))
    marked = F.split(F.regexp_replace(F.regexp_replace(_col(c), "[\x01\x02]", ""), DATE_SETTING, f"\x01$0{groups}\x02"), "\x01")
    return _once(marked, lambda m: F.when(m.isNotNull(), dates(m)))


def backed_sentences(summary: Column | str, source: Column | str) -> Column:
    """The sentences of a summary whose numbers, scaled words included, all stand in the source."""
    known = numbers(source)
    return F.filter(sentences(summary), lambda s: F.size(F.array_except(numbers(s), known)) == 0)


#: what Python's str.isspace() holds for white space
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def cleaned(c: Column | str) -> Column:
    """A passage for embedding: heading marks and indents out, blanks shrunk, at most one blank line; line breaks stay."""
    s = F.regexp_replace(F.regexp_replace(_col(c), "[\x1e\x1f]", ""), "\n[\t ]+", "\n")
    s = F.regexp_replace(F.regexp_replace(F.translate(s, "\t", " "), " {2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+\z", "")


def snippet(c: Column | str, most: int = 280) -> Column:
    """The first words of a passage on one line, cut at a blank in the second half of the room, or where it ends, without
    a sign that leads on, and marked."""
    flat = F.trim(F.regexp_replace(cleaned(c), rf"{SPACE}+", " "))
    head = F.substring(flat, 1, most)
    cut = F.length(head) - F.instr(F.reverse(head), " ")
    n = F.when((F.instr(head, " ") > 0) & (cut > most // 2), cut).otherwise(most)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, F.lit(1), n), r"[ ,;:.\-]+\z", ""), F.lit("…")))


def embedding_text(heading: Column | str, body: Column | str) -> Column:
    """What is embedded: the heading path, a blank line, the cleaned passage."""
    h = F.coalesce(_col(heading), F.lit(""))
    return F.when(h != "", F.concat(h, F.lit("\n\n"), cleaned(body))).otherwise(cleaned(body))


def embedding_key(text: Column | str, model: str, kind: str = "document") -> Column:
    """The identity of one input of an embedding model."""
    return F.sha2(F.concat(F.lit(f"{model}\0{kind}\0"), _col(text)), 256)


# fixed values: what a maker's name, and a case's title, lose on a label
MAKER_ENDINGS = r"(?i),?\s+(?:Inc\.?|LLC|Corp\.?|Corporation|Company|Co\.|Ltd\.?|North America|USA|America)\b\.?"
TITLE_TAIL = r"(?is)\s*,?\s*(?:marketing,?\s*)?(?:(?:sales practices|sp),?\s*)?(?:&\s*|and\s*)?(?:products? liability|\bpl\b|antitrust|securities|data security breach|consumer privacy|privacy|litigation).*$"


def title_case(c: Column | str) -> Column:
    """Every run of a-z, digits and underscores with a capital; `and` stays small."""
    parts = F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9_]+|[^a-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.when((w == "and") | ~w.rlike("^[a-z]"), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), "")


def short_maker(c: Column | str) -> Column:
    """A maker's name without what is in parentheses and without corporate endings."""
    s = F.regexp_replace(F.regexp_replace(_col(c), r"\s*\(.*?\)\s*", " "), MAKER_ENDINGS, "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\s{2,}", " "), r"[,\s]+$", ""))


def short_title(c: Column | str) -> Column:
    """A case's title without `In re` and without what says only what kind of case it is; whole if nothing else is left."""
    s = F.regexp_replace(F.regexp_replace(_col(c), r"(?i)^\s*in re:?\s*", ""), TITLE_TAIL, "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, '["“”]', ""), r"[,\s]+$", ""))
    return F.when(s != "", s).otherwise(F.trim(_col(c)))
