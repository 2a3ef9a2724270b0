"""Legal citations in texts: where they stand, what they cite, short forms and their antecedents, and links to authorities."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: reporters of decisions, and how states are abbreviated before their codes
REPORTERS = (
    "U.S.", "S. Ct.", "L. Ed.", "L. Ed. 2d", "F.", "F.2d", "F.3d", "F.4th", "F. App'x", "F. Supp.", "F. Supp. 2d", "F. Supp. 3d", "F.R.D.", "B.R.", "Fed. Cl.", "T.C.", "M.J.", "Vet. App.",
    "A.2d", "A.3d", "N.E.2d", "N.E.3d", "N.W.2d", "P.2d", "P.3d", "S.E.2d", "So. 2d", "So. 3d", "S.W.2d", "S.W.3d", "Cal. Rptr.", "Cal. Rptr. 2d", "Cal. Rptr. 3d", "Cal. 4th", "Cal. App. 4th", "N.Y.S.2d", "N.Y.S.3d", "Ill. 2d", "Wash. 2d",
)
STATES = ("Ala.", "Alaska", "Ariz.", "Ark.", "Cal.", "Colo.", "Conn.", "Del.", "D.C.", "Fla.", "Ga.", "Haw.", "Idaho", "Ill.", "Ind.", "Iowa", "Kan.", "Ky.", "La.", "Me.", "Md.", "Mass.", "Mich.", "Minn.", "Miss.", "Mo.", "Mont.", "Neb.", "Nev.", "N.H.", "N.J.", "N.M.", "N.Y.", "N.C.", "N.D.", "Ohio", "Okla.", "Or.", "Pa.", "R.I.", "S.C.", "S.D.", "Tenn.", "Tex.", "Utah", "Vt.", "Va.", "Wash.", "W. Va.", "Wis.", "Wyo.")
BLANK = r"\s?"


def letters_of(spelling: str) -> tuple[str, ...]:
    """A spelling letter by letter as patterns; blanks, and the ends of full stops, may have one blank or none."""
    parts = [p for chunk in spelling.split() for p in re.findall(r"[^.]*\.|[^.]+", chunk)]
    return tuple(x for k, p in enumerate(parts) for x in ([BLANK] if k else []) + ["['’]" if c in "'’" else re.escape(c) for c in p])


def trie_pattern(spellings: Iterable[str]) -> str:
    """One pattern for all spellings, the longest that fits: letters that several begin with are looked at once."""

    def below(rows: list[tuple[str, ...]]) -> str:
        onward = [(first, below([r[1:] for r in own])) for first, own in ((f, list(g)) for f, g in groupby((r for r in rows if r), key=itemgetter(0)))]
        if not onward:
            return ""
        # a blank that may be missing comes last, so that it does not keep others from trying without it
        either = "|".join(first + rest for first, rest in sorted(onward, key=lambda x: x[0] == BLANK))
        return f"(?:{either})?" if () in rows else f"(?:{either})" if len(onward) > 1 else either

    return below(sorted({letters_of(s) for s in spellings}))


_REPORTER, _STATE, _SECTION = trie_pattern(REPORTERS), trie_pattern(STATES), r"§+\s*"
#: a citation has a digit, but for short forms and constitutions; texts with none of these are not sent to Python
ANCHOR = r"\p{Nd}|[Ii]d\.|Const\."
#: kind -> pattern; its groups, in order, make the key.  Of kinds that match at one place the first counts.
KINDS = {
    "usc": r"(\d{1,2})\s+U\.?\s?S\.?\s?C\.?\s+(?:§+\s*)?(\d+[a-z]*(?:-\d+[a-z]*)?)",
    "cfr": r"(\d{1,2})\s+C\.?\s?F\.?\s?R\.?\s+(?:§+\s*|[Pp]art\s+)?(\d+(?:\.\d+)?)",
    "federal_register": r"(\d{1,3})\s+Fed\.?\s?Reg\.?\s+(\d{1,3}(?:,\d{3})+|\d+)",
    "statutes_at_large": r"(\d{1,3})\s+Stat\.\s+(\d{1,5})",
    "public_law": r"Pub(?:lic|\.)\s+L(?:aw|\.)\s+(?:No\.\s+)?(\d{2,3})[-–](\d{1,4})",
    "constitution_us": r"U\.\s?S\.\s+Const\.\s+(art|amend)\.\s+([IVXLC]+)",
    "constitution_state": rf"({_STATE})\s+Const\.\s+(?:art\.)\s+([IVXLC]+|\d+)",
    "federal_rule": r"Fed\.\s?R\.\s?(Civ|Crim|App|Evid|Bankr)\.\s?(?:P\.\s+)?\s*(\d+)",
    "local_rule": r"(?:L\.\s?R\.|Local\s+(?:Civil\s+)?Rule)\s+(\d+(?:[.\-]\d+)*)",
    "state_regulation": rf"({_STATE})\s+(?:Code\s+Regs\.|Admin\.\s+Code|Comp\.\s+R\.\s+&\s+Regs\.)(?:\s+tit\.\s+\d+,)?\s*(?:{_SECTION}|r\.\s+)?(\d[\w.:\-]*\w)",
    "state_statute": rf"({_STATE})\s+(?:[A-Z][\w&.]*\s+){{0,4}}?(?:Code|Stat\.|Laws?)(?:\s+Ann\.)?[^§\d]{{0,20}}{_SECTION}(\d[\w.:\-]*\w|\d)",
    "mdl": r"M\.?D\.?L\.?\s+(?:No\.\s+|Docket\s+No\.\s+)?(\d{3,4})\b",
    "docket": r"(?:No\.\s+)?(\d{1,2}:\d{2}-(?:cv|cr|md|mc|bk)-\d{3,6})",
    "short_case": rf"(\d{{1,4}})\s+({_REPORTER})\s+at\s+\d+",
    "case": rf"(\d{{1,4}})\s+({_REPORTER})\s+(\d+)",
    "short": r"\b[Ii]d\.(?:\s+(?:at\s+\d+|§\s*\d+))?",
}
#: no kind begins with another letter than these, which spares trying them all at each word
_EVERY = re.compile(r"(?<![\w.])(?=[\dA-Zi])(?:" + "|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()) + ")")
#: where the groups of a kind's own pattern stand in _EVERY
_PARTS = {k: tuple(range(_EVERY.groupindex[k] + 1, _EVERY.groupindex[k] + 1 + re.compile(p).groups)) for k, p in KINDS.items()}
FOUND_ROWS = 20_000  # citations that a task hands on at once


def _plain(part: str) -> str:
    return re.sub(r"[\s.,]", "", part).lower() if not part[:1].isdigit() else part.replace(",", "").lower()


def citations_in(text: str) -> list[tuple[str, str | None, int, int]]:
    """(kind, key, start, end) in order; a short form has its antecedent's key, or none.

    Id. takes up the citation before it, whatever its kind; volume and reporter "at" a page the last decision with them.
    """
    out: list[tuple[str, str | None, int, int]] = []
    cases: dict[str, str] = {}
    last: str | None = None
    for m in _EVERY.finditer(text):
        kind = m.lastgroup
        parts = [_plain(m[g]) for g in _PARTS[kind] if m[g]]
        if kind == "short":
            key = last
        elif kind == "short_case":
            kind, key = "short", cases.get(":".join(parts))
        else:
            key = ":".join([kind, *parts])
            if kind == "case":
                cases[":".join(parts[:2])] = key
        last = key or last
        out.append((kind, key, m.start(), m.end()))
    return out


def located(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind, key, start, end): every citation of every whole text; code points, end exclusive."""
    def find(batches):
        def rows(batch, at, found):
            kind, key, start, end = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(kind), pa.array(key, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["id", "kind", "key", "start", "end"])

        for batch in batches:
            at, found = [], []
            for k, s in enumerate(batch.column(1).to_pylist()):
                own = citations_in(s)
                found += own
                at += [k] * len(own)
                if len(found) >= FOUND_ROWS:
                    yield rows(batch, at, found)
                    at, found = [], []
            if found:
                yield rows(batch, at, found)

    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL("kind string, key string, start int, end int").fields])
    # a table of short rows is one small file, which would be one task: the texts are dealt out first
    texts = df.filter(F.col(text).rlike(ANCHOR)).select(id_col, text).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col, text)
    return texts.mapInArrow(find, schema)


def citations(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, kind, key, n): how often each text cites each authority; short forms count for their antecedent's kind."""
    found = located(df, id_col, text).filter("key is not null")
    return found.groupBy("id", F.substring_index("key", ":", 1).alias("kind"), "key").agg(F.count("*").alias("n"))


def resolved(cited: DataFrame, authorities: DataFrame) -> DataFrame:
    """(id, key, n, target, state): cited (id, key, n) linked to authorities (key, target) by exact key.

    resolved: one target; ambiguous: several, none is taken; pending: none yet.
    """
    known = authorities.filter("key is not null and target is not null").groupBy("key").agg(F.min("target").alias("_t"), F.max("target").alias("_z"))
    one = F.col("_t") == F.col("_z")
    state = F.when(F.col("_t").isNull(), "pending").when(one, "resolved").otherwise("ambiguous")
    return cited.join(known, "key", "left").select("id", "key", "n", F.when(one, F.col("_t")).alias("target"), state.alias("state"))


def rules_of_sections(rules: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, rule_id, matched_by): rules (rule_id, jurisdiction, pinpoint, captured array of section ids) of the
    sections (section_id, jurisdiction, key) that they cite exactly, or whose text they were checked against."""
    cites = located(rules, "rule_id", "pinpoint").filter("key is not null").select(F.col("id").alias("rule_id"), "key").distinct()
    by_key = cites.join(rules.select("rule_id", "jurisdiction"), "rule_id").join(sections, ["jurisdiction", "key"]).select("section_id", "rule_id", F.lit("citation").alias("how"))
    held = rules.select("rule_id", "jurisdiction", F.explode("captured").alias("section_id")).join(sections.select("section_id", "jurisdiction"), ["section_id", "jurisdiction"])
    both = by_key.unionByName(held.select("section_id", "rule_id", F.lit("captured_text").alias("how")))
    return both.groupBy("section_id", "rule_id").agg(F.array_sort(F.collect_set("how")).alias("matched_by"))


AUTHORITY_FORMS = ("appendix", "note", "et seq", "range", "exact")


def authority_lines(df: DataFrame, id_col: str, line: str) -> DataFrame:
    """(id, title, section, form, last): each U.S. Code section that an authority line names.

    A clause names a title and, after commas or "and", sections.  form: exact, et seq, range (two plain numbers; last is
    the second), note or appendix (of the whole title).  Titles other than 1 to 54 and other authorities give no row.
    """
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(line), r"(?i)^\s*authority:\s*", ""), r"\s+", " "), r"\.?\s*$", "")
    clauses = F.split(F.regexp_replace(body, r"[,;]?\s*\b(\d{1,2}) U\. ?S\. ?C\.", "\x1f$1 U.S.C."), "[\x1f;]")
    d = df.select(F.col(id_col).alias("id"), F.explode(clauses).alias("c"))
    head = r"^\s*(\d{1,2}) U\.S\.C\.( App\.| Appendix)?\s*(.*)$"
    d = d.select("id", F.regexp_extract("c", head, 1).try_cast("int").alias("title"), (F.regexp_extract("c", head, 2) != "").alias("app"), F.regexp_extract("c", head, 3).alias("rest")).filter("title between 1 and 54")
    d = d.select("id", "title", "app", F.explode(F.split(F.regexp_replace("rest", r"(?i),? and ", ","), ",")).alias("s"))
    piece = r"^\s*(?:§+ ?)?(\d+[A-Za-z]*(?:-\d+[A-Za-z]+)*)(?:-(\d+))?\s*(et seq\.?)?\s*(note)?\s*$"
    part = [F.regexp_extract("s", piece, k) for k in range(5)]
    form = F.when(F.col("app"), "appendix").when(part[4] != "", "note").when(part[3] != "", "et seq").when(part[2] != "", "range").otherwise("exact")
    return d.filter(part[0] != "").select("id", "title", part[1].alias("section"), form.alias("form"), F.nullif(part[2], F.lit("")).alias("last"))
