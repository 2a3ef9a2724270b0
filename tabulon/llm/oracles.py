"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tabulon.llm.url_filter import DAMPING

ROUNDS = 8  # of the statement; the operator goes on until it converges

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP10 = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 9], ' ') AS win, least(len(w), 10) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM docs),
found AS (SELECT a.doc_id, a.s, z.n, x.item_id FROM places a JOIN sizes z ON a.s + z.n - 1 <= len(a.w)
          JOIN windows x ON x.n = z.n AND x.win = array_to_string(a.w[a.s : a.s + z.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP5 = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[|]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<\[|]', '', 'g')) + 13 AS chars,
  row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER w AS before, lag(role, 2) OVER w AS before2 FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
                WHEN role = 'assistant' THEN before = 'user' ELSE false END) AND max(CASE WHEN k = n THEN role END) = 'assistant' AS valid
FROM sized GROUP BY conv_id
"""


def _op3() -> str:
    host = r"translate(regexp_extract(after, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [f"s0 AS (SELECT kind, host, {1 - DAMPING!r}::DOUBLE * seed AS score FROM seeds)"]
    steps += [f"s{k} AS (SELECT kind, host, sum(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT e.kind, e.t, {DAMPING!r}::DOUBLE * e.share * s.score FROM both2 e JOIN s{k - 1} s ON e.kind = s.kind AND e.a = s.host) GROUP BY ALL)" for k in range(1, ROUNDS + 1)]
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
h AS (SELECT page_id, html, {host} AS host, regexp_extract(substr(after, length(regexp_extract(after, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM r),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (by_rule = 'allow') AS allowed, count(*) FILTER (by_rule = 'block') AS blocked FROM v GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host, allowed / n AS seed FROM hosts WHERE allowed > 0 AND host <> ''
          UNION ALL SELECT 'distrust', host, blocked / n FROM hosts WHERE blocked > 0 AND host <> ''),
said AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?:(?:https?:)?//)?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}'))) AS said FROM v),
named AS (SELECT src, lower(regexp_replace(said, '^.*//', '')) AS dst, bool_or(contains(said, '//')) AS linked, count(*) AS w FROM said GROUP BY ALL),
edges AS (SELECT src, dst, w FROM named WHERE src <> dst AND src <> '' AND (linked OR dst IN (SELECT host FROM hosts))),
both1 AS (SELECT 'trust' AS kind, src AS a, dst AS t, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
both2 AS (SELECT kind, a, t, w / sum(w) OVER (PARTITION BY kind, a) AS share FROM both1),
{", ".join(steps)},
judged AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust FROM s{ROUNDS} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN round(distrust - trust, 9) >= {round((1 - DAMPING) / 2, 9)!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM v LEFT JOIN judged USING (host)
"""


def _op12(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT rid, c, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - m.x[i]) * (v.x[i] - m.x[i])))::BIGINT AS d FROM v, c{r} m),
a{r} AS MATERIALIZED (SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{r} GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(x[i])::HUGEINT AS s, count(*) AS n FROM a{r} JOIN v USING (rid), range(1, {dims + 1}) t(i) GROUP BY c, i),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k})),
{", ".join(steps)},
f AS (SELECT c, sha256(array_to_string(x, ',')) AS sha FROM c{rounds})
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN f USING (c)
"""


OP13 = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
runs AS (SELECT lang, size, array_to_string(w[s : s + size - 1], ' ') AS phrase
         FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM split, range(1, 5) z(size) WHERE len(w) >= size)),
f AS MATERIALIZED (SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM runs GROUP BY lang, phrase HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[: k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS rp
         FROM f, range(1, 4) c(k) WHERE k < size),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = b.lang AND g.size > len(string_split(b.phrase, ' '))
           AND 100 * g.a >= 80 * b.a AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' '))),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank::INTEGER AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


ORACLE_SQL: dict[str, str] = {"op3_url_filter": _op3(), "op5_chat_format": OP5, "op10_decontamination": OP10, "op12_centroid_clusters": _op12(), "op13_collocations": OP13}
