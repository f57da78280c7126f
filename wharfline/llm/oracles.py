"""The operators in DuckDB's SQL, where SQL can express them: brute force over every match, window and pair, for small tables.

Patterns are the contracts' own, without the quantifiers that only save time in Java. Of op5 the SQL has the base kinds: RE2 has no
lookarounds, which the added ones need. op7 would
sort every 50-byte string of the corpus, which SQL can say but not in reasonable time; op3, op6 and op9 train a model or write a format.
tests/llm holds those, and the pipeline, against plain Python.
"""

from __future__ import annotations

from wharfline.llm.mixing import MOST_EPOCHS, NONE, SEED, SHARE, WEIGHTS

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TEXTS = "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"


def _spans(kind: str, order: int, pattern: str, keep: str = "TRUE", group: int = 0) -> str:
    """(doc_id, kind, o, start, stop) of the leftmost matches of a pattern whose part p passes keep."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS o, start, start + length(f) AS stop FROM (
SELECT doc_id, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start, m[i] AS f, q[i] AS p
FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS q, string_split_regex(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(m) + 1)) u(i)) WHERE {keep}"""


def _report(spans: list[str], base: list[str], order: str) -> str:
    names = ", ".join(f"'{k}'" for k in base)
    joined = lambda where: f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}){where}"
    counts = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in base)
    return f"""WITH {TEXTS}, s AS ({' UNION ALL '.join(spans)}), r AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)}, {joined(f" FILTER (kind IN ({names}))")} AS b, {joined("")} AS a FROM s GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN r USING (doc_id)"""


SECRETS = _report(
    [
        _spans("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(p) >= 12", 2),
        _spans("access", 2, "AKIA[A-Z0-9]+", "length(p) >= 18"), _spans("hex", 3, "[0-9a-f]+", "length(p) >= 16"), _spans("pem", 4, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
        _spans("github", 5, "gh[pousr]_[A-Za-z0-9]{36,}"), _spans("slack", 6, "xox[abprs]-[A-Za-z0-9-]{10,}"), _spans("jwt", 7, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ],
    ["assign", "access", "hex"], "start, o",
)

DIGITS = "regexp_replace(p, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({DIGITS}), i, 1)::INT ELSE substr(reverse({DIGITS}), i, 1)::INT * 2 // 10 + substr(reverse({DIGITS}), i, 1)::INT * 2 % 10 END)) % 10 = 0"
PII = _report(
    [
        _spans("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        _spans("ip", 2, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(p, '.'), lambda x: NOT regexp_matches(x, '^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$'))) = 0"),
        _spans("card", 3, r"[0-9]([\x20-]?[0-9])+", f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN}"), _spans("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({DIGITS}) BETWEEN 9 AND 15"),
    ],
    ["email", "ip", "card", "phone"], "o, start",
)

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(k) WHERE len(w) > 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

WORDS = f"coalesce(regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
OVERLAPS = f"""WITH it AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, array_to_string(w[k:k + 9], ' ') AS g, least(len(w), 10)::BIGINT AS n FROM it, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(k) WHERE len(w) > 0), lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT doc_id, {WORDS} AS w FROM documents), dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) u(k)),
hit AS (SELECT doc_id, k, n, item FROM dw JOIN win USING (g, n)), pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) u(p) GROUP BY 1),
ids AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)"""

#: The checksum bit by bit; then, row by row, the best edits into each of the four states as (cost, audit), with what they make of the rows.
CRC32 = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda s, b: list_reduce([xor(s, b)] || repeat([0::BIGINT], 8), lambda k, z: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END)), 4294967295)"
LAST = "right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"
REPAIR = f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) AS i FROM m), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
r AS (SELECT conv_id, i, role, text, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b, CASE WHEN {LAST} = '' THEN 1 WHEN again THEN 2 WHEN {LAST} NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
ins(q, p, c, a, t) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 2, 2, 'I', chr(10) || 'user:'),
  (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 4, 'II', chr(10) || 'assistant:' || chr(10) || 'user:'), (3, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
kept(p, c, o) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)), named(p, role, o) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
e AS (SELECT conv_id, i, p, p AS o, 3 AS cost, 'D' AS a, '' AS t FROM r, range(4) x(p) UNION ALL SELECT conv_id, i, p, o, CASE fault WHEN 3 THEN 1 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM r JOIN kept USING (c) WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, i, p, o, CASE fault WHEN 3 THEN 3 ELSE 2 END, 'R', chr(10) || named.role || ':' || text FROM r, named WHERE fault IN (0, 3)),
s AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, lpad('0', 9, '0') AS k, '' AS t FROM r UNION ALL
  SELECT conv_id, i, q, min(k), arg_min(t, k) FROM (SELECT s.conv_id, s.i + 1 AS i, e.o AS q, lpad((left(s.k, 9)::BIGINT + ins.c + e.cost)::VARCHAR, 9, '0') || substr(s.k, 10) || ins.a || e.a AS k, s.t || ins.t || e.t AS t
    FROM s JOIN ins USING (q) JOIN e ON e.conv_id = s.conv_id AND e.i = s.i + 1 AND e.p = ins.p) GROUP BY ALL),
n AS (SELECT conv_id, max(i) AS n, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND b || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
z AS (SELECT conv_id, min(k) AS k, arg_min(t, k) AS t FROM (SELECT s.conv_id, lpad((left(s.k, 9)::BIGINT + ins.c)::VARCHAR, 9, '0') || substr(s.k, 10) || ins.a AS k, s.t || ins.t AS t FROM s JOIN n ON n.conv_id = s.conv_id AND n.n = s.i JOIN ins USING (q) WHERE ins.p IN (0, 3)) GROUP BY 1),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps FROM m GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
coalesce(left(k, 9)::BIGINT, 0) AS cost, coalesce(substr(k, 10), '') AS audit, sha256(coalesce(substr(t, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id) LEFT JOIN g USING (conv_id) LEFT JOIN z USING (conv_id)"""
TERMS = f"coalesce(regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), [])"
RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents), k AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score FROM q JOIN df USING (term) JOIN tf USING (term), k WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""


def _weight(level: str) -> str:
    known = " ".join(f"WHEN '{name}' THEN {w}" for name, w in WEIGHTS[level].items())
    return f"CASE {level} {known} ELSE 1 END" if known else "1"


def _deal(level: str, above: list[str]) -> str:
    """CTEs that deal the budgets of above's nodes to their children at level."""
    keys = ", ".join([*above, level])
    by, on = (f"PARTITION BY {', '.join(above)} " if above else ""), " AND ".join(f"f.{c} = s.{c}" for c in above) or "TRUE"
    given = f"JOIN {above[-1]}_b g USING ({', '.join(above)})" if above else "CROSS JOIN (SELECT sum(tokens)::HUGEINT * %d // %d AS budget FROM leaf) g" % SHARE
    return f"""{level}_r AS (SELECT {keys}, sum(tokens)::HUGEINT * {MOST_EPOCHS} AS holds FROM leaf GROUP BY ALL), {level}_w AS (SELECT r.*, g.budget::HUGEINT AS given, ({_weight(level)})::HUGEINT AS w FROM {level}_r r {given}),
{level}_p AS (SELECT *, holds::DOUBLE / w AS r, greatest(given - coalesce(sum(holds) OVER ({by}ORDER BY holds::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::HUGEINT AS lft, (sum(w) OVER ({by}ORDER BY holds::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS rest FROM {level}_w),
{level}_f AS (SELECT *, holds * rest <= w * lft AS fits FROM {level}_p), {level}_s AS (SELECT * FROM {level}_f WHERE NOT fits QUALIFY row_number() OVER ({by}ORDER BY r, {level}) = 1),
{level}_b AS (SELECT {', '.join(f'f.{c}' for c in [*above, level])}, CASE WHEN f.fits THEN f.holds ELSE least(f.w * s.lft // s.rest, f.holds) END AS budget FROM {level}_f f LEFT JOIN {level}_s s ON {on})"""


#: Weights here are positive; a weight of 0 is covered by tests/llm.
MIXING = f"""WITH d AS (SELECT doc_id AS id, md5(coalesce(text, '')) AS digest, coalesce('domain' || (('0x' || substr(md5(source), 1, 4))::INTEGER % 3), '{NONE}') AS domain, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents), leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{_deal("domain", [])}, {_deal("lang", ["domain"])}, {_deal("source", ["domain", "lang"])},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END::BIGINT AS whole, (budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens)::BIGINT AS rest FROM leaf JOIN source_b USING (domain, lang, source)),
x AS (SELECT *, md5(concat_ws('|', '{SEED}', whole::VARCHAR, coalesce(id::VARCHAR, ''), digest)) AS place FROM d JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM x WHERE rest > 0)
SELECT id AS doc_id, domain, lang, source, n_tokens, unnest(range(0, whole)) AS epoch FROM x UNION ALL SELECT id, domain, lang, source, n_tokens, whole FROM c WHERE run <= rest"""

ORACLE_SQL = {"op1_secrets": SECRETS, "op2_jaccard": JACCARD, "op4_mixing": MIXING, "op5_pii": PII, "op8_warc": WARC, "op10_decontaminate": OVERLAPS, "op12_repair": REPAIR, "op13_search": RANKED}
