"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from brightloom.llm.mixing import EPOCHS, SHARE

_BLOCK_WORDS = 4096

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sidx FROM s0),
s2 AS (SELECT *, [3, 1, 2][(sidx % 3 + 1)::INT]::BIGINT AS weight, {EPOCHS} * source_size AS lim FROM s1),
s3 AS (
  SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS lev,
         lim::DOUBLE / weight AS full_at
  FROM s2 WINDOW f AS (ORDER BY lim::DOUBLE / weight, sidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, max(lev) FILTER (full_at >= lev) OVER () AS level FROM s3),
s5 AS (SELECT source, sidx, source_size, least(lim::DOUBLE, coalesce(level * weight, lim::DOUBLE)) AS target FROM s4),
s6 AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM s5),
s AS (SELECT *, (words + {_BLOCK_WORDS} - 1) // {_BLOCK_WORDS} AS need FROM s6),
n AS (
  SELECT *, sum(need) OVER (ORDER BY sidx) - need AS low, sum(need) OVER () AS blocks FROM s WHERE need > 0),
k AS (SELECT max(blocks)::BIGINT AS blocks, ceil(log2(greatest(max(blocks), 1)))::INT AS bits FROM n),
p AS (
  SELECT slot, (list_sum(list_transform(range(0, bits), lambda j: ((slot >> j) & 1) << (bits - 1 - j))) * blocks) >> bits AS at0, blocks, bits
  FROM k, range(0, (1 << 20)) t(slot) WHERE slot < (1 << bits)),
q AS (SELECT slot, coalesce(at0, 0) AS at FROM p),
o AS (
  SELECT slot, sidx, need, row_number() OVER (PARTITION BY sidx ORDER BY slot) - 1 AS block
  FROM q JOIN n ON q.at >= n.low AND q.at < n.low + n.need),
slots AS (SELECT * FROM o WHERE block < need),
placed AS (
  SELECT d.*, s.sidx, s.source_size, s.target, s.words,
         sum(size) OVER (PARTITION BY s.sidx ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
         row_number() OVER () AS row
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
pieces AS (
  SELECT row, sidx, e * source_size + start AS low, least(e * source_size + start + size, words) AS high
  FROM placed, range(0, {EPOCHS}) t(e) WHERE least(e * source_size + start + size, words) > e * source_size + start),
played AS (
  SELECT row, min(slot) AS first_slot
  FROM (SELECT row, sidx, unnest(range((low // {_BLOCK_WORDS})::BIGINT, ((high - 1) // {_BLOCK_WORDS})::BIGINT + 1)) AS block FROM pieces) JOIN slots USING (sidx, block)
  GROUP BY row),
taken AS (SELECT row, sum(high - low)::BIGINT AS taken FROM pieces GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot
FROM placed LEFT JOIN played USING (row) LEFT JOIN taken USING (row)
"""

_RECORD = r"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, '')
  || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce({html}, ''))::VARCHAR
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

OP2 = f"""
WITH p AS (SELECT *, ('0x' || substr(md5('damage' || coalesce(page_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM pages),
a AS (
  SELECT page_id, strlen(payload)::BIGINT AS rec_length, sha256(payload) AS expected_sha256,
         (sum(strlen(payload)) OVER (ORDER BY page_id) - strlen(payload))::BIGINT AS rec_offset
  FROM (SELECT page_id, {_RECORD.format(html="html")} AS payload FROM p WHERE h % 307 <> 0)),
b AS (
  SELECT page_id, sha256({_RECORD.format(html="body")}) AS found_sha256
  FROM (SELECT *, CASE WHEN h % 101 = 0 THEN '*' || substr(html, 2) ELSE html END AS body FROM p WHERE h % 211 <> 0))
SELECT page_id AS record_id, CASE WHEN found_sha256 IS NULL THEN 'missing' WHEN expected_sha256 IS NULL THEN 'extra' ELSE 'corrupt' END AS kind,
       rec_offset, rec_length, expected_sha256, found_sha256
FROM a FULL JOIN b USING (page_id) WHERE expected_sha256 IS DISTINCT FROM found_sha256
"""

OP6 = r"""
WITH c AS (
  SELECT page_id, url, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '')) AS host,
         list_filter(string_split(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/'), lambda x: x <> '') AS parts,
         (DATE '2024-01-01' + (('0x' || substr(md5('fetch' || coalesce(page_id::VARCHAR, '')), 1, 15))::BIGINT % 366)::INT)::DATE AS fetched_on
  FROM pages),
hosts AS (
  SELECT k, ('0x' || substr(md5('add' || k), 1, 15))::BIGINT % 300 AS a, ('0x' || substr(md5('remove' || k), 1, 15))::BIGINT % 60 AS r
  FROM (SELECT DISTINCT host AS k FROM c WHERE host <> '') WHERE ('0x' || substr(md5('list' || k), 1, 15))::BIGINT % 4 = 0),
firsts AS (
  SELECT k FROM (SELECT DISTINCT host || '/' || parts[1] AS k FROM c WHERE host <> '' AND len(parts) > 0) WHERE ('0x' || substr(md5('path' || k), 1, 15))::BIGINT % 5 = 0),
log AS (
  SELECT k, 1 AS is_add, a AS n FROM hosts
  UNION ALL SELECT k, 0, a + 1 + r FROM hosts
  UNION ALL SELECT k, 1, a + 1 + r + 20 FROM hosts WHERE ('0x' || substr(md5('again' || k), 1, 15))::BIGINT % 3 = 0
  UNION ALL SELECT k, 1, ('0x' || substr(md5('first' || k), 1, 15))::BIGINT % 366 FROM firsts),
steps AS (
  SELECT k, is_add, (DATE '2024-01-01' + n::INT)::DATE AS start, lead((DATE '2024-01-01' + n::INT)::DATE) OVER (PARTITION BY k ORDER BY n, is_add) AS until FROM log),
valid AS (SELECT DISTINCT k, start, until FROM steps WHERE is_add = 1 AND (until IS NULL OR until > start)),
keys AS (
  SELECT page_id, url, fetched_on, unnest(
    CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      CASE WHEN len(parts) > 0 THEN [host || '/' || parts[1]] ELSE []::VARCHAR[] END) END) AS k
  FROM c),
hit AS (
  SELECT page_id, count(*) AS n_active, max({'n': length(k), 'k': k, 's': start}) AS best
  FROM keys JOIN valid USING (k) WHERE start <= fetched_on AND (until IS NULL OR fetched_on < until) GROUP BY page_id)
SELECT page_id, host, fetched_on, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(n_active, 0) > 0 AS blocked, best.k AS listed_key, best.s AS since
FROM c LEFT JOIN hit USING (page_id)
"""

OP7 = r"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
iw AS (
  SELECT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw USING (n, gram)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_PII_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.9, 0.1, "mail|contact|write to", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", 0.6, 0.3, r"\bip\b|address|server|host", r"regexp_full_match(m, '(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}')"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", 0.8, 0.2, "card|visa|master|credit|payment", """length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''),
      lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE c::INT * 2 % 10 + c::INT // 5 END)) % 10 = 0"""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, 0.3, "phone|call|tel|mobile|fax", "length(digits) BETWEEN 9 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)", 0.7, 0.2, "iban|bank|account", """NOT regexp_matches(around, '[A-Za-z0-9]') AND
      list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(m, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END),
      lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END, 0) = 1"""),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, 0.4, "ssn|social security|tax id", """NOT regexp_matches(around, '[A-Za-z0-9]') AND substr(m, 1, 3) NOT IN ('000', '666') AND m[1] <> '9'
      AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'"""),
    ("secret", r"[A-Za-z0-9_-]{32,64}", 0.3, 0.5, "token|secret|passw|api|key|credential", "NOT regexp_matches(around, '[A-Za-z0-9_-]') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"),
)


def _op10() -> str:
    parts = []
    for k, (name, pattern, score, boost, context, valid) in enumerate(_PII_KINDS):
        parts.append(
            rf"""SELECT doc_id, {k} AS k, '{name}' AS kind, s, e, {score}::DOUBLE + CASE WHEN regexp_matches(ctx, '{context}') THEN {boost}::DOUBLE ELSE 0 END AS score
  FROM (
    SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM (
      SELECT doc_id, row, ms[i] AS m, lower(right(gs[i], 40) || ' ' || left(gs[i + 1], 20)) AS ctx, right(gs[i], 1) || left(gs[i + 1], 1) AS around,
             (list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))::BIGINT AS s,
             (list_sum(list_transform(gs[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda g: length(g))))::BIGINT AS e
      FROM (SELECT doc_id, row, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gs, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d)))
  WHERE {valid}"""
        )
    spans = "\n  UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
x AS ({spans}),
y AS (SELECT * FROM x WHERE k < 4 OR score >= 0.5),
z AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
         string_agg(printf('%.1f', score), ',' ORDER BY s, k) AS scores,
         count(*) FILTER (score >= 0.85) AS n_strong
  FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_strong, 0)::BIGINT AS n_strong
FROM d LEFT JOIN z USING (doc_id)
"""


OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
d AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS x, greatest(h1 % (n + 1), h2 % (n + 1)) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, n, form, text, array_to_string(u[1:x], '') AS prefix, array_to_string(u[x + 1:y], '') AS middle, array_to_string(u[y + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {"op1_mixing": OP1, "op2_warc_fixity": OP2, "op6_url_filter": OP6, "op7_decontamination": OP7, "op10_pii": _op10(), "op11_middle": OP11}
