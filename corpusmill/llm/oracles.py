"""The pipeline operators' queries as SQL for DuckDB, where SQL can express them.

The SQL states rules and constants on its own; none are imported from the operators.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kinds: list[tuple[str, str, str]]) -> str:
    """CTEs ``docs`` and ``spans (r, kind, rank, start, stop, value, near)`` of valid matches."""
    parts = [
        f"""SELECT r, {_text(kind)} AS kind, {rank} AS rank, regexp_extract_all(t, {_text(pattern)}) AS ms,
            regexp_split_to_array(t, {_text(pattern)}) AS ps FROM docs"""
        for rank, (kind, pattern, _) in enumerate(kinds, 1)
    ]
    valid = " ".join(f"WHEN {_text(kind)} THEN {rule}" for kind, _, rule in kinds)
    return f"""docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
each AS (SELECT r, kind, rank, unnest(ms) AS value, unnest(ps[1:len(ms)]) AS gap, unnest(ps[2:]) AS follows,
    unnest(range(1, len(ms) + 1)) AS i FROM found WHERE len(ms) > 0),
placed AS (
  SELECT r, kind, rank, value, lower(right(gap, 48) || ' ' || left(follows, 24)) AS near,
    sum(length(gap)) OVER (PARTITION BY r, kind ORDER BY i)
      + sum(length(value)) OVER (PARTITION BY r, kind ORDER BY i) - length(value) AS start
  FROM each),
spans AS (SELECT r, kind, rank, CAST(start AS BIGINT) AS start,
    CAST(start + length(value) AS BIGINT) AS stop, value, near
  FROM placed WHERE CASE kind {valid} END)"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_SECRET_KINDS = [
    ("assign", _ASSIGN, f"length(regexp_extract(value, {_text(_ASSIGN)}, 1)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(value) >= 20"),
    ("hex", r"[0-9a-f]+", "length(value) >= 24"),
    (
        "identifier",
        r"""(?i:user_?name|login|client_?id|account_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]+""",
        "true",
    ),
    (
        "keylike",
        r"[A-Za-z0-9+/_=-]{16,}",
        "regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]')",
    ),
    (
        "endpoint",
        r"(?:https?|wss?|jdbc:[a-z]+|s3|ftp|postgres|mysql|mongodb)://[A-Za-z0-9._:/@?&=%-]+",
        "true",
    ),
]
ORACLES["op1_secret_scan"] = f"""
WITH {_spans(_SECRET_KINDS)},
near_by AS (
  SELECT x.r, x.kind, x.rank, x.start, x.stop, count(*) FILTER (o.kind IN ('access', 'identifier')) AS ids,
    count(*) FILTER (o.kind IN ('assign', 'hex', 'keylike')) AS secrets, count(*) FILTER (o.kind = 'endpoint') AS endpoints
  FROM spans x LEFT JOIN spans o ON o.r = x.r
    AND (o.start BETWEEN x.stop AND x.stop + 160 OR o.stop BETWEEN x.start - 160 AND x.start)
  GROUP BY ALL),
kept AS (
  SELECT *, kind || ':' || start || ':' || stop AS said FROM near_by
  WHERE rank <= 3 OR (kind = 'identifier' AND secrets > 0) OR (kind = 'keylike' AND ids + endpoints > 0)
    OR (kind = 'endpoint' AND secrets > 0))
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (rank <= 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, rank), '') AS spans
FROM docs d LEFT JOIN kept k ON d.r = k.r GROUP BY d.r, d.doc_id
"""

_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({_DIGITS}[-i] AS INT) WHEN CAST({_DIGITS}[-i] AS INT) > 4
    THEN 2 * CAST({_DIGITS}[-i] AS INT) - 9 ELSE 2 * CAST({_DIGITS}[-i] AS INT) END)) % 10 = 0"""
_PLAIN = "replace(value, ' ', '')"
_MOD97 = f"""length({_PLAIN}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(
  string_split(substr({_PLAIN}, 5) || left({_PLAIN}, 4), ''), lambda c: ascii(c))),
  lambda a, c: (CASE WHEN c < 58 THEN a * 10 + c - 48 ELSE a * 100 + c - 55 END) % 97) = 1"""
_IBAN = "|".join(f"(?:{c})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n}}}" for n, c in (
    (11, "NO"), (12, "BE"), (14, "DK|FI|FK|FO|GL|NL|SD"), (15, "MK|SI"), (16, "AT|BA|EE|KZ|LT|LU|MN|XK"),
    (17, "CH|HR|LI|LV"), (18, "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA"), (19, "AE|GI|IL|IQ|OM|SO|TL"),
    (20, "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG"), (21, "LY|PT|ST"), (22, "IS|TR"), (23, "BI|DJ|FR|GR|IT|MC|MR|SM"),
    (24, "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV"), (25, "BR|EG|PS|QA|UA"), (26, "JO|KW|MU|YE"), (27, "MT|SC"),
    (28, "LC"), (29, "RU"),
))
_PII_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "list_max(list_transform(string_split(value, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999))) <= 255",
    ),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    ("iban", _IBAN, _MOD97),
    (
        "ssn",
        r"[0-9-]{11,}",
        """regexp_full_match(value, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND left(value, 3) NOT IN ('000', '666')
  AND value[1] <> '9' AND value[5:6] <> '00' AND right(value, 4) <> '0000'""",
    ),
]
_WORDS = [
    ("email", 80, "mail|contact|correo|kontakt"),
    ("ip", 50, "ip|addr|host|server|login"),
    ("card", 70, "card|visa|credit|carte|tarjeta|karte"),
    ("phone", 60, "phone|tel|call|mobile|fax"),
    ("iban", 90, "iban|bank|konto|account|compte|cuenta"),
    ("ssn", 40, "ssn|social|security"),
]
_SCORE = " ".join(
    f"WHEN '{k}' THEN {s} + CASE WHEN regexp_matches(near, '{w}') THEN 20 ELSE 0 END" for k, s, w in _WORDS
)
ORACLES["op5_pii"] = f"""
WITH {_spans(_PII_KINDS)},
scored AS (
  SELECT *, kind || ':' || start || ':' || stop AS said, least(100, CASE kind {_SCORE} END
    - CASE WHEN regexp_matches(near, 'version|build|serial|example') THEN 20 ELSE 0 END) AS score
  FROM spans),
kept AS (SELECT * FROM scored WHERE rank <= 4 OR score >= 50)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(said, ',' ORDER BY rank, start) FILTER (rank <= 4), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY rank, start), '') AS spans,
  coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY rank, start), '') AS scores
FROM docs d LEFT JOIN kept k ON d.r = k.r GROUP BY d.r, d.doc_id
"""

ORACLES["op6_mix"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM s),
w AS (SELECT *, [3, 1, 2][src % 3 + 1] AS weight, 2 * source_size AS cap FROM n),
f AS (SELECT *, CAST(cap AS DOUBLE) / weight AS full_at,
    CAST(sum(cap) OVER o AS DOUBLE) AS caps, CAST(sum(weight) OVER o AS DOUBLE) AS spent
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, src)),
t AS (SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) AS total, CAST(sum(weight) AS DOUBLE) AS weights FROM w),
l AS (SELECT coalesce(max(caps), 0) AS caps, coalesce(max(spent), 0) AS spent FROM f, t
  WHERE f.caps + full_at * (weights - f.spent) <= total),
targets AS (SELECT source, src, source_size, least(CAST(cap AS DOUBLE),
    weight * CASE WHEN weights > spent THEN (total - caps) / (weights - spent) ELSE 'inf'::DOUBLE END) AS target,
    CAST(CAST('0x' || substr(md5('42:' || src), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u
  FROM w, t, l),
k AS (SELECT d.doc_id, d.size, g.source_size, g.target, u,
    row_number() OVER (PARTITION BY src ORDER BY size, doc_id NULLS FIRST, md5(text) NULLS FIRST, r) - 1 AS k,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM d JOIN targets g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(least(2, floor((k + 1) * rate + u) - floor(k * rate + u)) AS BIGINT) AS copies FROM k)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT *, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to, true AS intact
FROM f
"""

ORACLES["op8_top_k"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
  FROM v q JOIN v ON q.r <> v.r AND len(q.v) = len(v.v) WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INT) AS rank,
    vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10
"""

ORACLES["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
ws AS (SELECT r, unnest(w) AS w, unnest(range(len(w))) AS i FROM d WHERE len(w) > 0),
runs AS (SELECT r, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS h,
    count(*) OVER (PARTITION BY r) AS words FROM ws WINDOW o AS (PARTITION BY r ORDER BY i)),
p AS MATERIALIZED (SELECT DISTINCT r, h FROM runs WHERE i <= greatest(words - 5, 0)),
n AS MATERIALIZED (SELECT d.r, count(p.h) AS n FROM d LEFT JOIN p ON p.r = d.r GROUP BY d.r),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM p a JOIN p b ON a.h = b.h AND a.r <> b.r
  JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r
  GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
  SELECT r AS a, r AS b FROM d
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, n.n AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN n ON d.r = n.r JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b
GROUP BY d.r, d.doc_id, n.n
"""

ORACLES["op11_hard_negatives"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT q.r, q.vec_id AS anchor_id, q.label = v.label AS alike, v.vec_id,
    CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
  FROM v q JOIN v ON q.r <> v.r AND len(q.v) = len(v.v) WHERE q.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s WHERE alike),
w AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.r, p.n ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.alike
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
  WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5
"""

# The checksum is worked out bit by bit: a table of 256 remainders, then a step for each byte.
ORACLES["op13_spelling_variants"] = r"""
WITH RECURSIVE bits AS (
  SELECT range AS b, 0 AS k, CAST(range AS BIGINT) AS c FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''),
    '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
counted AS (SELECT d, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY d, w),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(d || ':' || w))),
      lambda i: CAST(('0x' || substr(hex(encode(d || ':' || w)), 2 * i + 1, 2)) AS BIGINT))),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8))) AS h
  FROM counted, crc),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n
    FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (
  SELECT word, n, i, left(word, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS MATERIALIZED (
  SELECT x.word, y.word AS near, y.n FROM less x JOIN less y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN w ON w.word = l.a || l.b
  UNION SELECT w.word, l.word, l.n FROM less l JOIN w ON w.word = l.a || l.b),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS most, arg_min(near, (-n, encode(near))) AS near FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN most >= 5 * w.n THEN near END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
followed AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT x.word, f.word, f.form FROM followed x JOIN formed f ON f.word = x.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN followed r ON r.word = f.word WHERE r.next IS NULL
"""
