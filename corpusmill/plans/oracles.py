"""The registered queries as SQL for DuckDB, built from shared common table expressions.

The SQL is written from the definitions, not from the Spark plans: windows over whole
groups, a recursive walk over documents for packing, and one pass per document for the
greedy near-duplicate rule.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

# Fixed values, stated here on their own: nothing of the code under test is imported.
VAL_PERCENT = 5
MIN_CHARS, MAX_CHARS = 5, 20000  # both exclusive
MIX_WEIGHTS = {"web": 0.45, "code": 0.25, "math": 0.20, "academic": 0.10}
ACADEMIC_WEIGHTS = {"arxiv": 0.5, "books": 0.5}
SPLIT_SEEDS = {"train": 42, "val": 1337}
SHINGLE_CHARS, NUM_PERM = 5, 128
SHINGLE_BASE, MIX_1, MIX_2 = 16777619, 2246822507, 3266489909
VOCAB_SIZE, BLOCK_SIZE = 32000, 1024
UNK_ID, BOS_ID, EOS_ID, PAD_ID, FIRST_WORD_ID = 0, 1, 2, 2, 3
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\s\x0b\p{L}\p{N}_]"
SPACE_PATTERN = r"[^\s\x0b]+"
ROLE_ENDS = {"web": 8, "code": 13, "math": 17, "arxiv": 18}
CHOICES = 4
_BANDS, _ROWS = 5, 25
q = SimpleNamespace(
    FLAT_WEIGHTS={"web": 0.45, "code": 0.25, "math": 0.20, "arxiv": 0.05, "books": 0.05},
    EPOCHS=(0, 1, 2), BATCH=4, VAL_BATCH=4, VAL_BLOCK=32, CONTEXT=1024, WORLD_SIZE=3,
)

# The same white space class as the Spark side, in RE2 escapes.
WHITESPACE = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def _hex32(text: str, at: int) -> str:
    return f"CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT)"


def _bucket(text: str) -> str:
    value = "0"
    for j in range(4):
        value = f"(({value} * 96 + {_hex32(text, 1 + 8 * j)}) % 100)"
    return value


def _split(text: str) -> str:
    return f"CASE WHEN {_bucket(text)} < {VAL_PERCENT} THEN 'val' ELSE 'train' END"


def _fits(text: str) -> str:
    return f"(length({text}) > {MIN_CHARS} AND length({text}) < {MAX_CHARS})"


def _normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{WHITESPACE}', ' ', 'g'))"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


_ROLE = "CASE " + " ".join(
    f"WHEN CAST(substr(source, 4) AS INT) <= {last} THEN '{name}'" for name, last in ROLE_ENDS.items()
) + " ELSE 'books' END"

DOCS = f"""d AS MATERIALIZED (
  SELECT doc_id, doc_id AS ord, {_ROLE} AS source, text, {_split("text")} AS split,
         {_fits("text")} AS fits
  FROM documents)"""


# Mixing


def _case(weights: dict[str, float]) -> str:
    total, so_far, ends = sum(weights.values()), 0.0, []
    for name, weight in weights.items():
        so_far += weight
        ends.append((name, round(so_far / total * 2**32)))
    return "CASE " + " ".join(f"WHEN u < {end} THEN '{name}'" for name, end in ends) + " END"


def _interleave(
    name: str, records: str, weights: dict[str, float], seed: int, epochs: tuple[int, ...]
) -> str:
    """CTEs ending in ``name (epoch, pos, source, k)``; ``records (epoch, source, k)``."""
    listed = ", ".join(f"'{s}'" for s in weights)
    values = ", ".join(f"({e}, '{s}')" for e in epochs for s in weights)
    return f"""
{name}_n AS MATERIALIZED (
  SELECT v.epoch, v.source, greatest(count(r.k), 1) AS n
  FROM (VALUES {values}) v(epoch, source)
  LEFT JOIN {records} r ON r.epoch = v.epoch AND r.source = v.source
  GROUP BY ALL),
{name}_i AS MATERIALIZED (
  SELECT epoch, unnest(range(CAST(sum(n) AS BIGINT))) AS step FROM {name}_n GROUP BY epoch),
{name}_u AS MATERIALIZED (
  SELECT epoch, step, {_hex32(f"concat({seed} + epoch, ':', step)", 1)} AS u FROM {name}_i),
{name}_s AS MATERIALIZED (
  SELECT epoch, step, source, row_number() OVER (PARTITION BY epoch, source ORDER BY step) AS k
  FROM (SELECT *, {_case(weights)} AS source FROM {name}_u)),
{name}_e AS MATERIALIZED (
  SELECT s.epoch, min(s.step) AS last FROM {name}_s s
  JOIN {name}_n n ON s.epoch = n.epoch AND s.source = n.source AND s.k = n.n
  GROUP BY s.epoch),
{name} AS MATERIALIZED (
  SELECT s.epoch, s.step AS pos, s.source, s.k FROM {name}_s s
  JOIN {name}_e e ON s.epoch = e.epoch AND s.step <= e.last
  JOIN {records} r ON r.epoch = s.epoch AND r.source = s.source AND r.k = s.k
  WHERE s.source IN ({listed}))"""


def _ranked(split: str, epochs: tuple[int, ...], suffix: str = "") -> str:
    values = ", ".join(f"({e})" for e in epochs)
    return f"""
ranked{suffix} AS MATERIALIZED (
  SELECT v.epoch, source, ord, row_number() OVER (PARTITION BY v.epoch, source ORDER BY ord) AS k
  FROM d, (VALUES {values}) v(epoch) WHERE split = '{split}')"""


def _mixed(split: str, epochs: tuple[int, ...], suffix: str = "") -> str:
    """CTEs ending in ``mixed (epoch, pos, source, ord)`` for the two-level mixture."""
    seed = SPLIT_SEEDS[split]
    x = suffix
    return ",".join([
        _ranked(split, epochs, x),
        _interleave(f"inn{x}", f"ranked{x}", ACADEMIC_WEIGHTS, seed, epochs),
        f"""
streams{x} AS MATERIALIZED (
  SELECT epoch, source, k, source AS leaf, k AS leaf_k FROM ranked{x}
  WHERE source NOT IN ('arxiv', 'books')
  UNION ALL
  SELECT epoch, 'academic', row_number() OVER (PARTITION BY epoch ORDER BY pos), source, k
  FROM inn{x})""",
        _interleave(f"outr{x}", f"streams{x}", MIX_WEIGHTS, seed, epochs),
        f"""
mixed{x} AS MATERIALIZED (
  SELECT o.epoch, o.pos, r.source, r.ord FROM outr{x} o
  JOIN streams{x} t ON t.epoch = o.epoch AND t.source = o.source AND t.k = o.k
  JOIN ranked{x} r ON r.epoch = o.epoch AND r.source = t.leaf AND r.k = t.leaf_k)""",
    ])


# Tokens


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD_PATTERN}')"


def _spaces(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{SPACE_PATTERN}')"


def _vocab(name: str = "vocab", split=_words) -> str:
    return f"""
{name}_c AS MATERIALIZED (
  SELECT token, count(*) AS n FROM (
    SELECT unnest({split("text")}) AS token FROM d WHERE split = 'train' AND fits)
  GROUP BY token),
{name} AS MATERIALIZED (
  SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + {FIRST_WORD_ID - 1} AS INT) AS id, n
  FROM {name}_c
  QUALIFY id < {VOCAB_SIZE})"""


def _encoded(name: str, rows: str, key: str, vocab: str = "vocab", split=_words) -> str:
    """CTE ``name (key, tokens)`` of the ids of ``rows (key, text)``."""
    return f"""
{name}_t AS MATERIALIZED (
  SELECT {key}, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS j
  FROM (SELECT {key}, {split("text")} AS t FROM {rows})),
{name} AS MATERIALIZED (
  SELECT {", ".join(f"r.{k.strip()}" for k in key.split(","))}, coalesce(x.tokens, []) AS tokens
  FROM {rows} r LEFT JOIN (
    SELECT {key}, list(coalesce(v.id, {UNK_ID}) ORDER BY j) AS tokens
    FROM {name}_t LEFT JOIN {vocab} v USING (token) GROUP BY {key}) x USING ({key}))"""


FITTING = "f AS MATERIALIZED (SELECT doc_id, ord, text FROM d WHERE fits)"
ALL = "f AS MATERIALIZED (SELECT doc_id, ord, text FROM d)"


def _scores(name: str = "scores", vocab: str = "vocab") -> str:
    return f"""
{name}_m AS MATERIALIZED (
  SELECT (SELECT sum(n) FROM {vocab}_c) AS total, (SELECT sum(n) FROM {vocab}) AS known,
         (SELECT count(*) FROM {vocab}) AS words),
{name} AS MATERIALIZED (
  SELECT id, -ln((n + 1) / CAST(total + words + {FIRST_WORD_ID} AS DOUBLE)) AS nll
  FROM (SELECT id, n FROM {vocab}
        UNION ALL SELECT {UNK_ID}, total - known FROM {name}_m
        UNION ALL SELECT {BOS_ID}, 0 UNION ALL SELECT {EOS_ID}, 0), {name}_m)"""


# Packing


def _walk(name: str, rows: str, block: int, lossless: bool) -> str:
    """CTE ``name (epoch, rn, s, blk)``: buffer and block number before each document."""
    extra = "1" if lossless else "CASE WHEN s > 0 THEN 1 ELSE 0 END"
    return f"""
{name} AS (
  SELECT DISTINCT epoch, CAST(1 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS blk
  FROM {rows}
  UNION ALL
  SELECT epoch, rn + 1,
         CASE WHEN n <= {block} - c THEN c + n ELSE (n - greatest({block} - c, 0)) % {block} END,
         CASE WHEN n <= {block} - c THEN blk
              ELSE blk + (n - greatest({block} - c, 0)) // {block} + {extra} END
  FROM (SELECT w.*, r.n, CASE WHEN w.s > 0 THEN w.s + 1 ELSE 0 END AS c
        FROM {name} w JOIN {rows} r ON r.epoch = w.epoch AND r.rn = w.rn))"""


def _pack(name: str, source: str, block: int = BLOCK_SIZE, lossless: bool = True) -> str:
    """CTEs ending in ``name (epoch, block_idx, tokens)`` from ``source (epoch, pos, tokens)``."""
    emits = "1" if lossless else "CASE WHEN c > 0 THEN 1 ELSE 0 END"
    n = name
    tail = f"list_concat(tokens, list_transform(range({block} - len(tokens)), lambda x: {PAD_ID}))"
    return f"""
{n}_r AS MATERIALIZED (
  SELECT epoch, pos, tokens, CAST(len(tokens) AS BIGINT) AS n,
         row_number() OVER (PARTITION BY epoch ORDER BY pos) AS rn FROM {source}),
{_walk(f"{n}_w", f"{n}_r", block, lossless)},
{n}_p AS MATERIALIZED (
  SELECT epoch, tokens, n, s, blk, c, {block} - c AS rem, greatest({block} - c, 0) AS used,
         {emits} AS emits
  FROM (SELECT r.epoch, r.tokens, r.n, w.s, w.blk, CASE WHEN w.s > 0 THEN w.s + 1 ELSE 0 END AS c
        FROM {n}_r r JOIN {n}_w w ON w.epoch = r.epoch AND w.rn = r.rn)),
{n}_t AS MATERIALIZED (
  SELECT epoch, tok, CASE WHEN n <= rem OR j <= used THEN blk
                          ELSE blk + emits + (j - used - 1) // {block} END AS blk,
         CASE WHEN n <= rem OR j <= used THEN c + j - 1 ELSE (j - used - 1) % {block} END AS off
  FROM (SELECT * EXCLUDE (tokens), unnest(tokens) AS tok, unnest(range(1, n + 1)) AS j FROM {n}_p)
  WHERE n <= rem OR j > used OR emits = 1
  UNION ALL
  SELECT epoch, {EOS_ID}, blk, s FROM {n}_p WHERE s > 0 AND s < {block}),
{n} AS MATERIALIZED (
  SELECT epoch, block_idx, {tail} AS tokens FROM (
    SELECT t.epoch, t.blk AS block_idx, list(t.tok ORDER BY t.off) AS tokens FROM {n}_t t
    GROUP BY t.epoch, t.blk))"""


def _packed_corpus(
    name: str, split: str, epochs: tuple[int, ...], block: int = BLOCK_SIZE
) -> str:
    x = f"_{name}"
    return ",".join([
        _mixed(split, epochs, x),
        f"""
{name}_src AS MATERIALIZED (
  SELECT m.epoch, m.pos, e.tokens FROM mixed{x} m JOIN enc e ON e.ord = m.ord)""",
        _pack(name, f"{name}_src", block),
    ])


ENC = _encoded("enc", "f", "ord")
BASE = [DOCS, FITTING, _vocab(), ENC]
WHOLE = [DOCS, ALL, _vocab(), ENC]
IN_ORDER = "src AS MATERIALIZED (SELECT 0 AS epoch, ord AS pos, tokens FROM enc)"
PACKED = [*BASE, IN_ORDER, _pack("b", "src")]


def _csv(column: str) -> str:
    return f"array_to_string({column}, ',')"


def _batches(name: str, blocks: str, size: int, block: int) -> str:
    """CTE ``name (epoch, batch_id, row_in_batch, tokens)``."""
    return f"""
{name} AS MATERIALIZED (
  SELECT epoch, block_idx // {size} AS batch_id, CAST(block_idx % {size} AS INT) AS row_in_batch, tokens
  FROM (SELECT epoch, block_idx, tokens FROM {blocks}
        UNION ALL
        SELECT epoch, unnest(range(n, CAST(ceil(n / CAST({size} AS DOUBLE)) * {size} AS BIGINT))),
               list_transform(range({block}), lambda x: {PAD_ID})
        FROM (SELECT epoch, max(block_idx) + 1 AS n FROM {blocks} GROUP BY epoch)))"""


VAL = [
    *BASE,
    _packed_corpus("v", "val", (0,), q.VAL_BLOCK),
    _batches("vb", "v", q.VAL_BATCH, q.VAL_BLOCK),
]


def _losses(name: str, rows: str, key: str, scores: str = "scores") -> str:
    """CTE ``name (key, pos, token, nll)`` from ``rows (key, tokens)``."""
    return f"""
{name}_t AS MATERIALIZED (
  SELECT {key}, unnest(tokens[2:]) AS token, unnest(range(len(tokens) - 1)) AS pos FROM {rows}),
{name} AS MATERIALIZED (
  SELECT {key}, CAST(pos AS INT) AS pos, token, nll
  FROM {name}_t JOIN {scores} ON id = token)"""


_BATCH_KEY = "batch_id, row_in_batch"
LOSSES = [*VAL, _scores(), _losses("l", "vb", _BATCH_KEY)]
VAL_IN_ORDER = [
    *BASE,
    """src AS MATERIALIZED (
  SELECT 0 AS epoch, e.ord AS pos, e.tokens FROM enc e JOIN d ON d.ord = e.ord AND d.split = 'val')""",
    _pack("o", "src", q.VAL_BLOCK),
    _batches("ob", "o", q.VAL_BATCH, q.VAL_BLOCK),
    _scores(),
    _losses("l", "ob", _BATCH_KEY),
]

# Interpolated trigrams of the training texts, written out order by order: 1 begins and 2
# ends a text, 0.75 is taken off every count, 3 ids are special.
NGRAMS = """
tri AS MATERIALIZED (
  SELECT s[i] AS a, s[i + 1] AS b, s[i + 2] AS c, count(*) AS n
  FROM (SELECT s, unnest(range(1, len(s) - 1)) AS i FROM (
    SELECT [1, 1] || e.tokens || [2] AS s FROM enc e JOIN d ON d.ord = e.ord AND d.split = 'train'))
  GROUP BY ALL),
bi AS MATERIALIZED (SELECT b, c, count(*) AS n FROM tri GROUP BY ALL),
uni AS MATERIALIZED (SELECT c, count(*) AS n FROM bi GROUP BY ALL),
tri_h AS MATERIALIZED (SELECT a, b, sum(n) AS total, 0.75e0 * count(*) / sum(n) AS back FROM tri GROUP BY ALL),
bi_h AS MATERIALIZED (SELECT b, sum(n) AS total, 0.75e0 * count(*) / sum(n) AS back FROM bi GROUP BY ALL),
uni_h AS MATERIALIZED (
  SELECT sum(n) AS total, 0.75e0 * count(*) / sum(n) / (SELECT count(*) + 3 FROM vocab) AS rest FROM uni)"""


def _ngram_losses(name: str, rows: str, key: str) -> str:
    """CTE ``name (key, pos, token, nll)`` from ``rows (key, tokens)``."""
    return f"""
{name}_t AS MATERIALIZED (
  SELECT {key}, pos, tokens[pos + 2] AS c, tokens[pos + 1] AS b, CASE WHEN pos > 0 THEN tokens[pos] END AS a
  FROM (SELECT {key}, tokens, unnest(range(len(tokens) - 1)) AS pos FROM {rows})),
{name}_1 AS MATERIALIZED (
  SELECT t.*, coalesce((u.n - 0.75e0) / h.total, 0) + h.rest AS p1
  FROM {name}_t t CROSS JOIN uni_h h LEFT JOIN uni u ON u.c = t.c),
{name}_2 AS MATERIALIZED (
  SELECT t.*, CASE WHEN h.b IS NULL THEN p1 ELSE coalesce((g.n - 0.75e0) / h.total, 0) + h.back * p1 END AS p2
  FROM {name}_1 t LEFT JOIN bi_h h ON h.b = t.b LEFT JOIN bi g ON g.b = t.b AND g.c = t.c),
{name} AS MATERIALIZED (
  SELECT {key}, CAST(pos AS INT) AS pos, t.c AS token,
    -ln(CASE WHEN h.b IS NULL THEN p2 ELSE coalesce((g.n - 0.75e0) / h.total, 0) + h.back * p2 END) AS nll
  FROM {name}_2 t LEFT JOIN tri_h h ON h.a = t.a AND h.b = t.b LEFT JOIN tri g ON g.a = t.a AND g.b = t.b AND g.c = t.c)"""


def _turn(i: int) -> str:
    """One round of the keyed permutation: the hash of a digit is added to the other."""
    key = "concat_ws(':', 7, epoch, {i}, {other})"
    if i % 2 == 0:
        return f"(l{i} + {_hex32(key.format(i=i, other=f'r{i}'), 1)}) % a AS l{i + 1}, r{i} AS r{i + 1}"
    return f"l{i} AS l{i + 1}, (r{i} + {_hex32(key.format(i=i, other=f'l{i}'), 1)}) % b AS r{i + 1}"


def _rounds(rows: str) -> str:
    """``(epoch, block_idx, n, a, b, x)`` of ``rows`` with ``x`` sent through six rounds."""
    inner = f"(SELECT *, x // b AS l0, x % b AS r0 FROM {rows})"
    for i in range(6):
        inner = f"(SELECT *, {_turn(i)} FROM {inner})"
    return f"SELECT epoch, block_idx, n, a, b, l6 * b + r6 AS x FROM {inner}"


# Blocks in the order of a keyed permutation: numbers outside are sent through again.
SHUFFLED = f"""
sized AS MATERIALIZED (
  SELECT epoch, block_idx, n, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b,
    block_idx AS x FROM t JOIN (SELECT epoch, max(block_idx) + 1 AS n FROM t GROUP BY epoch) e USING (epoch)),
sent AS ({_rounds("sized")} UNION ALL {_rounds("(SELECT * FROM sent WHERE x >= n)")}),
placed AS (SELECT epoch, block_idx, n, x AS place FROM sent WHERE x < n),
turns AS (
  SELECT epoch, block_idx, unnest(range(place, CAST(ceil(n / 3e0) * 3 AS BIGINT), n)) AS turn FROM placed)"""


# Decode, encode with the second rule, cut and pad to the longest row of the batch.
RETOKENIZED = [
    *VAL,
    _vocab("vocab2", _spaces),
    f"""
back_t AS MATERIALIZED (
  SELECT batch_id, row_in_batch, unnest(tokens) AS id, unnest(range(len(tokens))) AS j FROM vb),
back AS MATERIALIZED (
  SELECT k.batch_id, k.row_in_batch, coalesce(x.text, '') AS text FROM vb k LEFT JOIN (
    SELECT batch_id, row_in_batch, string_agg(token, ' ' ORDER BY j) AS text
    FROM back_t JOIN vocab USING (id) GROUP BY ALL) x USING (batch_id, row_in_batch))""",
    _encoded("enc2", "back", _BATCH_KEY, "vocab2", _spaces),
    f"""
cut AS MATERIALIZED (
  SELECT batch_id, row_in_batch, tokens[:{q.VAL_BLOCK}] AS ids FROM enc2),
padded AS MATERIALIZED (
  SELECT batch_id, row_in_batch,
         list_concat(ids, list_transform(range(m - len(ids)), lambda x: {PAD_ID})) AS tokens,
         list_concat(list_transform(ids, lambda x: 1),
                     list_transform(range(m - len(ids)), lambda x: 0)) AS mask
  FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM cut))""",
]

ITEM_ROWS = f"""
items AS MATERIALIZED (
  SELECT h.item_id, h.ctx, CAST(h.item_id % {CHOICES} AS VARCHAR) AS label,
         list(e.ending ORDER BY (h.item_id + s.shift) % {CHOICES}) AS endings
  FROM (SELECT item_id, left(text, length(text) // 2) AS ctx FROM benchmark) h,
       (SELECT unnest(range({CHOICES})) AS shift) s,
       (SELECT item_id, substr(text, length(text) // 2 + 1) AS ending FROM benchmark) e
  WHERE e.item_id = (h.item_id + s.shift) % (SELECT count(*) FROM benchmark)
  GROUP BY h.item_id, h.ctx)"""
CHOICE = [
    *BASE,
    _scores(),
    ITEM_ROWS,
    f"""
ct AS MATERIALIZED (
  SELECT item_id, CAST(label AS INT) AS label, choice, ctx || ' ' || ending AS text FROM (
    SELECT item_id, ctx, label, unnest(endings) AS ending,
           CAST(unnest(range({CHOICES})) AS INT) AS choice FROM items))""",
    _encoded("ce", "ct", "item_id, label, choice"),
    f"cb AS MATERIALIZED (SELECT * REPLACE (list_prepend({BOS_ID}, tokens) AS tokens) FROM ce)",
    _losses("cl", "cb", "item_id, label, choice"),
    """
scored AS MATERIALIZED (
  SELECT item_id, label, choice, -avg(nll) AS score FROM cl GROUP BY ALL)""",
    """
predicted AS MATERIALIZED (
  SELECT item_id, label, choice AS pred FROM scored
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, choice) = 1)""",
]


# Duplicates


def _xor_shift(value: str, bits: int) -> str:
    return f"xor({value}, {value} >> {bits})"


_MASK = (1 << 32) - 1
_LEADS = range(SHINGLE_CHARS)
_POLY = " + ".join(
    f"c{j} * {pow(SHINGLE_BASE, SHINGLE_CHARS - 1 - j, 1 << 32)}" for j in _LEADS
)
_FOLLOWING = ", ".join(
    f"lead(CAST(unicode(c) AS UBIGINT), {j}) OVER w AS c{j}, lead(c, {j}) OVER w AS s{j}"
    for j in _LEADS
)
SHINGLES = f"""
nrm AS MATERIALIZED (SELECT doc_id, {_normal("text")} AS text FROM f),
chars AS MATERIALIZED (
  SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM nrm
  WHERE text <> ''),
grams AS MATERIALIZED (
  SELECT * FROM (SELECT doc_id, {_FOLLOWING} FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  WHERE c{SHINGLE_CHARS - 1} IS NOT NULL),
sh1 AS (SELECT doc_id, {" || ".join(f"s{j}" for j in _LEADS)} AS g, ({_POLY}) & {_MASK} AS h FROM grams),
sh2 AS (SELECT doc_id, g, ({_xor_shift("h", 16)} * {MIX_1}) & {_MASK} AS h FROM sh1),
sh3 AS (SELECT doc_id, g, ({_xor_shift("h", 13)} * {MIX_2}) & {_MASK} AS h FROM sh2),
sh AS MATERIALIZED (SELECT doc_id, g, {_xor_shift("h", 16)} AS h FROM sh3)"""


def _signature_sql() -> str:
    # Odd multipliers, then offsets, from the high halves of a 64-bit recurrence.
    state, values = 2654435769, []
    for _ in range(2 * NUM_PERM):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        values.append(state >> 32)
    a, b = [v | 1 for v in values[:NUM_PERM]], values[NUM_PERM:]
    minima = ",\n".join(
        f"min((h * {a[i]} + {b[i]}) & {_MASK})" for i in range(NUM_PERM)
    )
    return f"""
sig0 AS MATERIALIZED (
  SELECT doc_id, [{minima}] AS sig
  FROM (SELECT DISTINCT doc_id, h FROM sh) GROUP BY doc_id),
sig AS MATERIALIZED (
  SELECT nrm.doc_id,
         coalesce(sig0.sig, list_transform(range({NUM_PERM}), lambda x: {_MASK})) AS sig
  FROM nrm LEFT JOIN sig0 USING (doc_id))"""


BAND_ROWS = f"""
bands AS MATERIALIZED (
  SELECT doc_id, CAST(band AS INT) AS band,
         md5(array_to_string(sig[band * {_ROWS} + 1:(band + 1) * {_ROWS}], ',')) AS key
  FROM sig, range({_BANDS}) t(band))"""
SIGNED = [DOCS, FITTING, SHINGLES, _signature_sql()]
FIRSTS = f"""
firsts AS MATERIALIZED (
  SELECT sha256({_normal("text")}) AS digest, min(doc_id) AS doc_id FROM f GROUP BY 1)"""
# The greedy rule, one document per step, over a list of the band keys indexed so far.
# Documents that share no band with any other are kept whatever happens; leaving them
# out of the walk changes nothing for the others.
GREEDY = [
    *SIGNED,
    BAND_ROWS,
    FIRSTS,
    """
ub AS MATERIALIZED (
  SELECT doc_id, band || ':' || key AS bk FROM bands WHERE doc_id IN (SELECT doc_id FROM firsts)),
crowded AS MATERIALIZED (
  SELECT doc_id, bk FROM ub WHERE bk IN (SELECT bk FROM ub GROUP BY bk HAVING count(*) > 1)),
turn AS MATERIALIZED (
  SELECT doc_id, list(bk) AS bks, row_number() OVER (ORDER BY doc_id) AS rn
  FROM crowded GROUP BY doc_id),
walk AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS doc_id, FALSE AS keep,
         CAST([] AS VARCHAR[]) AS indexed
  UNION ALL
  SELECT t.rn, t.doc_id, NOT list_has_any(w.indexed, t.bks),
         CASE WHEN list_has_any(w.indexed, t.bks) THEN w.indexed
              ELSE list_concat(w.indexed, t.bks) END
  FROM walk w JOIN turn t ON t.rn = w.rn + 1),
dropped AS MATERIALIZED (SELECT doc_id FROM walk WHERE NOT keep AND rn > 0),
labels AS MATERIALIZED (
  SELECT f.doc_id, CASE WHEN u.doc_id IS NULL THEN 'exact_dup'
                        WHEN n.doc_id IS NOT NULL THEN 'near_dup' ELSE 'kept' END AS label
  FROM f LEFT JOIN firsts u USING (doc_id) LEFT JOIN dropped n USING (doc_id))""",
]


# Logs

# Fixed values of the training schedule.
_EVERY, _VALIDATE, _SAVE = 10, 1000, 3000
_STEP_BLOCKS, _PASSES = 6 * 192, 15000 * 192
_PEAK, _FLOOR, _WARMUP, _LAST = 6e-4, 6e-5, 700, 15000
_PER_LOG = _EVERY * _STEP_BLOCKS * 1024
LOG = """lg AS MATERIALIZED (
  SELECT user_id AS run_id, event_id, ts, value AS loss,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)"""
_SMOOTH = 0.9


ORACLES: dict[str, str] = {
    "scan_split_corpus": f"""
        SELECT doc_id, source, CAST(length(text) AS INT) AS chars FROM documents
        WHERE {_split("text")} = 'train'""",
    "scan_partition_dir": """
        SELECT doc_id, source, CAST(length(text) AS INT) AS chars FROM documents WHERE lang = 'en'""",
    "resolve_text_column": _with(DOCS) + """
        SELECT doc_id, source, text FROM d""",
    "load_mixed_corpora": _with(DOCS) + """
        SELECT source, ord, text FROM (
          SELECT source, text, split, CASE WHEN source IN ('web', 'books')
            THEN row_number() OVER (PARTITION BY source ORDER BY ord) - 1 ELSE ord END AS ord FROM d)
        WHERE split = 'train'""",
    "text_fallback": """
        SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 2) THEN text
                            WHEN doc_id % 5 = 3 THEN '# ' || text ELSE '' END AS text
        FROM documents""",
    "peek_first": _with(DOCS) + "SELECT doc_id, source, text FROM d ORDER BY doc_id LIMIT 1",
    "eval_items": _with(ITEM_ROWS) + """
        SELECT item_id, ctx, array_to_string(endings, '|') AS endings, label FROM items
        ORDER BY item_id LIMIT 25""",
    "log_sink_roundtrip": _with(LOG) + "SELECT run_id, step, loss FROM lg",
    "validation_log": _with(LOG) + """
        SELECT run_id, count(*) AS validations, min(loss) AS best_loss,
               arg_min(step, (loss, step)) AS best_step
        FROM (SELECT run_id, step, round(loss, 4) AS loss FROM lg WHERE step % 5 = 0) GROUP BY run_id""",
    "packed_sink": _with(
        *BASE, _packed_corpus("t", "train", (0, 1)), _packed_corpus("v", "val", (0,)), recursive=True
    ) + """
        SELECT split, epoch, count(*) AS blocks, max(block_idx) AS last_block,
               CAST(sum(list_sum(tokens)) AS BIGINT) AS id_sum
        FROM (SELECT 'train' AS split, * FROM t UNION ALL SELECT 'val', * FROM v)
        GROUP BY split, epoch""",
    "batch_preview": _with(
        *BASE, _packed_corpus("t", "train", (0,)), _batches("bt", "t", q.BATCH, BLOCK_SIZE),
        recursive=True,
    ) + f"""
        SELECT epoch, count(*) AS rows, CAST(max(len(tokens)) AS INT) AS columns,
               max(CASE WHEN row_in_batch = 0 THEN {_csv("tokens[:50]")} END) AS head
        FROM bt WHERE batch_id = 0 GROUP BY epoch""",
    "text_corpus": _with(DOCS, _mixed("train", (0,))) + """
        SELECT m.epoch, m.pos, m.source, d.doc_id, d.text FROM mixed m JOIN d USING (ord)
        WHERE d.fits""",
    "hash_split": f"""
        SELECT doc_id, {_bucket("text")} AS bucket, {_split("text")} AS split FROM documents""",
    "split_counts": _with(DOCS) + """
        SELECT split, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM d
        WHERE fits GROUP BY split""",
    "length_filter": _with(DOCS) + "SELECT doc_id, CAST(length(text) AS INT) AS chars FROM d WHERE fits",
    "take_n_stream": _with(DOCS, _mixed("train", q.EPOCHS)) + f"""
        SELECT * FROM (
          SELECT row_number() OVER (ORDER BY m.epoch, m.pos) - 1 AS idx, m.epoch, m.pos, d.doc_id
          FROM mixed m JOIN d USING (ord) WHERE d.fits) WHERE idx < 300""",
    "val_prefix": _with(*VAL, recursive=True) + f"""
        SELECT batch_id, row_in_batch, {_csv("tokens")} AS tokens FROM vb
        WHERE epoch = 0 AND batch_id < 10""",
    "weighted_interleave": _with(
        DOCS, _ranked("train", (0,)),
        _interleave("w", "ranked", q.FLAT_WEIGHTS, SPLIT_SEEDS["train"], (0,)),
    ) + """
        SELECT w.pos, w.source, r.ord AS doc_id FROM w
        JOIN ranked r ON r.source = w.source AND r.k = w.k""",
    "mix_shares": _with(
        DOCS, _ranked("train", (0,)),
        _interleave("w", "ranked", q.FLAT_WEIGHTS, SPLIT_SEEDS["train"], (0,)),
    ) + "SELECT source, count(*) AS docs, max(pos) AS last_pos FROM w GROUP BY source",
    "nested_interleave": _with(DOCS, _mixed("train", (0,))) + """
        SELECT pos, source, ord AS doc_id FROM mixed""",
    "epoch_mix": _with(DOCS, _mixed("train", q.EPOCHS)) + """
        SELECT epoch, pos, source, ord AS doc_id FROM mixed""",
    "resume_epoch": _with(*BASE, _packed_corpus("t", "train", (2,)), recursive=True) + f"""
        SELECT epoch, block_idx, {_csv("tokens")} AS tokens FROM t""",
    "normalize_text": f"SELECT doc_id, {_normal('text')} AS text FROM documents",
    "text_digest": f"SELECT doc_id, sha256({_normal('text')}) AS digest FROM documents",
    "char_shingles": _with(DOCS, ALL, SHINGLES) + """
        SELECT nrm.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, 0) AS n_distinct,
               CAST(least_hash AS BIGINT) AS min_hash
        FROM nrm LEFT JOIN (
          SELECT doc_id, count(*) AS n, count(DISTINCT g) AS m, min(h) AS least_hash
          FROM sh GROUP BY doc_id) USING (doc_id)""",
    "minhash_signature": _with(DOCS, ALL, *SIGNED[2:]) + f"SELECT doc_id, {_csv('sig')} AS sig FROM sig",
    "lsh_bands": _with(DOCS, ALL, *SIGNED[2:], BAND_ROWS) + "SELECT doc_id, band, key FROM bands",
    "build_vocab": _with(DOCS, _vocab()) + "SELECT token, id, n FROM vocab",
    "tokenize": _with(*WHOLE) + f"""
        SELECT ord AS doc_id, CAST(len(tokens) AS INT) AS n, {_csv("tokens")} AS tokens FROM enc""",
    "detokenize": _with(*WHOLE) + """
        SELECT f.doc_id, coalesce(x.text, '') AS text FROM f LEFT JOIN (
          SELECT ord, string_agg(token, ' ' ORDER BY j) AS text
          FROM enc_t JOIN vocab USING (token) GROUP BY ord) x USING (ord)""",
    "subword_detokenize": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "crop_context": _with(*WHOLE) + f"""
        SELECT ord AS doc_id, {_csv(f"tokens[-{q.CONTEXT}:]")} AS tokens FROM enc""",
    "retokenize_padded": _with(*RETOKENIZED, recursive=True) + f"""
        SELECT batch_id, row_in_batch, {_csv("tokens")} AS ids, {_csv("mask")} AS mask FROM padded""",
    "exact_dedup": _with(DOCS, FITTING, FIRSTS) + "SELECT digest, doc_id FROM firsts",
    "dense_ids": _with(DOCS, FITTING, FIRSTS) + """
        SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS dense_id FROM firsts""",
    "near_dedup": _with(*GREEDY, recursive=True) + "SELECT doc_id, label FROM labels",
    "dedup_report": _with(*GREEDY, recursive=True) + """
        SELECT count(*) FILTER (label <> 'exact_dup') AS exact_unique,
               count(*) FILTER (label = 'near_dup') AS near_dups FROM labels""",
    "lsh_candidates": _with(*GREEDY, recursive=True) + """
        SELECT DISTINCT a.doc_id, b.doc_id AS candidate FROM crowded a
        JOIN crowded b ON a.bk = b.bk AND b.doc_id < a.doc_id
        JOIN labels l ON l.doc_id = b.doc_id AND l.label = 'kept'""",
    "incremental_dedup": _with(*GREEDY, recursive=True) + "SELECT doc_id, label FROM labels",
    "pack_sequences": _with(*PACKED, recursive=True) + f"""
        SELECT block_idx, {_csv("tokens")} AS tokens FROM b""",
    "pack_sequences_lossy": _with(
        *BASE, IN_ORDER, _pack("b", "src", 64, lossless=False), recursive=True
    ) + f"SELECT block_idx, {_csv('tokens')} AS tokens FROM b",
    "pack_layout": _with(
        DOCS, ALL,
        f"""src AS MATERIALIZED (
          SELECT 0 AS epoch, ord AS pos,
                 list_transform({_words("text")}, lambda x: {FIRST_WORD_ID}) AS tokens FROM f)""",
        _pack("b", "src"),
        recursive=True,
    ) + f"""
        SELECT blk AS block_idx, count(*) FILTER (tok <> {EOS_ID}) AS n_tokens,
               count(*) FILTER (tok = {EOS_ID}) AS n_eos, {BLOCK_SIZE} - count(*) AS n_pad
        FROM b_t GROUP BY blk""",
    "packed_corpus": _with(*BASE, _packed_corpus("t", "train", (0, 1)), recursive=True) + f"""
        SELECT epoch, block_idx, {_csv("tokens")} AS tokens FROM t""",
    "batch_blocks": _with(*PACKED, _batches("bt", "b", q.BATCH, BLOCK_SIZE), recursive=True) + f"""
        SELECT batch_id, row_in_batch, {_csv("tokens")} AS tokens FROM bt""",
    "shift_targets": _with(*PACKED, recursive=True) + f"""
        SELECT block_idx, {_csv("tokens[:-2]")} AS x, {_csv("tokens[2:]")} AS y FROM b""",
    "target_counts": _with(*PACKED, recursive=True) + f"""
        SELECT block_idx, CAST(len(tokens) - 1 AS INT) AS targets,
               CAST(len(list_filter(tokens[2:], lambda t: t <> {PAD_ID})) AS INT) AS counted FROM b""",
    "shard_blocks": _with(*PACKED, recursive=True) + f"""
        SELECT CAST(place % {q.WORLD_SIZE} AS INT) AS rank, place // {q.WORLD_SIZE} AS slot,
               b.block_idx, {_csv("tokens")} AS tokens
        FROM (SELECT unnest(range(CAST(ceil(n / CAST({q.WORLD_SIZE} AS DOUBLE)) * {q.WORLD_SIZE}
                                       AS BIGINT))) AS place, n
              FROM (SELECT max(block_idx) + 1 AS n FROM b)) p
        JOIN b ON b.block_idx = p.place % p.n""",
    "packed_range": _with(*BASE, _packed_corpus("t", "train", (0, 1)), recursive=True) + f"""
        SELECT block_idx, {_csv("tokens")} AS tokens
        FROM (SELECT *, max(block_idx) OVER () AS last FROM t WHERE epoch = 1)
        WHERE block_idx >= last // 4 AND block_idx < last // 2 AND block_idx % 3 = 1""",
    "shuffled_shards": _with(*BASE, _packed_corpus("t", "train", (0, 1)), SHUFFLED, recursive=True) + f"""
        SELECT u.epoch, CAST(turn % 3 AS INT) AS rank, turn // 3 AS slot, u.block_idx, {_csv("tokens")} AS tokens
        FROM turns u JOIN t ON t.epoch = u.epoch AND t.block_idx = u.block_idx""",
    "token_budget": _with(*PACKED, recursive=True) + f"""
        SELECT epoch, count(*) AS blocks, count(*) * 1024 AS tokens,
               CAST({_PER_LOG} AS BIGINT) AS tokens_per_log,
               CAST({_PASSES} AS BIGINT) AS micro_steps,
               round(count(*) / CAST({_STEP_BLOCKS} AS DOUBLE), 6)
                 AS optimizer_steps
        FROM b GROUP BY epoch""",
    "token_nll": _with(*VAL_IN_ORDER, recursive=True) + """
        SELECT batch_id, row_in_batch, pos, token, round(nll, 6) AS nll FROM l""",
    "seq_mean_nll": _with(*VAL_IN_ORDER, recursive=True) + f"""
        SELECT batch_id, row_in_batch, round(avg(nll), 6) AS with_pad,
               round(avg(nll) FILTER (token <> {PAD_ID}), 6) AS without_pad
        FROM l GROUP BY batch_id, row_in_batch""",
    "val_loss": _with(*LOSSES, recursive=True) + f"""
        SELECT round(avg(m), 6) AS val_loss, count(*) AS batches FROM (
          SELECT batch_id, avg(nll) AS m FROM l GROUP BY batch_id)""",
    "ngram_token_nll": _with(*VAL_IN_ORDER, NGRAMS, _ngram_losses("g", "ob", _BATCH_KEY), recursive=True) + """
        SELECT batch_id, row_in_batch, pos, token, round(nll, 6) AS nll FROM g""",
    "ngram_val_loss": _with(*VAL, NGRAMS, _ngram_losses("g", "vb", _BATCH_KEY), recursive=True) + """
        SELECT round(avg(m), 6) AS val_loss, count(*) AS batches FROM (
          SELECT batch_id, avg(nll) AS m FROM g GROUP BY batch_id)""",
    "val_loss_compare": _with(
        *RETOKENIZED, _scores(), _losses("l", "vb", _BATCH_KEY), _scores("scores2", "vocab2"),
        _losses("l2", "padded", _BATCH_KEY, "scores2"), recursive=True,
    ) + f"""
        SELECT 'own' AS scorer, round(avg(m), 6) AS val_loss, count(*) AS batches FROM (
          SELECT batch_id, avg(nll) AS m FROM l GROUP BY batch_id)
        UNION ALL
        SELECT 'baseline', round(avg(m), 6), count(*) FROM (
          SELECT batch_id, avg(nll) AS m FROM l2
          WHERE token <> {PAD_ID} GROUP BY batch_id)""",
    "choice_scores": _with(*CHOICE) + """
        SELECT item_id, label, choice, round(score, 6) AS score FROM scored""",
    "choice_plugged_in": _with(ITEM_ROWS) + f"""
        SELECT item_id, CAST(label AS INT) AS label, choice AS pred FROM (
          SELECT item_id, label, choice, -list_avg(list_transform(string_split(ctx || ' ' || ending, ''),
            lambda c: ln(ascii(c) % 97 + 3))) AS score
          FROM (SELECT item_id, ctx, label, unnest(endings) AS ending,
                       CAST(unnest(range({CHOICES})) AS INT) AS choice FROM items))
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, choice) = 1""",
    "choice_predict": _with(*CHOICE) + "SELECT item_id, label, pred FROM predicted",
    "choice_accuracy": _with(*CHOICE) + """
        SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
               count(*) AS items FROM predicted""",
    "log_every_n": _with(LOG) + f"""
        SELECT run_id, step, loss, step % {_VALIDATE} = 0 AS validates,
               step % {_SAVE} = 0 AS saves
        FROM lg WHERE step % {_EVERY} = 0""",
    "loss_ema": _with(LOG) + f"""
        SELECT a.run_id, a.step, any_value(a.loss) AS loss,
               round(sum(pow({_SMOOTH}, a.step - b.step) * b.loss)
                     / sum(pow({_SMOOTH}, a.step - b.step)), 6) AS smoothed
        FROM lg a JOIN lg b ON a.run_id = b.run_id AND b.step <= a.step
        GROUP BY a.run_id, a.step""",
    "throughput": _with(LOG) + f"""
        SELECT run_id, step, round(sec, 6) AS seconds,
               round(CASE WHEN sec > 0 THEN {_PER_LOG} / sec END, 3) AS tokens_per_sec
        FROM (SELECT run_id, step,
                     (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run_id ORDER BY step)))
                       / 1e6 AS sec
              FROM lg WHERE step % {_EVERY} = 0)""",
    "best_so_far": _with(LOG) + """
        SELECT run_id, step, loss, best_before, loss < coalesce(best_before, CAST('inf' AS DOUBLE)) AS is_best
        FROM (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before
              FROM lg)""",
    "lr_schedule": f"""
        SELECT user_id AS run_id, event_id AS step, round(CASE
          WHEN event_id < {_WARMUP}
            THEN CAST({_PEAK} AS DOUBLE) * (event_id + 1) / {_WARMUP}
          WHEN event_id > {_LAST} THEN CAST({_FLOOR} AS DOUBLE)
          ELSE CAST({_FLOOR} AS DOUBLE) + 0.5 * (1 + cos({math.pi!r} *
               ((event_id - {_WARMUP}) / CAST({_LAST - _WARMUP} AS DOUBLE))))
               * (CAST({_PEAK} AS DOUBLE) - CAST({_FLOOR} AS DOUBLE)) END, 9) AS lr
        FROM events""",
    "stream_split_filter": _with(DOCS) + """
        SELECT doc_id, split, CAST(length(text) AS INT) AS chars FROM d WHERE fits""",
    "stream_exact_dedup": _with(DOCS, FITTING, FIRSTS) + """
        SELECT f.doc_id, CASE WHEN u.doc_id IS NULL THEN 'exact_dup' ELSE 'kept' END AS label
        FROM f LEFT JOIN firsts u USING (doc_id)""",
    "stream_near_dedup": _with(*GREEDY, recursive=True) + "SELECT doc_id, label FROM labels",
    "stream_distinct_texts": _with(DOCS, FITTING, FIRSTS) + "SELECT digest FROM firsts",
    "stream_pack": _with(
        *BASE,
        """src AS MATERIALIZED (
          SELECT ord % 4 AS epoch, ord AS pos, tokens FROM enc)""",
        _pack("b", "src"),
        recursive=True,
    ) + f"SELECT CAST(epoch AS INT) AS shard, block_idx, {_csv('tokens')} AS tokens FROM b",
}
