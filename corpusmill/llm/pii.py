"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.spans import Kind, find_spans, kind_rank, span_text



def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _each(text: Column) -> Column:
    """Positions of a text's characters, from 1; empty for an empty text."""
    return F.filter(F.sequence(F.lit(0), F.length(text)), lambda i: i > 0)


def luhn(value: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    mirrored = F.reverse(_digits(value))
    weighted = F.transform(
        _each(mirrored), lambda i: F.substring(mirrored, i, F.lit(1)).cast("int") * (2 - i % 2)
    )
    total = F.aggregate(weighted, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes: moved, letters as 10 to 35, remainder 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))
    codes = F.transform(_each(moved), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))
    rest = F.aggregate(
        codes,
        F.lit(0),
        lambda a, c: F.when(c < 58, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97,
    )
    return (rest == 1) & F.length(plain).between(15, 34)


def _octets(value: Column) -> Column:
    plain = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda p: (F.length(plain(p)) <= 3) & (
        F.concat(F.lit("0"), F.left(plain(p), F.lit(4))).cast("int") <= 255
    )
    return F.forall(F.split(value, "[.]"), small)


def _ssn(value: Column) -> Column:
    parts = r"^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6(?:[0-57-9][0-9]|6[0-57-9]))-(?:0[1-9]|[1-9][0-9])-"
    return value.rlike(parts + "[0-9]{4}$") & ~F.endswith(value, F.lit("0000"))


#: Length of an account number by country, as its register says.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
#: A country, two digits and as many more places as its length says, single blanks between.
#: The look-ahead changes no match: it spares other places a try of every country.
IBAN = "(?=[A-Z]{2}[0-9]{2})(?:%s)" % "|".join(
    f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{length - 4}}}"
    for length, countries in IBAN_LENGTHS.items()
)

# Possessive loops and the look-behinds change no match: they keep Java's matcher from
# recursing on long runs and from retrying inside a run that has failed from its start.
BASE = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        needs="@",
    ),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", valid=_octets),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9]){15,}+",
        valid=lambda v: (F.length(_digits(v)) <= 19) & luhn(v),
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        needs="+",
        valid=lambda v: F.length(_digits(v)).between(8, 15),
    ),
)
EXTRA = (
    Kind("iban", IBAN, valid=mod97),
    Kind("ssn", r"[0-9-]{11,}", needs="-", valid=_ssn),  # a whole run, so nothing is cut out of a longer number
)
BASE_NAMES = tuple(k.name for k in BASE)
NAMES = BASE_NAMES + tuple(k.name for k in EXTRA)
#: Score in percent of a confirmed span, before its context is seen.
SCORES = {"email": 80, "ip": 50, "card": 70, "phone": 60, "iban": 90, "ssn": 40}
#: Words that make a kind likelier when they stand near, and what they add.
CONTEXT = {
    "email": "mail|contact|correo|kontakt",
    "ip": "ip|addr|host|server|login",
    "card": "card|visa|credit|carte|tarjeta|karte",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|konto|account|compte|cuenta",
    "ssn": "ssn|social|security",
}
BONUS = 20
#: Context that speaks against: version numbers, serial numbers, examples.
AGAINST, MALUS = "version|build|serial|example", 20
MIN_SCORE = 50  # of the kinds beyond the base ones


def _score() -> Column:
    near = F.lower(F.concat_ws(" ", "before", "after"))
    malus = F.when(near.rlike(AGAINST), MALUS).otherwise(0)
    score = F.lit(None).cast("int")
    for name in NAMES:
        bonus = F.when(near.rlike(CONTEXT[name]), BONUS).otherwise(0)
        score = F.when(F.col("kind") == name, F.least(F.lit(100), SCORES[name] + bonus - malus)).otherwise(score)
    return score


def pii_spans(docs: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """``(_row, doc_id, kind, start, end, value, score)`` of all personal data found.

    The checksum and range rules decide whether a proposed span is real; the score says
    how sure that is after looking at the words around it. Spans of the base kinds stay
    whatever their score, the others from ``min_score`` on. Null text counts as empty;
    every input row, repeated ones included, keeps at least one row (null ``kind``).
    """
    spans = find_spans(docs, (*BASE, *EXTRA)).withColumn("score", _score())
    keep = F.col("kind").isin(*BASE_NAMES) | (F.col("score") >= min_score)
    only = lambda c: F.when(keep, F.col(c)).alias(c)
    return spans.select("_row", "doc_id", *[only(c) for c in ("kind", "start", "end", "value", "score")])


def pii_report(docs: DataFrame, min_score: int = MIN_SCORE) -> DataFrame:
    """One row per input row: counts of the base kinds, their digest, all spans and scores."""
    entry = F.struct(kind_rank(NAMES).alias("rank"), "start", "end", "kind", "score")
    report = (
        pii_spans(docs, min_score)
        .groupBy("_row", "doc_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), entry))).alias("found"))
    )
    base = F.filter("found", lambda s: s["rank"] <= len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return report.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_NAMES],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
