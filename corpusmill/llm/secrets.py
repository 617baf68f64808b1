"""Secrets: sure ones by form, weak parts only where complementary parts stand together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.spans import Kind, find_spans, kind_rank, span_text

# The look-aheads at the first letter only make a search skip faster.
_ASSIGN = (
    r"""(?=[PSTApsta])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# The lengths of access and hex stand in the pattern: a run that is too short holds no
# later start that is long enough, so this drops what a test afterwards would drop.
BASE = (
    Kind("assign", _ASSIGN, valid=lambda v: F.length(F.regexp_extract(v, _ASSIGN, 1)) >= 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Kind("hex", r"[0-9a-f]{24,}"),
)
#: Weak parts: none of them is a secret on its own.
PARTS = (
    Kind(
        "identifier",
        r"""(?=[ULCAulca])(?i:user_?name|login|client_?id|account_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]+""",
    ),
    Kind(
        "keylike",
        r"[A-Za-z0-9+/_=-]{16,}",
        valid=lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]"),
    ),
    Kind(
        "endpoint",
        r"""(?:https?|wss?|jdbc:[a-z]+|s3|ftp|postgres|mysql|mongodb)://[A-Za-z0-9._:/@?&=%-]+""",
        needs="://",
    ),
)
BASE_NAMES = tuple(k.name for k in BASE)
NAMES = BASE_NAMES + tuple(k.name for k in PARTS)
#: Roles that a span can play in a credential.
ROLES = {
    "id": ("access", "identifier"),
    "secret": ("assign", "hex", "keylike"),
    "endpoint": ("endpoint",),
}
#: A weak part is reported when a part of one of these roles stands in its scope.
NEEDS = {"identifier": ("secret",), "keylike": ("id", "endpoint"), "endpoint": ("secret",)}
SCOPE = 160  # code points from the end of one part to the start of another of one scope


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``(_row, doc_id, kind, start, end, value, linked)`` of sure and linked secrets.

    The interval join of parts counts: near a part are those that start within ``scope``
    behind its end and those that end within ``scope`` before its start. Both counts are
    range frames over the starts and ends of one text's parts, so parts of any length are
    near what adjoins them, and no pairs are formed. A part that overlaps another is no
    complement of it: one link is not both an endpoint and its own key. Sure kinds always stay; ``linked`` counts
    the complementary parts. Null text counts as empty; every input row, repeated ones
    included, keeps at least one row (null ``kind``).
    """
    order = Window.partitionBy("_row").orderBy("_at")
    behind, before = order.rangeBetween(0, scope), order.rangeBetween(-scope, 0)
    ends = find_spans(docs, (*BASE, *PARTS)).select(
        "_row", "doc_id", "kind", "start", "end", "value", F.posexplode(F.array("start", "end")).alias("_is_end", "_at")
    )
    is_end, is_start = F.col("_is_end") == 1, F.col("_is_end") == 0
    near = {}
    for role, kinds in ROLES.items():
        of_role = F.col("kind").isin(*kinds)
        ends = ends.withColumn(
            f"_{role}",
            F.when(is_end, F.count_if(of_role & is_start).over(behind)).otherwise(
                F.count_if(of_role & is_end).over(before)
            ),
        )
        near[role] = F.sum(f"_{role}").alias(f"_{role}")
    spans = ends.groupBy("_row", "doc_id", "kind", "start", "end", "value").agg(*near.values())
    linked = F.lit(None).cast("long")
    for kind, roles in NEEDS.items():
        total = sum((F.col(f"_{r}") for r in roles), F.lit(0))
        linked = F.when(F.col("kind") == kind, total).otherwise(linked)
    spans = spans.withColumn("linked", linked)
    keep = F.col("kind").isin(*BASE_NAMES) | (F.col("linked") > 0)
    only = lambda c: F.when(keep, F.col(c)).alias(c)
    return spans.select("_row", "doc_id", *[only(c) for c in ("kind", "start", "end", "value", "linked")])


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: counts of the sure kinds, their digest, and all spans."""
    entry = F.struct("start", kind_rank(NAMES).alias("rank"), "end", "kind")
    report = (
        secret_spans(docs, scope)
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
    )
