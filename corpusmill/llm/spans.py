"""Positions of pattern matches in whole texts, with DataFrame functions alone.

Spark returns the matches of a pattern and the pieces between them, but no positions.
Matches and pieces of one text alternate, so a match starts where the pieces up to it
and the matches before it end: a running sum per text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = 48  # code points kept before a match as context
AFTER = 24  # and after it

_HIT = (
    "array<struct<kind: string, i: int, gap: int, before: string, head: string, value: string>>"
)


@dataclass(frozen=True)
class Kind:
    """A kind of span: its Java pattern (never matching the empty string) and a validator.

    The validator is a condition on the matched text.
    """

    name: str
    pattern: str
    needs: str = ""  # a text every match holds; others are not searched
    valid: Callable[[Column], Column] = lambda value: F.lit(True)


def _hits(text: Column, kind: Kind) -> Column:
    """One entry per match, and a last one for the piece after the last match.

    The cheap test comes first, so texts without a match are searched once.
    """
    pattern = F.lit(kind.pattern)
    zipped = F.arrays_zip(
        F.split(text, kind.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    )
    entries = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind.name).alias("kind"),
            i.alias("i"),
            F.length(x["0"]).alias("gap"),
            F.right(x["0"], F.lit(BEFORE)).alias("before"),
            F.left(x["0"], F.lit(AFTER)).alias("head"),
            x["1"].alias("value"),
        ),
    )
    likely = text.rlike(kind.pattern)
    if kind.needs:
        likely = F.contains(text, F.lit(kind.needs)) & likely
    return F.when(likely, entries).otherwise(F.array().cast(_HIT))


def find_spans(
    docs: DataFrame, kinds: Sequence[Kind], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(_row, doc_id, kind, start, end, value, before, after)``, one row per valid match.

    Leftmost non-overlapping matches per kind, in code points, end exclusive. A text
    without any keeps one row with null ``kind``; a null text counts as empty. ``_row``
    tells repeated rows apart; all rows of one input row stand in one partition. Texts
    never leave the scan: what is shuffled is one row per match.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("doc_id"),
        F.concat(*[_hits(text, k) for k in kinds]).alias("hits"),
    )
    rows = found.select("_row", "doc_id", F.explode_outer("hits").alias("h")).select(
        "_row", "doc_id", "h.*"
    )
    valid = F.lit(False)
    for kind in kinds:
        valid = valid | ((F.col("kind") == kind.name) & F.coalesce(kind.valid(F.col("value")), F.lit(False)))
    rows = rows.withColumn("_ok", F.col("value").isNotNull() & valid)
    order = Window.partitionBy("_row", "kind").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("value")
    placed = rows.select(
        "*",
        (F.sum("gap").over(upto) + F.coalesce(F.sum(size).over(earlier), F.lit(0))).alias("start"),
        F.lead("head").over(order).alias("after"),
        # One row of each text stays even if none of its matches is valid.
        F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("_ok"))).alias("_nth"),
    )
    only = lambda c: F.when(F.col("_ok"), c)
    return placed.where((F.col("_nth") == 1) | F.col("_ok")).select(
        "_row",
        "doc_id",
        only(F.col("kind")).alias("kind"),
        only(F.col("start")).cast("long").alias("start"),
        only(F.col("start") + size).cast("long").alias("end"),
        only(F.col("value")).alias("value"),
        only(F.col("before")).alias("before"),
        only(F.col("after")).alias("after"),
    )


def kind_rank(kinds: Sequence[str], column: str = "kind") -> Column:
    """Position of a kind in ``kinds``."""
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(column))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, joined by commas."""
    one = lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")
