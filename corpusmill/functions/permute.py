"""A keyed permutation of ``0 .. n - 1`` as a column expression.

A number below ``a * b`` is a pair of digits. Rounds add a hash of one digit to the other,
by turns; each round can be undone, so together they permute the pairs. ``a * b`` is only
a little more than ``n``: what falls outside is sent through again until it is inside. So
a global shuffle needs neither a sort nor a table of the order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: Tries at most. Outside are fewer than ``a`` numbers, about the root of ``n``: a chain is
#: shorter than that, and one of 33 tries has a chance below ``n ** -15`` beyond that.
TRIES = 32


def _hash32(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def permuted(number: Column, n: Column, *key: Column) -> Column:
    """Where ``number`` goes among ``n``, under a key of any columns."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.ceil(n / a).cast("bigint")

    def sent(x: Column) -> Column:
        """All rounds as a chain of structs, so that no expression is repeated."""
        pair = F.struct(F.floor(x / b).cast("bigint").alias("l"), (x % b).alias("r"))

        def turn(p: Column, i: Column) -> Column:
            on_left = F.struct(F.pmod(p["l"] + _hash32(*key, i, p["r"]), a).alias("l"), p["r"].alias("r"))
            on_right = F.struct(p["l"].alias("l"), F.pmod(p["r"] + _hash32(*key, i, p["l"]), b).alias("r"))
            return F.when(i % 2 == 0, on_left).otherwise(on_right)

        rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        return F.aggregate(rounds, pair, turn, lambda p: p["l"] * b + p["r"])

    tries = F.sequence(F.lit(1), F.lit(TRIES))
    found = F.aggregate(tries, sent(number.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(sent(x)))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("a number left its range")).cast("bigint"))
