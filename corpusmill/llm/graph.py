"""Connected components of a large graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.scratch import Scope, materialize


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes in ``links (a, b)``: the smallest node reachable.

    Per round every node takes the smallest label among its own and its neighbours',
    and labels then jump to their own label's label, so chains shrink by doubling. All
    is grouped minima and equi-joins; labels of a round are written, links are read once
    per round, nothing reaches the driver but whether a label has changed.
    """
    with Scope(links.sparkSession) as scope:
        turned = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = links.where(F.col("a") != F.col("b")).select(F.explode(F.array(F.struct("a", "b"), turned)).alias("_link"))
        both = scope.keep(both.select("_link.*").distinct(), "links")
        labels = scope.keep(
            both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels"
        )
        written = labels
        changed = not labels.isEmpty()
        while changed:
            near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node"))
            lower = near.agg(F.min("component").alias("near"))
            stepped = labels.join(lower, "node").select(
                "node", "component", F.least("component", "near").alias("next")
            )
            stepped = scope.keep(stepped, "labels")
            far = stepped.select(F.col("node").alias("next"), F.col("next").alias("far"))
            jumped = stepped.join(far, "next").select("node", "component", "far")
            jumped = scope.keep(jumped, "labels")
            changed = not jumped.where(F.col("far") != F.col("component")).isEmpty()
            # The next round reads the new labels where they are, without another write.
            scope.drop(written, stepped)
            written, labels = jumped, jumped.select("node", F.col("far").alias("component"))
        return materialize(labels, "components")
