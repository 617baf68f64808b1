"""Hard negatives: threshold joins of anchors with all vectors, by a bounded inverted index.

The vectors of a part are indexed by dimension, the dimensions of most weight first. Of a
vector only leading components are indexed, up to where the norm of the rest falls below
a share of its own; what the rest can add to a score is at most the product of both
sides' remaining norms. An anchor adds up partial scores over the postings and verifies
the rows whose partial score and bound reach a threshold. The threshold begins high and is
lowered until the window it serves is full, or reaches the window's end.

Two passes: the best rows of the anchor's own label, its positives; then for every positive
the best rows of other labels whose score lies in the window below the positive's.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.scratch import Scope, materialize

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80  # of the positive's score, for a negative
PART_ROWS = 1 << 13  # vectors of one index at most, about
OMITTED = 0.5  # share of a vector's norm that stays out of the index at most
ANCHORS = 64  # whose partial scores are added up at once
CHUNK = 8  # dimensions of postings multiplied at once
STEPS = 8  # the first threshold lies this part of a window below its top
_EXACT = 1 << 53  # up to here doubles hold whole numbers


class Index:
    """Postings of whole-number vectors by dimension, with the norms of what is left out."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        floats = vectors.astype(np.float64)
        self.order = np.argsort(-(floats * floats).sum(axis=0), kind="stable")
        floats = floats[:, self.order]
        # rest[i, q]: norm of what row i has from dimension q on.
        squares = np.cumsum((floats * floats)[:, ::-1], axis=1)[:, ::-1]
        rest = np.sqrt(np.concatenate([squares, np.zeros((len(floats), 1))], axis=1))
        indexed = (rest > OMITTED * rest[:, :1]).sum(axis=1)
        # Rows in order of how much is indexed: the postings of a dimension are the first rows.
        rows = np.argsort(-indexed, kind="stable")
        self.ids, self.own, self.labels = ids[rows], own[rows], labels[rows]
        self.indexed, self.rest = indexed[rows], rest[rows, indexed[rows]]
        self.vectors = vectors[rows][:, self.order]
        self.norm = float(rest[:, 0].max(initial=0.0))
        dims = np.arange(vectors.shape[1])
        self.posted = np.where(dims < self.indexed[:, None], floats[rows], 0.0)
        self.lengths = (self.indexed[:, None] > dims).sum(axis=0)

    def bounds(self, anchors: np.ndarray) -> np.ndarray:
        """What the scores of every anchor (already in ``order``) with every row may reach."""
        floats = anchors.astype(np.float64)
        partial = np.zeros((len(anchors), len(self.ids)))
        for at in range(0, anchors.shape[1], CHUNK):
            long = int(self.lengths[at])
            partial[:, :long] += floats[:, at : at + CHUNK] @ self.posted[:long, at : at + CHUNK].T
        squares = np.cumsum((floats * floats)[:, ::-1], axis=1)[:, ::-1]
        rests = np.sqrt(np.concatenate([squares, np.zeros((len(anchors), 1))], axis=1))
        # A little more than rounding can take away.
        slack = 1 + 1e-12 * self.norm * rests[:, :1]
        return partial + rests[:, self.indexed] * self.rest + slack

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of an anchor (in ``order``) with some rows."""
        if self.norm * float(np.sqrt((anchor.astype(np.float64) ** 2).sum())) < _EXACT:
            return (self.vectors[rows].astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[rows] @ anchor


class Candidates:
    """Rows that an anchor may take, verified as far as thresholds asked for them."""

    def __init__(self, index: Index, anchor: np.ndarray, bound: np.ndarray, allowed: np.ndarray):
        self.index, self.anchor = index, anchor
        self.open = np.flatnonzero(allowed)
        self.bound = bound[self.open]
        self.rows, self.score = np.empty(0, np.int64), np.empty(0, np.int64)

    def verify(self, threshold: float) -> None:
        """From now on all rows whose score reaches the threshold are verified."""
        reach = self.bound >= threshold
        if reach.any():
            rows = self.open[reach]
            self.rows = np.concatenate([self.rows, rows])
            self.score = np.concatenate([self.score, self.index.scores(self.anchor, rows)])
            self.open, self.bound = self.open[~reach], self.bound[~reach]

    def first(self, count: int, low: float, high: float) -> list[tuple[int, int]]:
        """``(score, vec_id)`` of the best verified rows within a window, ties by smaller id."""
        fits = np.flatnonzero((self.score >= low) & (self.score <= high))
        ids = self.index.ids[self.rows[fits]]
        best = fits[np.lexsort((ids, -self.score[fits]))[:count]]
        return list(zip(self.score[best].tolist(), self.index.ids[self.rows[best]].tolist(), strict=True))

    def best(self, count: int) -> list[tuple[int, int]]:
        """The best rows of all: thresholds are lowered until ``count`` reach the last one."""
        asked = 4 * count
        while len(self.open):
            at = max(len(self.bound) - asked, 0)
            threshold = np.partition(self.bound, at)[at]
            self.verify(threshold)
            if len(self.score) >= count:
                reached = np.partition(self.score, -count)[-count]
                self.verify(reached)
                break
            asked *= 2
        return self.first(count, -math.inf, math.inf)

    def window(self, count: int, low: int, high: int) -> list[tuple[int, int]]:
        """The best rows between two scores: thresholds are lowered until the window is full."""
        step = max((high - low) // STEPS, 1)
        threshold = high
        while True:
            threshold = max(threshold - step, low)
            self.verify(threshold)
            found = self.first(count, threshold, high)
            if len(found) == count or threshold == low:
                return found
            step *= 2


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy()
    return flat.reshape(-1, dim) if dim else np.zeros((batch.num_rows, 0), np.int64)


def _visits(answer: Callable[[Index, pa.RecordBatch, int], Iterator[pa.RecordBatch]]):
    """Task function: of each part first the vectors come, then the anchors that visit it."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, index = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("part", "dim", "visitor")], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)], strict=True):
                if a == b:
                    continue
                piece, (part, dim, visitor) = batch.slice(a, b - a), marks[a].tolist()
                if current != (part, dim):
                    current, waiting, index = (part, dim), [], None
                if not visitor:
                    waiting.append(piece)
                    continue
                if not waiting and index is None:
                    continue  # a part without vectors of this length
                if index is None:
                    column = lambda c: np.concatenate([p.column(c).to_numpy() for p in waiting])  # noqa: E731, B023
                    vectors = np.concatenate([_matrix(p, dim) for p in waiting])
                    index, waiting = Index(column("vec_id"), column("own"), column("label"), vectors), []
                for at in range(0, piece.num_rows, ANCHORS):
                    yield from answer(index, piece.slice(at, ANCHORS), dim)

    return visit


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _positives(index: Index, anchors: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    vectors = _matrix(anchors, dim)[:, index.order]
    out = []
    for own, label, vector, bound in zip(
        anchors.column("own").to_pylist(), anchors.column("label").to_pylist(), vectors, index.bounds(vectors), strict=True
    ):
        alike = (index.labels == label) & (index.own != own)
        found = Candidates(index, vector, bound, alike).best(POSITIVES)
        out += [(own, score, vec_id) for score, vec_id in found]
    yield _columns(out, ["own", "score", "vec_id"])


def _negatives(index: Index, anchors: pa.RecordBatch, dim: int) -> Iterator[pa.RecordBatch]:
    vectors = _matrix(anchors, dim)[:, index.order]
    out = []
    for own, label, vector, positives, bound in zip(
        anchors.column("own").to_pylist(), anchors.column("label").to_pylist(), vectors,
        anchors.column("positives").to_pylist(), index.bounds(vectors), strict=True,
    ):
        others = Candidates(index, vector, bound, index.labels != label)
        for positive in positives:
            high = positive["score"]
            low = -(-LEAST_PERCENT * high // 100)
            if low <= high:
                out += [(own, positive["rank"], *found) for found in others.window(NEGATIVES, low, high)]
    yield _columns(out, ["own", "rank", "score", "vec_id"])


def whole_numbers(vector: Column) -> Column:
    """``floor(SCALE * x)`` of every component, null unless all are finite numbers."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(x * SCALE).cast("long")))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """Negatives of every anchor and positive of ``vectors (vec_id, embedding, label)``.

    Returns ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Rows are dealt over parts of bounded size, each of which is indexed in one task;
    anchors visit all parts, and the best of all parts' windows are the window.

    Rows without an id or label, or whose vector is null or has a null or non-finite
    component, take no part. Vectors meet those of the same length only. Rows are told
    apart even if they repeat: only the anchor's own row is no positive of it, and a
    repeated anchor or positive is answered once per row. Where a positive's score is
    negative no window exists. Scores must fit into 64 bits.
    """
    spark = vectors.sparkSession
    with Scope(spark) as scope:
        label = F.col("label").cast("long")
        moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
        whole = vectors.select(
            F.monotonically_increasing_id().alias("own"),
            F.col("vec_id").cast("long").alias("vec_id"),
            moved.alias("label"),
            whole_numbers(F.col("embedding")).alias("v"),
        ).where("vec_id is not null and label is not null and v is not null")
        whole = scope.keep(whole.withColumn("dim", F.size("v").cast("long")), "vectors")
        parts = max(math.ceil(whole.count() / PART_ROWS), 1)
        numbers = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        placed = whole.select(
            F.pmod(F.xxhash64("own"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("visitor"), *whole.columns
        )

        def visited(anchors: DataFrame, task, schema: str) -> DataFrame:
            asked = anchors.select(numbers, F.lit(1).alias("visitor"), *anchors.columns)
            dealt = placed.unionByName(asked, allowMissingColumns=True).repartitionById(parts, "part")
            return dealt.sortWithinPartitions("part", "dim", "visitor").mapInArrow(_visits(task), schema)

        anchors = whole.where(F.col("vec_id") % ANCHOR_EVERY == 0)
        first = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
        found = visited(anchors, _positives, "own bigint, score bigint, vec_id bigint")
        found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= POSITIVES)
        positives = scope.keep(
            found.groupBy("own").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("positives")),
            "positives",
        )
        known = scope.keep(anchors.join(positives, "own"), "anchors")
        below = visited(known, _negatives, "own bigint, rank bigint, score bigint, vec_id bigint")
        order = Window.partitionBy("own", "positive").orderBy(F.desc("score"), "vec_id")
        below = below.withColumnRenamed("rank", "positive").withColumn("rank", F.row_number().over(order))
        pairs = known.select("own", F.col("vec_id").alias("anchor_id"), F.explode("positives").alias("p"))
        pairs = pairs.select(
            "own", "anchor_id", F.col("p.rank").cast("long").alias("positive"),
            F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"),
        )
        out = pairs.join(below.where(F.col("rank") <= NEGATIVES), ["own", "positive"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        return materialize(out, "negatives")
