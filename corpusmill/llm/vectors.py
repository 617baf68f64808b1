"""Exact top-k by inner product: M-trees over parts of the vectors, searched best first.

The largest inner products with a query are the smallest Euclidean distances once every
vector has one more component that brings it to the same length. So the triangle
inequality applies, while the scores themselves stay integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.scratch import Scope, materialize

SCALE = 1024
TOP = 10
QUERY_EVERY = 100
TREE_ROWS = 1 << 13  # vectors of one tree at most, about
PAGE = 128  # vectors of a leaf at most
FAN = 16  # children of an inner node at most
PIVOTS = 8  # vectors whose distances to all others a tree stores
_SLACK = 0.01  # scores are whole numbers; rounding errors lie below this and the next
_RELATIVE_SLACK = 1e-12  # of the squared length


@dataclass
class Node:
    """One page: its centre, covering radius, distance to the parent's centre, least id.

    A leaf has rows and their distances to the centre; an inner node has children, and
    what their bounds need as columns.
    """

    center: np.ndarray
    radius: float
    to_parent: float
    least_id: int
    rows: np.ndarray | None = None
    to_center: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None
    distances: np.ndarray | None = None  # of the children's centres to this one


class MTree:
    """A metric tree over integer vectors, bulk loaded."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, vectors: np.ndarray):
        self.ids, self.own, self.vectors = ids, own, vectors
        squares = (vectors * vectors).sum(axis=1)
        self.most = int(squares.max()) if len(squares) else 0
        extra = np.sqrt((self.most - squares).astype(np.float64))
        self.points = np.concatenate([vectors.astype(np.float64), extra[:, None]], axis=1)
        everything = np.arange(len(ids))
        self.pivots = self._far_apart()
        self.to_pivots = np.stack(
            [np.sqrt(((self.points - self.points[p]) ** 2).sum(axis=1)) for p in self.pivots], axis=1
        ) if self.pivots else np.zeros((len(ids), 0))
        self.scored = 0  # rows whose score has been computed, over all searches
        self.root = self._node(everything, self.points.mean(axis=0), None) if len(ids) else None

    def _node(self, rows: np.ndarray, center: np.ndarray, parent: np.ndarray | None) -> Node:
        far = np.sqrt(((self.points[rows] - center) ** 2).sum(axis=1))
        to_parent = 0.0 if parent is None else float(np.sqrt(((center - parent) ** 2).sum()))
        node = Node(center, float(far.max()), to_parent, int(self.ids[rows].min()))
        if len(rows) <= PAGE:
            node.rows, node.to_center = rows, far
            return node
        for part in self._split(rows):
            node.children.append(self._node(part, self.points[part].mean(axis=0), center))
        node.centers = np.stack([c.center for c in node.children])
        node.radii = np.array([c.radius for c in node.children])
        node.distances = np.array([c.to_parent for c in node.children])
        return node

    def _far_apart(self) -> list[int]:
        """Rows each as far as can be from those chosen before."""
        chosen: list[int] = []
        if not len(self.ids):
            return chosen
        near = ((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1)
        while len(chosen) < PIVOTS and near.max() > 0:
            chosen.append(int(near.argmax()))
            away = ((self.points - self.points[chosen[-1]]) ** 2).sum(axis=1)
            near = away if len(chosen) == 1 else np.minimum(near, away)
        return chosen

    def _halves(self, rows: np.ndarray) -> list[np.ndarray]:
        """Two parts on either side of a plane between far members, a quarter each at least.

        The plane lies in the widest gap that leaves so much; equal points are cut by id.
        """
        points = self.points[rows]
        one = points[((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        two = points[((points - one) ** 2).sum(axis=1).argmax()]
        place = points @ (two - one)
        order = np.lexsort((self.ids[rows], place))
        gaps = np.diff(place[order])
        least = len(rows) // 4
        inner = gaps[least : len(rows) - least - 1]
        cut = least + 1 + int(inner.argmax()) if len(inner) and inner.max() > 0 else len(rows) // 2
        return [rows[order[:cut]], rows[order[cut:]]]

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """At most ``FAN`` parts, the largest cut first, so that leaves lie at about one depth."""
        parts = [rows]
        while len(parts) < FAN:
            largest = max(range(len(parts)), key=lambda i: len(parts[i]))
            if len(parts[largest]) <= PAGE:
                break
            parts[largest : largest + 1] = self._halves(parts[largest])
        return parts

    @staticmethod
    def _reach(length: int, bound):
        """Largest score at this distance or farther."""
        return np.floor((length - np.maximum(bound, 0.0) ** 2) / 2 + _SLACK + _RELATIVE_SLACK * length)

    def search(self, own: int, query: np.ndarray, top: int) -> list[tuple[int, int]]:
        """The ``top`` best ``(score, vec_id)`` but the query's own row, ties to smaller ids."""
        if self.root is None:
            return []
        length = int((query * query).sum()) + self.most
        place = np.concatenate([query.astype(np.float64), [0.0]])
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id): its first is the worst kept

        def hopeless(bound: float, least_id: int) -> bool:
            """Whether nothing at this distance or farther can enter the list."""
            if len(best) < top:
                return False
            reach = self._reach(length, bound)
            score, minus_id = best[0]
            return reach < score or (reach == score and least_id > -minus_id)

        def floor() -> float:
            """Least score that may still enter the list."""
            return best[0][0] if len(best) == top else -math.inf

        # Doubles are exact for sums of whole numbers this small, and much faster.
        small = self.most * int((query * query).sum()) < 1 << 104
        exact, asked = (self.points[:, :-1], place[:-1]) if small else (self.vectors, query)
        to_pivots = np.sqrt(((self.points[self.pivots] - place) ** 2).sum(axis=1))
        away = float(np.sqrt(((place - self.root.center) ** 2).sum()))
        queue, number = [(away - self.root.radius, 0, away, self.root)], 1
        while queue:
            bound, _, away, node = heapq.heappop(queue)
            if hopeless(bound, -(1 << 62)):
                break
            if hopeless(bound, node.least_id):
                continue
            if node.rows is None:
                # Stored distances rule children out before their own is computed.
                near = np.flatnonzero(self._reach(length, np.abs(away - node.distances) - node.radii) >= floor())
                ds = np.sqrt(((node.centers[near] - place) ** 2).sum(axis=1))
                for i, d in zip(near.tolist(), ds.tolist(), strict=True):
                    child = node.children[i]
                    if not hopeless(d - child.radius, child.least_id):
                        heapq.heappush(queue, (d - child.radius, number, d, child))
                        number += 1
                continue
            # So they do with rows: those to the page's centre, then those to the pivots.
            rows = node.rows[self._reach(length, np.abs(node.to_center - away)) >= floor()]
            if self.pivots and len(best) == top:
                apart = np.abs(self.to_pivots[rows] - to_pivots).max(axis=1, initial=0.0)
                rows = rows[self._reach(length, apart) >= floor()]
            self.scored += len(rows)  # the rest is avoided
            scores = exact[rows] @ asked
            better = np.flatnonzero(scores >= floor())
            for row, score in zip(rows[better].tolist(), scores[better].tolist(), strict=True):
                if self.own[row] == own:
                    continue
                entry = (int(score), -int(self.ids[row]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def whole_numbers(vector: Column) -> Column:
    """``floor(SCALE * x)`` of every component, null unless all are finite numbers."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(doubles, lambda x: F.floor(x * SCALE).cast("long")))


def _rows(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy().reshape(-1, dim)


def _search_parts(top: int):
    """Task function: per part, first the vectors come, then the queries."""

    def answer(tree: MTree, batch: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        out: list[tuple[int, int, int, int]] = []
        ids, own = batch.column("vec_id").to_pylist(), batch.column("own").to_pylist()
        queries = _rows(batch, dim) if dim else np.zeros((len(ids), 0), np.int64)
        for i, o, q in zip(ids, own, queries, strict=True):
            out += [(o, i, found, score) for score, found in tree.search(o, q, top)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        names = ["own", "query_id", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, vectors, tree = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("part", "dim", "is_query")], axis=1)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if a == b:
                    continue
                piece, (part, dim, is_query) = batch.slice(a, b - a), marks[a].tolist()
                if current != (part, dim):
                    current, vectors, tree = (part, dim), [], None
                if not is_query:
                    vectors.append(piece)
                    continue
                if tree is None:
                    whole = [_rows(p, dim) if dim else np.zeros((p.num_rows, 0), np.int64) for p in vectors]
                    column = lambda c: np.concatenate(
                        [p.column(c).to_numpy() for p in vectors] or [np.empty(0, np.int64)]
                    )
                    points = np.concatenate(whole) if whole else np.zeros((0, dim), np.int64)
                    tree, vectors = MTree(column("vec_id"), column("own"), points), []
                yield answer(tree, piece, dim)

    return search


def top_inner_products(vectors: DataFrame, top: int = TOP, query_every: int = QUERY_EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's best rows of ``(vec_id, embedding)``.

    Queries are the rows whose id ``query_every`` divides. Rows are dealt by number over
    parts of bounded size, each of which becomes a tree in one task; queries visit all
    parts in blocks of Arrow rows and the best of all parts win. So memory holds one
    tree and one batch, whatever the table's size or its most common vector.

    A vector that is null or has a null or non-finite component takes no part, nor does
    a row without an id. Vectors meet those of the same length only. Rows are told apart
    even if they repeat: only the query's own row is left out, and a repeated query is
    answered once per row.
    """
    spark = vectors.sparkSession
    with Scope(spark) as scope:
        whole = vectors.select(
            F.monotonically_increasing_id().alias("own"),
            F.col("vec_id").cast("long").alias("vec_id"),
            whole_numbers(F.col("embedding")).alias("v"),
        ).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        whole = scope.keep(whole.withColumn("dim", F.size("v").cast("long")), "vectors")
        parts = max(math.ceil(whole.count() / TREE_ROWS), 1)
        part = F.pmod(F.xxhash64("own"), F.lit(parts)).cast("int")
        placed = whole.select(part.alias("part"), "dim", F.lit(0).cast("long").alias("is_query"), "own", "vec_id", "v")
        every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        queries = whole.where(F.col("vec_id") % query_every == 0)
        asked = queries.select(every, "dim", F.lit(1).cast("long").alias("is_query"), "own", "vec_id", "v")
        dealt = placed.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", "dim", "is_query")
        found = dealt.mapInArrow(_search_parts(top), "own bigint, query_id bigint, vec_id bigint, score bigint")
        order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return materialize(ranked.select("query_id", "rank", "vec_id", "score"), "top")
