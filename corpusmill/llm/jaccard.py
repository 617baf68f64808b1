"""N-gram Jaccard join: documents whose shingle sets overlap by 80 percent, as components.

The join is the product of the sparse document-by-shingle incidence with its transpose,
kept small by bounds that lose no pair:

* Equal sets are one row of the matrix (a class). Links between classes are what counts.
* A class of ``n`` shingles must share ``need(n)`` of them with any partner, so under one
  order of all shingles both have a common one among their first ``n - need(n) + 1``.
  Only these columns enter the product. The order is by hash, except that shingles of
  very many documents come last: a passage that many documents share is no column of
  theirs unless they consist of such passages. Any order gives the same result.
* Overlaps add up over the columns of the product. A pair goes on only if its sizes allow
  the overlap and what was counted, with all that may stand beyond the columns, suffices.
* A column of many classes is not multiplied out. Its members of like size are compared
  with one of them, the pivot, and join its component: first with the class that has most
  such columns, as a text that all others are copies of has. Classes whose columns still
  have several components get new columns, in an order by how often their shingles occur
  among them alone, and other pivots. Columns with the same largest component, as of
  copies of one text, then become one. What remains are the few members outside of a
  column's largest component. Only these visit the column's blocks: the product of bitmaps
  counts the bits that a visitor and a member share, and bits that one has and the other
  lacks are shingles that they don't share, which discards most pairs at once.

Compared pairs are then decided by their exact overlap.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.graph import components
from corpusmill.llm.rows import FILTER_BITS, KEY, among, bit_filter, may_hold, row_key, slices
from corpusmill.llm.shingles import shingle_sets
from corpusmill.scratch import Scope, materialize

PERCENT = 80
ZONE = 0.3  # share of the hash range in which shingles are counted, at most a half
FREQUENT = 32  # documents from which a shingle comes last in the order
MOST_FREQUENT = 1 << 20  # such shingles at most: 8 MB to broadcast
DENSE = 32  # classes up to which a column is multiplied out at once
MAP_WORDS = 32  # of 64 bits each, of the bitmap of a class
BLOCK_ROWS = 4096  # members of a column in one block of a product, about
VISIT_ROWS = 8192  # rows that visit a block together, about
VISITORS = 512  # rows of one product
PIVOTS = 3  # with which the members of a column are compared one after the other
COUNTED = 1 << 18  # hashes that a task counts at once
SHARED_BITS = 1 << 28  # at most, of the filter that knows shingles of several documents: 32 MB
_ZONE_END = np.uint64(int(ZONE * (1 << 64)))


def need(n: Column) -> Column:
    """Shingles that a set of ``n`` shares at least with any partner."""
    return F.ceil(n * PERCENT / 100)


def compatible(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can overlap enough."""
    return (n * 100 >= m * PERCENT) & (m * 100 >= n * PERCENT)


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))


def shingle_frequencies(texts: DataFrame) -> DataFrame:
    """``(hash, df)`` of the counted zone's shingles of several documents, over all of them.

    Counts are summed over ``COUNTED`` hashes before they leave Python, and per task
    before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0

        def flush() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            sets.clear()
            return pa.RecordBatch.from_arrays([_signed(found), pa.array(n)], ["hash", "n"])

        for part in (p for batch in batches for p in slices(batch)):
            for hashes in shingle_sets(part.column(0).to_pylist()):
                sets.append(hashes[: np.searchsorted(hashes, _ZONE_END)].copy())
                size += len(sets[-1])
                if size >= COUNTED:
                    yield flush()
                    size = 0
        yield flush()

    counted = texts.select("text").mapInArrow(count, "hash bigint, n bigint")
    return counted.groupBy("hash").agg(F.sum("n").alias("df")).where("df > 1")


def frequent_shingles(frequencies: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that come last in the order, at most ``MOST_FREQUENT``.

    Their least frequency is ``FREQUENT``, or a fixed share of all occurrences once
    there are so many that the list could pass its bound.
    """
    total = frequencies.agg(F.sum("df")).first()[0] or 0
    least = max(FREQUENT, total // MOST_FREQUENT + 1)
    rows = frequencies.where(F.col("df") > least).select("hash").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64))


def shared_bits(hashes: int) -> int:
    """Bits of a filter of so many hashes: a sixteenth of them set at most, as far as ``SHARED_BITS`` goes."""
    return min(SHARED_BITS, max(FILTER_BITS, 1 << (16 * hashes).bit_length()))


def _prefix(hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order, enough to meet any partner."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = n - -(-n * PERCENT // 100) + 1
    zone = int(np.searchsorted(hashes, _ZONE_END))
    inside = hashes[:zone]
    if len(last) and zone:
        at = np.minimum(np.searchsorted(last, inside), len(last) - 1)
        late = last[at] == inside
        return np.concatenate([inside[~late], hashes[zone:], inside[late]])[:size]
    return hashes[:size]


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """The bits, out of ``64 * MAP_WORDS``, that a set's hashes fall on."""
    marks = np.zeros(64 * MAP_WORDS, dtype=bool)
    marks[(hashes % np.uint64(len(marks))).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def fingerprints(docs: DataFrame, last: np.ndarray, several: Broadcast) -> DataFrame:
    """``(_row, doc_id, key, n, digest, prefix, bits)`` of ``docs (_row, doc_id, key, text)``.

    ``prefix`` leaves out shingles of the zone that ``several`` knows to be of one
    document alone: they make no column.
    """
    late = docs.sparkSession.sparkContext.broadcast(last)

    def prefix(hashes: np.ndarray) -> np.ndarray:
        first = _prefix(hashes, late.value)
        return first[among(several.value, first) | (first >= _ZONE_END)]

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            sets = list(shingle_sets(batch.column(3).to_pylist()))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    _lists([prefix(s) for s in sets]),
                    _lists([_bitmap(s) for s in sets]),
                ],
                ["_row", "doc_id", KEY, "n", "digest", "prefix", "bits"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("_row", "doc_id", KEY, "text").mapInArrow(
        prints,
        f"_row bigint, doc_id {kind}, {KEY} binary, n bigint, digest binary,"
        " prefix array<bigint>, bits array<bigint>",
    )


def class_sets(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cid, shingles)`` of ``classes (cid, digest)``, from the texts that have them.

    Sets are computed again rather than kept for all documents. A filter of fixed size
    drops most texts of other classes in the task that computes them, before they leave Python.
    """
    head = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("bigint")
    shared = bit_filter(classes.select(head.alias("hash")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = [s for s in shingle_sets(batch.column(0).to_pylist()) if len(s)]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            heads = np.array([int.from_bytes(d[:8]) for d in digests], dtype=np.uint64)
            own = np.flatnonzero(among(shared.value, heads))
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in own], pa.binary()), _lists([found[i] for i in own])], ["digest", "shingles"]
            )

    computed = texts.select("text").mapInArrow(sets, "digest binary, shingles array<bigint>")
    # One set per class and task, then one per class: copies add nothing to the shuffle.
    once = computed.groupBy("digest").agg(F.first("shingles").alias("shingles"))
    return once.join(classes.select("digest", "cid"), "digest").select("cid", "shingles")


def _overlapping(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose sets overlap enough, by their exact overlap."""
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("_b"))
    both = pairs.join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("_a", "_b")).cast("long")
    whole = F.size("_a") + F.size("_b")
    counted = both.select("a", "b", common.alias("common"), whole.alias("whole"))
    return counted.where(F.col("common") * 100 >= (F.col("whole") - F.col("common")) * PERCENT).select("a", "b")


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of compatible size that share a column, with ``x_`` and ``y_`` before names."""
    side = lambda df, p: df.select("hash", *[F.col(c).alias(p + c) for c in df.columns if c != "hash"])
    return side(left, "x_").join(side(right, "y_"), "hash").where(compatible(F.col("x_n"), F.col("y_n")))


def _ordered() -> list[Column]:
    return [F.least("x_cid", "y_cid").alias("a"), F.greatest("x_cid", "y_cid").alias("b")]


def _promising(narrow: DataFrame, wide: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of the narrow columns whose overlap may suffice.

    One of the two classes has its whole prefix below the other's last shingle there; so
    the overlap is at most what the columns hold plus the larger rest behind a prefix.
    Wide columns are not multiplied out: each may hold one more.
    """
    uncounted = wide.groupBy("cid").agg(F.count(F.lit(1)).alias("wide"))
    known = narrow.join(uncounted, "cid", "left").fillna(0, ["wide"])
    both = _sides(known, known).where(F.col("x_cid") < F.col("y_cid"))
    counted = both.groupBy("x_cid", "y_cid", "x_n", "y_n", "x_wide", "y_wide").agg(F.count(F.lit(1)).alias("common"))
    behind = F.greatest(need(F.col("x_n")), need(F.col("y_n"))) - 1
    most = F.col("common") + F.least("x_wide", "y_wide") + behind
    return counted.where(most * (100 + PERCENT) >= (F.col("x_n") + F.col("y_n")) * PERCENT).select(*_ordered())


def _size_class(n: Column) -> Column:
    """Sets of compatible size are of the same class or of neighbouring ones."""
    return F.floor(F.log(n) / math.log(100 / PERCENT) + 1e-9).cast("int")


def _around(labelled: DataFrame, step: int) -> DataFrame:
    """Pairs ``(a, b)`` of a pivot with the members of other components, by column and size class.

    ``labelled (hash, cid, n, weight, component)``. The pivot is of the component that has
    most members there: first the one of most columns, in later steps any other.
    """
    rank = F.col("weight") if step == 0 else F.xxhash64("cid", F.lit(step))
    cells = labelled.withColumn("size", _size_class(F.col("n")))
    chosen = F.max(F.struct(rank.alias("rank"), (-F.col("cid")).alias("minus"), "n"))
    parts = cells.groupBy("hash", "size", "component").agg(F.count(F.lit(1)).alias("members"), chosen.alias("best"))
    pivots = parts.groupBy("hash", "size").agg(F.max(F.struct("members", "best", "component")).alias("p"))
    pivots = pivots.select(
        "hash", "size", F.col("p.component").alias("own"), (-F.col("p.best.minus")).alias("pivot"), F.col("p.best.n").alias("m")
    )
    met = cells.join(pivots, ["hash", "size"]).where((F.col("component") != F.col("own")) & compatible(F.col("n"), F.col("m")))
    return met.select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()


class _Members:
    """Rows ``(cid, n, component, bits, columns)`` of a block; bits stay packed."""

    def __init__(self, rows: pd.DataFrame):
        self.cid, self.n, self.component = (rows[c].to_numpy() for c in ("cid", "n", "component"))
        self.bits = np.stack(rows["bits"].to_numpy()).astype(np.int64).view(np.uint8)
        marks = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.rest = self.n - marks  # shingles that share a bit with another one
        self._columns, self._sets = rows["columns"].to_numpy(), {}

    def columns(self, row: int) -> set[int]:
        if row not in self._sets:
            self._sets[row] = set(self._columns[row].tolist())
        return self._sets[row]


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits the rows of two packed matrices share, from ``VISITORS`` of either at a time."""
    unpacked = lambda packed: np.unpackbits(packed, axis=1).astype(np.float32)
    left, out = unpacked(x), np.empty((len(x), len(y)), np.float32)
    for at in range(0, len(y), VISITORS):
        out[:, at : at + VISITORS] = left @ unpacked(y[at : at + VISITORS]).T
    return out


def _pair(a: int, b: int) -> tuple[int, int]:
    return (int(a), int(b)) if a < b else (int(b), int(a))


def _blocked(split: DataFrame, best: bool) -> DataFrame:
    """Promising pairs ``(a, b)`` of members of different components, column by column.

    ``split (hash, cid, n, component, bits, columns)``. Of two such members one at least is
    outside of its column's largest component: it visits the blocks, of bounded size, over
    which the members of its size and the neighbouring ones are dealt. The visits to a block
    are dealt too, so a task never holds more than a block and ``VISIT_ROWS`` visitors, about.
    A pair comes out in the first column it shares. With ``best``, only the likeliest
    partners in a block: linking these first joins most components, so that few pairs are
    left for the rest.
    """
    sized = split.withColumn("size", _size_class(F.col("n")))
    counts = sized.groupBy("hash", "component").agg(F.count(F.lit(1)).alias("members"))
    largest = counts.groupBy("hash").agg(F.max_by("component", F.struct("members", "component")).alias("largest"))
    outside = sized.join(largest, "hash").where(F.col("component") != F.col("largest"))
    near = outside.withColumn("size", F.explode(F.array(F.col("size") - 1, "size", F.col("size") + 1)))
    both = sized.select("hash", "size", F.lit(1).alias("own")).unionByName(near.select("hash", "size", F.lit(0).alias("own")))
    rows, own = F.count(F.lit(1)), F.sum("own")
    cells = both.groupBy("hash", "size").agg(
        F.ceil(own / BLOCK_ROWS).cast("int").alias("blocks"), F.ceil((rows - own) / VISIT_ROWS).cast("int").alias("rounds")
    )
    cells = cells.where("blocks > 0 and rounds > 0")  # others make no pairs
    dealt = lambda name, *seed: F.pmod(F.xxhash64("cid", *seed), F.col(name).cast("long")).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    members = sized.join(cells, ["hash", "size"]).withColumn("block", dealt("blocks")).withColumn("round", every("rounds"))
    visits = near.join(cells, ["hash", "size"]).withColumn("round", dealt("rounds", F.lit(1))).withColumn("block", every("blocks"))
    shown = ["hash", "size", "block", "round", "cid", "n", "component", "bits", "columns"]
    met = members.select(*shown, F.lit(False).alias("visits")).unionByName(visits.select(*shown, F.lit(True).alias("visits")))

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        column, out = key[0], set()
        if rows["visits"].all() or not rows["visits"].any():
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        visitors, right = _Members(rows[rows["visits"]]), _Members(rows[~rows["visits"]])
        for at in range(0, len(visitors.cid), VISITORS):
            chosen = np.arange(at, min(at + VISITORS, len(visitors.cid)))
            shared = _products(visitors.bits[chosen], right.bits)
            likeliest, partner = np.full(len(right.cid), -1.0), np.zeros(len(right.cid), np.int64)
            # Row by row, so that nothing but the product itself is as large as a product.
            for p, common in zip(chosen, shared, strict=True):
                most = np.minimum(visitors.rest[p], right.rest) + common.astype(float)
                fits = most * (100 + PERCENT) >= PERCENT * (visitors.n[p] + right.n)
                fits &= visitors.component[p] != right.component
                if best and fits.any():
                    most[~fits] = -1
                    out.add(_pair(visitors.cid[p], right.cid[most.argmax()]))
                    better = most > likeliest
                    likeliest[better], partner[better] = most[better], visitors.cid[p]
                elif not best:
                    for q in np.flatnonzero(fits):
                        if min(visitors.columns(p) & right.columns(q)) == column:
                            out.add(_pair(visitors.cid[p], right.cid[q]))
            out.update(_pair(partner[q], right.cid[q]) for q in np.flatnonzero(likeliest >= 0))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return met.groupBy("hash", "size", "block", "round").applyInPandas(multiply, "a bigint, b bigint")


def _rarest_first(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(hash, cid, n)``: the columns of ``members (cid, n)`` in an order by their own frequencies.

    Shingles are counted over whole sets, but only over these classes, and rare ones come
    first. Two of them that overlap enough still share a column, while passages that many of
    them have are no longer columns of all. Shingles of one class alone come first of all
    and make no column.
    """
    words = members.join(sets, "cid").select("cid", "n", F.explode("shingles").alias("hash"))
    counts = words.groupBy("hash").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = words.join(counts, "hash").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("own"))
    left = (F.size("own") - need(F.col("n")) + 1).cast("int")  # the others, of this class alone, are in front
    first = shared.where(left > 0).select("cid", "n", F.explode(F.slice("own", F.lit(1), left)).alias("_w"))
    return first.select("_w.hash", "cid", "n")


def _split(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``columns (hash, cid, ..)`` with their component, where a column has several."""
    labelled = columns.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    parts = labelled.groupBy("hash").agg(F.min("component").alias("p"), F.max("component").alias("q"))
    return labelled.join(parts.where("p < q").select("hash"), "hash", "left_semi")


def _merged(split: DataFrame) -> DataFrame:
    """``(hash, cid, n)`` of ``split (hash, cid, n, component)``, columns that are nearly the same as one.

    Copies of a text share many columns, and a product of each would compare the same pairs
    over and over. Columns with the same largest component become one group, unless its
    product has more cells than theirs together. Classes that share a column share a group.
    """
    rows = F.count(F.lit(1))
    counts = split.groupBy("hash", "component").agg(rows.alias("members"))
    largest = F.max_by("component", F.struct("members", "component")).alias("largest")
    all_of, most = F.sum("members"), F.max("members")
    columns = counts.groupBy("hash").agg(largest, (all_of * (all_of - most)).alias("cells"))
    known = split.join(columns, "hash")
    apart = columns.groupBy("largest").agg(F.sum("cells").alias("apart"))
    outside = F.sum((F.col("component") != F.col("largest")).cast("long"))
    together = known.select("largest", "cid", "component").distinct().groupBy("largest").agg((rows * outside).alias("together"))
    chosen = apart.join(together, "largest").select("largest", (F.col("together") <= F.col("apart")).alias("one"))
    group = F.when(F.col("one"), F.xxhash64("largest", F.lit("group"))).otherwise(F.col("hash"))
    return known.join(chosen, "largest").select(group.alias("hash"), "cid", "n").distinct()


def _each_with_each(split: DataFrame) -> DataFrame:
    """Promising pairs ``(a, b)`` of different components in ``split (hash, cid, n, component, bits)``.

    For groups of few members, whose products are joins. Bits are used as in ``_blocked``.
    """
    marks = F.expr("aggregate(bits, 0L, (s, w) -> s + bit_count(w))")
    sides = split.select("hash", "cid", "n", "component", "bits", (F.col("n") - marks).alias("rest"))
    both = _sides(sides, sides).where((F.col("x_cid") < F.col("y_cid")) & (F.col("x_component") != F.col("y_component")))
    shared = F.expr("aggregate(zip_with(x_bits, y_bits, (v, w) -> bit_count(v & w)), 0L, (s, c) -> s + c)")
    most = F.least("x_rest", "y_rest") + shared
    return both.where(most * (100 + PERCENT) >= (F.col("x_n") + F.col("y_n")) * PERCENT).select(*_ordered()).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels (cid, component)`` after ``links (a, b)`` are added: only components are linked anew."""
    of = lambda c: labels.select(F.col("cid").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    found = components(between)
    moved = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("_next")), "component", "left")
    fresh = found.withColumnsRenamed({"node": "cid"}).join(labels.select("cid"), "cid", "left_anti")
    return moved.select("cid", F.coalesce("_next", "component").alias("component")).unionByName(fresh)


def _linked(
    scope: Scope, columns: DataFrame, maps: DataFrame, sets_of: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``(cid, component)`` of the classes linked through ``columns (hash, cid, n, members)``.

    ``maps (cid, bits)`` has the classes' bitmaps.
    """
    narrow = columns.where(F.col("members") <= DENSE).select("hash", "cid", "n")
    wide = scope.keep(columns.where(F.col("members") > DENSE).select("hash", "cid", "n"), "wide")
    weights = wide.groupBy("cid").agg(F.count(F.lit(1)).alias("weight"))  # of a prefix, so few
    weighed = scope.keep(wide.join(weights, "cid").withColumn("component", F.col("cid")), "weighed")
    alone = _around(weighed, 0)
    pairs = scope.keep(_promising(narrow, wide).unionByName(alone).distinct(), "pairs")
    compared = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(wide.select("cid"))
    sets = sets_of(compared.distinct())
    labels = components(_overlapping(pairs, sets)).withColumnsRenamed({"node": "cid"})
    split = scope.keep(_split(wide, labels), "split")
    if split.isEmpty():
        return labels
    members = scope.keep(split.select("cid", "n").distinct(), "members")
    sets = scope.keep(sets.join(members, "cid", "left_semi"), "sets")
    split = scope.keep(_split(_rarest_first(members, sets), labels), "split")

    def linked(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        return scope.keep(_joined(labels, _overlapping(scope.keep(pairs, "pairs"), sets)), "labels")

    for step in range(1, PIVOTS):
        if split.isEmpty():
            return labels
        labels = linked(labels, _around(split, step))
        split = scope.keep(_split(split.select("hash", "cid", "n"), labels), "split")
    if split.isEmpty():
        return labels
    groups = scope.keep(_merged(split), "groups")
    counts = groups.groupBy("hash").agg(F.count(F.lit(1)).alias("members"))
    maps = scope.keep(maps.join(groups.select("cid").distinct(), "cid"), "maps")
    few = _split(groups.join(counts.where(F.col("members") <= DENSE).select("hash"), "hash"), labels)
    labels = linked(labels, _each_with_each(few.join(maps, "cid")))
    many = scope.keep(groups.join(counts.where(F.col("members") > DENSE).select("hash"), "hash"), "many")
    marked = scope.keep(maps.join(many.groupBy("cid").agg(F.collect_list("hash").alias("columns")), "cid"), "maps")
    for best in (True, True, False):  # the likeliest partners first, twice, then all others
        split = scope.keep(_split(many, labels).join(marked, "cid"), "split")
        if split.isEmpty():
            break
        labels = linked(labels, _blocked(split, best).distinct())
    return labels


def jaccard_components(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """``(_row, doc_id, n_shingles, component_id, first)``, one row per input row.

    ``component_id`` is the smallest doc_id that links reach from the document, its own
    included; ``first`` marks one row per component, a row with that doc_id. A document
    without words has no shingles, links with nothing and is ``first``. Null text counts
    as empty; a null doc_id is never the smallest unless it is alone; repeated rows are
    equal sets and so one component. With ``keyed`` the rows carry their key too.
    """
    spark = docs.sparkSession
    with Scope(spark) as scope:
        rows = docs.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            (row_key() if keyed else F.lit(None).cast("binary")).alias(KEY),
            F.col("text").cast("string"),
        )
        frequencies = scope.keep(shingle_frequencies(rows), "frequencies")
        last = frequent_shingles(frequencies)
        several = bit_filter(frequencies.select("hash"), shared_bits(frequencies.count()))
        prints = scope.keep(fingerprints(rows, last, several), "prints")
        classes = scope.keep(
            prints.where("n > 0")
            .groupBy("digest", "n")
            .agg(
                F.min("_row").alias("cid"),
                F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least"),
                F.first("prefix").alias("prefix"),
                F.first("bits").alias("bits"),
            ),
            "classes",
        )
        postings = classes.select("cid", "n", F.explode("prefix").alias("hash"))
        # In the zone, a shingle of one document alone is known to be of no use.
        inside = (F.col("hash") >= 0) & (F.col("hash") < int(_ZONE_END))
        shared = postings.where(inside).join(frequencies, "hash", "left_semi")
        useful = scope.keep(shared.unionByName(postings.where(~inside)), "postings")
        scope.drop(frequencies)
        sizes = useful.groupBy("hash").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        columns = scope.keep(useful.join(sizes, "hash"), "columns")
        scope.drop(useful)

        def sets_of(wanted: DataFrame) -> DataFrame:
            return scope.keep(class_sets(rows, wanted.join(classes.select("cid", "digest"), "cid")), "sets")

        found = _linked(scope, columns, classes.select("cid", "bits"), sets_of)
        known = classes.select("digest", "cid", "least").join(found, "cid", "left").withColumn(
            "component", F.coalesce("component", "cid")
        )
        known = scope.keep(known, "known")
        least = known.groupBy("component").agg(F.min("least").alias("least"))
        named = scope.keep(known.select("digest", "component").join(least, "component"), "named")
        out = prints.select("_row", "doc_id", KEY, "n", "digest").join(named, "digest", "left")
        result = out.select(
            "_row",
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
            *([KEY] if keyed else []),
            ((F.col("n") == 0) | (F.col("least._row") == F.col("_row"))).alias("first"),
        )
        return materialize(result, "jaccard")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Only rows that may belong to a component of several take part in the join with the
    decisions; a filter of fixed size lets all others pass where they stand.
    """
    with Scope(docs.sparkSession) as scope:
        found = scope.keep(jaccard_components(docs, keyed=True), "decided")
        several = found.where(~F.col("first")).select("component_id").distinct()
        alike = F.col("component_id").eqNullSafe(F.col("_other"))
        doubted = found.join(several.withColumnRenamed("component_id", "_other"), alike, "left_semi")
        doubted = scope.keep(doubted.select(KEY, F.col("first").cast("int").alias("_row_copies")), "doubted")
        shared = bit_filter(doubted.select(F.xxhash64(KEY).alias("hash")))
        keyed = docs.withColumn("_row_maybe", may_hold(shared, F.xxhash64(row_key())))
        decided = doubted.groupBy(KEY).agg(F.max("_row_copies").alias("_row_copies"))
        maybe = keyed.where("_row_maybe").drop("_row_maybe").withColumn(KEY, row_key()).join(decided, KEY, "left")
        nth = F.row_number().over(Window.partitionBy(KEY).orderBy(F.lit(0)))
        # A row outside of all groups that the filter let through stays with all its repeats.
        kept = maybe.withColumn("_row_nth", F.when(F.col("_row_copies").isNull(), 1).otherwise(nth)).where(
            F.coalesce(F.col("_row_copies"), F.lit(1)) * F.col("_row_nth") == 1
        )
        sure = keyed.where(~F.col("_row_maybe")).select(*docs.columns)
        return materialize(sure.unionByName(kept.select(*docs.columns)), "firsts")
