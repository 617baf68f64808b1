"""Benchmark items in training texts: BM25 with block maxima, then overlap is verified.

Items are indexed, training passages are the queries. Items lie in blocks of like
length. A block's passages are windows of a text twice as long as its longest item, each
starting half a window after the last, so an occurrence of an item stands whole in one.

The index holds postings only, so its size grows as the words of its items. A text's
terms are walked as in block-max WAND: terms too weak to lift any item together open no
block, a block is opened where its terms' block maxima reach its least threshold, and its
windows are scored where their block maxima do.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import WORDS, combine, run_hashes, word_hashes
from corpusmill.scratch import Scope, materialize

K1, B = 1.2, 0.75
SHARE = 0.6  # of an item's score against itself that a passage must reach
OVERLAP = 0.8  # of an item's shingles that must stand in the text
PART_OVERLAP = 0.5  # and of its question's and its answer's
BLOCK = 16  # items of one block
INDEX_BYTES = 4 << 20  # of item texts in one index
BROADCAST_BYTES = 32 << 20  # of one serialised index, which is broadcast
SLACK = 1e-3  # for rounding of sums against thresholds
LEAST_WINDOW = 16  # words


def _shingle_set(words: np.ndarray) -> np.ndarray:
    """Distinct shingles; of fewer words, the whole sequence as one; none without words."""
    return np.unique(combine(words)) if len(words) else np.empty(0, np.uint64)


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, each as if it were a text of its own."""
    if size >= WORDS or len(words) < size:
        return _shingle_set(words) if size >= WORDS else np.empty(0, np.uint64)
    return run_hashes(words, size)


def _text_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return word_hashes(data)[1]


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


@dataclass
class Block:
    """Items of like length and the postings of their terms."""

    items: np.ndarray  # numbers in the index
    window: int
    thresholds: np.ndarray  # items
    terms: np.ndarray  # vocabulary numbers, ascending
    starts: np.ndarray  # of each term's postings, and their end
    places: np.ndarray  # per posting, in ``items``
    impacts: np.ndarray  # per posting
    maxima: np.ndarray  # largest impact per term

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Places of vocabulary numbers in ``terms``, its length for others."""
        at = np.searchsorted(self.terms, terms)
        hit = self.terms[np.minimum(at, len(self.terms) - 1)] == terms
        return np.where(hit, at, len(self.terms))

    def scores(self, own: np.ndarray) -> np.ndarray:
        """BM25 scores of the items for distinct places in ``terms``."""
        chosen = _spread(self.starts[own], self.starts[own + 1])
        return np.bincount(self.places[chosen], weights=self.impacts[chosen], minlength=len(self.items))


class ItemIndex:
    """Inverted index of a bounded list of items with BM25 impacts, in blocks."""

    def __init__(self, items: Sequence[tuple[int, str]], frequency: dict[int, int], count: int, mean: float):
        """``frequency``, ``count`` and ``mean``: document frequencies, number and mean
        length of all items, of which these may be a part."""
        self.ids = [i for i, _ in items]
        words = [_text_words(t) for _, t in items]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
        df = np.array([frequency[int(w)] for w in self.vocabulary.view(np.int64)], dtype=float)
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        halves = [-(-len(w) // 2) for w in words]
        self.sizes = [len(w) for w in words]
        self.whole = [_shingle_set(w) for w in words]
        self.question = [_shingle_set(w[:h]) for w, h in zip(words, halves, strict=True)]
        self.answer = [_shingle_set(w[h:]) for w, h in zip(words, halves, strict=True)]
        order = sorted((i for i in range(len(words)) if len(words[i])), key=lambda i: (len(words[i]), self.ids[i]))
        self.blocks = []
        for at in range(0, len(order), BLOCK):
            chosen = order[at : at + BLOCK]
            rows, impacts = [], []
            for i in chosen:
                terms, tf = np.unique(words[i], return_counts=True)
                rows.append(np.searchsorted(self.vocabulary, terms))
                norm = K1 * (1 - B + B * len(words[i]) / mean)
                impacts.append((idf[rows[-1]] * tf * (K1 + 1) / (tf + norm)).astype(np.float32))
            flat, weight = np.concatenate(rows), np.concatenate(impacts)
            places = np.repeat(np.arange(len(chosen), dtype=np.int32), [len(r) for r in rows])
            by_term = np.argsort(flat, kind="stable")
            terms, starts = np.unique(flat[by_term], return_index=True)
            self.blocks.append(
                Block(
                    np.array(chosen),
                    2 * max(LEAST_WINDOW // 2, len(words[chosen[-1]])),
                    np.array([x.sum(dtype=float) * SHARE for x in impacts]),
                    terms.astype(np.int32),
                    np.append(starts, len(flat)).astype(np.int32),
                    places[by_term],
                    weight[by_term],
                    np.maximum.reduceat(weight[by_term], starts),
                )
            )
        self._block_postings()

    def _block_postings(self) -> None:
        """Per term, the blocks that hold it and its largest impact in each."""
        self.least = np.array([b.thresholds.min() for b in self.blocks]) - SLACK
        sizes = [len(b.terms) for b in self.blocks]
        terms = np.concatenate([b.terms for b in self.blocks] or [np.empty(0, np.int32)])
        maxima = np.concatenate([b.maxima for b in self.blocks] or [np.empty(0, np.float32)])
        by_term = np.argsort(terms, kind="stable")
        self.in_block = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by_term]
        self.block_maxima = maxima[by_term]
        self.term_starts = np.searchsorted(terms[by_term], np.arange(len(self.vocabulary) + 1))
        self.term_maxima = np.zeros(len(self.vocabulary))
        np.maximum.at(self.term_maxima, terms, maxima)

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, -1 for unknown ones."""
        if not len(self.vocabulary):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def opened(self, distinct: np.ndarray) -> np.ndarray:
        """Blocks in which some item may reach its threshold by the given terms.

        Terms in order of their largest impact: the weakest, which together stay below
        the least threshold of all, cannot lift an item alone. The others' postings are
        walked, and the weakest count by their sum.
        """
        largest = self.term_maxima[distinct]
        order = np.argsort(largest, kind="stable")
        sums = np.cumsum(largest[order])
        pivot = int(np.searchsorted(sums, self.least.min()))
        if pivot == len(order):
            return np.empty(0, np.int64)
        strong = distinct[order[pivot:]]
        chosen = _spread(self.term_starts[strong], self.term_starts[strong + 1])
        bounds = np.bincount(self.in_block[chosen], weights=self.block_maxima[chosen], minlength=len(self.blocks))
        return np.flatnonzero((bounds > 0) & (bounds + (sums[pivot - 1] if pivot else 0.0) >= self.least))

    def retrieve(self, terms: np.ndarray) -> dict[int, float]:
        """Items that reach their threshold in some window, with their best scores.

        A window holds no more terms than its text, so a block is left where no item
        reaches its threshold by the whole text's terms. A window is skipped if its terms'
        block maxima add up to less than the least threshold of the items left.
        """
        best: dict[int, float] = {}
        known = terms >= 0
        distinct, found = np.unique(terms[known], return_inverse=True)
        if not len(found):
            return best
        rank = None
        for number in self.opened(distinct).tolist():
            block = self.blocks[number]
            own = block.find(distinct)
            held = own < len(block.terms)
            reached = block.scores(own[held]) >= block.thresholds - SLACK
            if not reached.any():
                continue
            if rank is None:
                rank = np.zeros(len(terms) + 1, dtype=np.int64)  # known words in front of each place
                np.cumsum(known, out=rank[1:])
            least = block.thresholds[reached].min() - SLACK
            half = block.window // 2
            starts = np.arange(0, max(len(terms) - half, 1), half)
            low, high = rank[starts], rank[np.minimum(starts + block.window, len(terms))]
            sums = np.zeros(len(found) + 1)
            np.cumsum(np.append(block.maxima, np.float32(0))[own][found], out=sums[1:], dtype=float)
            possible = np.flatnonzero(sums[high] - sums[low] >= least)
            for a, b in zip(low[possible].tolist(), high[possible].tolist(), strict=True):
                here = np.unique(found[a:b])
                scores = block.scores(own[here[held[here]]])
                for j in np.flatnonzero(scores >= block.thresholds - SLACK).tolist():
                    item = int(block.items[j])
                    best[item] = max(best.get(item, 0.0), float(scores[j]))
        return best

    def overlaps(self, item: int, shingles: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's shingles among those given."""
        share = lambda own: float(np.isin(own, shingles).mean()) if len(own) else 1.0
        # A part too short for a shingle of its own stands or falls with the whole.
        whole = share(self.whole[item])
        parts = [
            share(p) if self.long_enough(item) else whole for p in (self.question[item], self.answer[item])
        ]
        return whole, parts[0], parts[1]

    def hits(self, text: str | None) -> list[tuple[int, float, float, float, float]]:
        """``(item_id, score, overlap, question overlap, answer overlap)`` of a text."""
        words = _text_words(text)
        found = self.retrieve(self.terms(words)) if len(words) else {}
        out = []
        if found:
            # Items of fewer words than a shingle has are compared with runs of their own length.
            sizes = {min(self.sizes[i], WORDS) for i in found}
            held = {size: _runs(words, size) for size in sizes}
            for item, score in sorted(found.items()):
                whole, question, answer = self.overlaps(item, held[min(self.sizes[item], WORDS)])
                if whole >= OVERLAP and min(question, answer) >= PART_OVERLAP:
                    out.append((self.ids[item], round(score, 3), whole, question, answer))
        return out

    def long_enough(self, item: int) -> bool:
        """Whether question and answer both have shingles of ``WORDS`` words."""
        return len(self.whole[item]) > WORDS


def _word_table(items: DataFrame) -> DataFrame:
    """``(item_id, words)`` with the hashed words of each item."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_text_words(t).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            flat = np.concatenate(words) if words else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["item_id", "words"])

    return items.select("item_id", "text").mapInArrow(hashed, "item_id bigint, words array<bigint>")


def _serialised(
    items: Sequence[tuple[int, str]], frequency: dict[int, int], count: int, mean: float
) -> Iterator[bytes]:
    """Serialised indexes of ``BROADCAST_BYTES`` at most, or of one item: larger ones are halved.

    As bytes that carry the class along: workers need no copy of this package.
    """
    data = cloudpickle.dumps(ItemIndex(items, frequency, count, mean))
    if len(data) <= BROADCAST_BYTES or len(items) < 2:
        yield data
        return
    half = len(items) // 2
    yield from _serialised(items[:half], frequency, count, mean)
    yield from _serialised(items[half:], frequency, count, mean)


def _indexes(scope: Scope, items: DataFrame) -> Iterator[bytes]:
    """Serialised indexes over parts of the items, each of about ``INDEX_BYTES`` of text at
    most and of ``BROADCAST_BYTES`` at most, or one item.

    Frequencies are counted over all items; a part gets those of its own words.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = scope.keep(rows.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct(), "items")
    words = scope.keep(_word_table(rows), "item_words")
    count, total = words.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not total:
        return
    frequency = scope.keep(
        words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")),
        "item_frequencies",
    )
    parts = 2 * size // INDEX_BYTES + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for p in range(parts):
        chosen = [(r.item_id, r.text) for r in rows.where(part == p).orderBy("item_id", "text").collect()]
        own = words.join(rows.where(part == p).select("item_id"), "item_id", "left_semi")
        own = own.select(F.explode("words").alias("word")).distinct().join(frequency, "word")
        yield from _serialised(chosen, {r.word: r.df for r in own.collect()}, count, total / count)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(_row, doc_id, item_id, score, overlap, question_overlap, answer_overlap)`` per hit.

    A hit is an item that some window of the text retrieves and of whose 5-word shingles
    the text holds ``OVERLAP``, with ``PART_OVERLAP`` of its first and second half; an item
    of one to four words is a hit where they stand one after the other. Every window of every text is a query; null or wordless texts and items match nothing;
    repeated documents are found each, a repeated item counts once per different text.
    Items come in indexes of bounded size, one scan of the texts each.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = (
        f"_row bigint, doc_id {kind}, item_id bigint, score double, overlap double,"
        " question_overlap double, answer_overlap double"
    )
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col("text").cast("string"))
    with Scope(spark) as scope:
        hits = None
        for index in _indexes(scope, benchmark):
            shared = spark.sparkContext.broadcast(index)
            found = rows.mapInArrow(_matcher(shared), schema)
            found = scope.keep(found, "hits")
            hits = found if hits is None else hits.unionByName(found)
        if hits is None:
            return spark.createDataFrame([], schema)
        return materialize(hits, "contaminated")


def _matcher(shared: Broadcast):
    """Task function: the hits of a batch of documents in one index."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = cloudpickle.loads(shared.value)
        for batch in batches:
            places, out = [], []
            for place, text in enumerate(batch.column(2)):
                hits = index.hits(text.as_py())
                places += [place] * len(hits)
                out += hits
            if not out:
                continue
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] + [pa.float64()] * 4, strict=True)]
            chosen = pa.array(places, pa.int64())
            names = ["_row", "doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), *arrays], names)

    return match


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit: each scan drops those of one index in place."""
    with Scope(docs.sparkSession) as scope:
        for index in _indexes(scope, benchmark):
            shared = docs.sparkSession.sparkContext.broadcast(index)
            docs = docs.where(~_has_hit(shared, F.col("text").cast("string")))
    return docs


def _has_hit(shared: Broadcast, text: Column) -> Column:
    @F.arrow_udf("boolean")
    def hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = cloudpickle.loads(shared.value)
        for batch in texts:
            yield pa.array([bool(index.hits(t.as_py())) for t in batch], pa.bool_())

    return hit(text)
