"""Quality of documents: a classifier's evidence, shrunk towards host and path posteriors."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.rows import slices
from corpusmill.scratch import Scope, materialize

MAX_TRAIN = 20_000  # labelled rows the classifier is fitted on at most
HASH_BITS = 14  # of a row's hash that tell which rows can be among them
RIDGE = 1.0  # strength of the pull of weights to 0
STEPS = 30  # of Newton's method at most
KEEP = 0.5  # least posterior of a document that is kept
MOST_SHRINK = 10_000.0  # documents that a prior may count for
UNIT = 1_000_000  # probabilities are summed as whole millionths: sums don't depend on order

_DIGITS = bytes(range(0x30, 0x3A))
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_HIGH = bytes(range(0x80, 0x100))
_SPACE = b" \t\n\x0b\x0c\r"
_MARKS = bytes(c for c in range(0x21, 0x7F) if c not in _DIGITS + _UPPER + _LOWER + b".,;:!?'\"()-")
FEATURES = (
    "log_bytes", "upper", "digits", "marks", "stops", "log_word", "distinct", "top_word",
    "repeats", "marked_words", "upper_words", "log_line", "line_copies", "short_words",
)


def features(text: str | None) -> list[float]:
    """Shares and logs that tell prose from junk, from the whole text; zeros without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    size, n = len(data) - count(_SPACE), len(words)
    counts = Counter(words)
    lines = [line for line in data.split(b"\n") if line]
    line_counts = Counter(lines)
    return [
        math.log1p(len(data)),
        count(_UPPER) / size,
        count(_DIGITS) / size,
        count(_MARKS) / size,
        count(b".,;:!?") / size,
        math.log1p(size / n),
        math.log1p(n / len(counts)),
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words[1:], words)) / n,
        sum(not w[-1:].isalnum() and w[-1] < 0x80 for w in words) / n,
        sum(map(bytes.isupper, words)) / n,
        math.log1p(n / len(lines)) if lines else 0.0,
        sum(c - 1 for c in line_counts.values()) / max(len(lines), 1),
        sum(len(w) == 1 for w in words) / n,
    ]


def _key(column: str) -> Column:
    """A text that tells null from any value."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def document_features(docs: DataFrame) -> DataFrame:
    """``(_row, doc_id, host, path, x)`` of ``docs (doc_id, text, source, lang)``; one scan."""
    kind = dict(docs.dtypes)["doc_id"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            x = np.array([features(t) for t in batch.column(4).to_pylist()]).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, len(FEATURES), dtype=np.int32)), pa.array(x.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], ["_row", "doc_id", "host", "path", "x"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        _key("source").alias("host"),
        _key("lang").alias("path"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(compute, f"_row bigint, doc_id {kind}, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model over standardised features; the last is the constant.

    Newton's method with a ridge on all weights but the constant. Without rows, or with
    one class only, the model is the smoothed share of good rows.
    """
    width = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        return np.concatenate([np.zeros(width), [math.log(share / (1 - share))]])
    mean, std = x.mean(axis=0), x.std(axis=0)
    std[std == 0] = 1.0
    z = np.concatenate([(x - mean) / std, np.ones((len(y), 1))], axis=1)
    pull = np.append(np.full(width, RIDGE), 1e-6)
    w = np.zeros(width + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - pull * w
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    plain = w[:-1] / std
    return np.append(plain, w[-1] - (plain * mean).sum())


def train(computed: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> np.ndarray:
    """Fit on at most ``most`` labelled rows, those first by a hash of their id."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = computed.join(known, "doc_id").select("x", "quality", F.xxhash64("doc_id").alias("h"), "_row")
    # Classes of the hash are counted first, so that hardly more rows than needed are sorted.
    band = F.shiftright("h", 64 - HASH_BITS)
    counts = rows.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy("band").collect()
    total = np.cumsum([r.n for r in counts])
    if len(counts) and total[-1] > most:
        rows = rows.where(band <= counts[int(np.searchsorted(total, most))].band)
    rows = rows.orderBy("h", "_row").limit(most).collect()
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r.quality > 0) for r in rows]))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrink(groups: DataFrame, over: float) -> float:
    """Documents that a prior counts for: how like the groups' means are, beyond chance.

    With prior mean ``m`` and ``k`` pseudo-documents, means of groups spread by
    ``m (1 - m) / (k + 1)``. The spread within documents' probabilities is taken off.
    """
    row = groups.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("p") / F.col("n") / UNIT - over, 2)).alias("between"),
        F.count(F.lit(1)).alias("groups"),
        F.sum("within").alias("within"),
    ).first()
    if not row.n or row.groups < 2:
        return MOST_SHRINK
    chance = row.within / row.n * row.groups / row.n
    spread = row.between / row.n - chance
    if spread <= 0:
        return MOST_SHRINK
    return min(MOST_SHRINK, max(1.0, over * (1 - over) / spread - 1))


def _evidence(x: Column, weights: np.ndarray) -> Column:
    """The classifier's probability in whole millionths, from 1 to ``UNIT - 1``."""
    terms = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights[:-1]]), lambda a, b: a * b)
    score = F.aggregate(terms, F.lit(float(weights[-1])), lambda a, b: a + b)
    chance = 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(30.0)), F.lit(-30.0))))
    return F.greatest(F.least(F.round(chance * UNIT), F.lit(UNIT - 1.0)), F.lit(1.0)).cast("long")


def _posteriors(scope: Scope, scored: DataFrame) -> tuple[DataFrame, float]:
    """``(host, path, host_quality, path_quality)`` and the global mean, by grouped sums."""
    e = F.col("e") / UNIT
    paths = scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("p"), F.sum(e * (1 - e)).alias("within")
    )
    paths = scope.keep(paths, "paths")
    hosts = scope.keep(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "p", "within")]), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("p")).first()
    overall = (total[1] / total[0] / UNIT) if total[0] else 0.5
    k_host, k_path = _shrink(hosts, overall), _shrink(paths, overall)
    host_mean = (F.col("p") / UNIT + k_host * overall) / (F.col("n") + k_host)
    hosts = hosts.select("host", host_mean.alias("host_quality"))
    path_mean = (F.col("p") / UNIT + k_path * F.col("host_quality")) / (F.col("n") + k_path)
    known = paths.join(hosts, "host").select("host", "path", "host_quality", path_mean.alias("path_quality"))
    return materialize(known, "posteriors"), overall


def _judged(scored: DataFrame, known: DataFrame, overall: float, keep: float) -> DataFrame:
    """Add the posterior of each document with evidence ``e``, and whether it is kept.

    The join is broadcast by Spark if the written table of posteriors is small enough.
    """
    odds = _logit(F.col("e") / UNIT) + _logit(F.col("path_quality")) - math.log(overall / (1 - overall))
    joined = scored.join(known, ["host", "path"]).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return joined.withColumn("kept", F.col("posterior") >= keep)


def quality_scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """``(_row, doc_id, evidence, host_quality, path_quality, posterior, kept)`` per input row.

    ``evidence`` is the classifier's probability from the text. A host's (``source``)
    posterior mean is the mean evidence of its documents, shrunk to the global mean as if
    that were seen on ``k`` documents more; a path's (host and ``lang``) is shrunk to its
    host's. The priors' strengths come from the spread of the groups' means, by grouped
    sums over all documents. A document's odds are its evidence times the odds of its
    path against the global ones. Null hosts and languages are groups of their own; null
    text counts as empty; labels of unknown documents and null labels are not used.
    """
    with Scope(docs.sparkSession) as scope:
        computed = scope.keep(document_features(docs), "features")
        weights = train(computed, labels)
        scored = computed.select("_row", "doc_id", "host", "path", _evidence(F.col("x"), weights).alias("e"))
        scored = scope.keep(scored, "evidence")
        known, overall = _posteriors(scope, scored)
        result = _judged(scored, known, overall, keep).select(
            "_row",
            "doc_id",
            (F.col("e") / UNIT).alias("evidence"),
            *[F.round(c, 6).alias(c) for c in ("host_quality", "path_quality", "posterior")],
            "kept",
        )
        return materialize(result, "quality")


def good_documents(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` keeps.

    The evidence is computed once for the posteriors and again in the scan that filters,
    so that texts meet the posteriors of their path without a shuffle of texts.
    """

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    # Else the filter that Spark derives from the join computes it once more, in a worker of its own.
    measured = measured.asNondeterministic()

    with Scope(docs.sparkSession) as scope:
        computed = scope.keep(document_features(docs), "features")
        weights = train(computed, labels)
        scored = computed.select("host", "path", _evidence(F.col("x"), weights).alias("e"))
        known, overall = _posteriors(scope, scored)
        again = docs.select(
            *[F.col(c).alias(f"_doc_{i}") for i, c in enumerate(docs.columns)],
            _key("source").alias("host"),
            _key("lang").alias("path"),
            measured(F.col("text").cast("string")).alias("x"),
        ).withColumn("e", _evidence(F.col("x"), weights))
        kept = _judged(again, known, overall, keep).where("kept")
        return kept.select(*[F.col(f"_doc_{i}").alias(c) for i, c in enumerate(docs.columns)])
