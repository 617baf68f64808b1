"""What a stream has seen so far, as hash indexes on disk that groups look up by bucket.

An index is a table of keys dealt over a fixed number of buckets. Each group of documents
adds a run of files, at most one per bucket, and looks its own keys up in the buckets they
fall in; other buckets are neither listed nor opened. Runs are merged by tiers, ``FAN``
of one tier into one of the next, so a bucket has few files however many groups there
were. Rows keep the number of their group: a group that is repeated replaces its own run and
sees earlier groups alone, so it gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import DEDUP_THRESHOLD, NUM_PERM
from corpusmill.functions.minhash import band_shape
from corpusmill.operators.dedup import band_rows, document_labels, exact_digests, fingerprints, greedy_keep, unique_fingerprints
from corpusmill.scratch import discard, materialize

BUCKETS = 64
FAN = 8  # runs of a tier that are merged


class HashIndex:
    """A set of keys ``schema`` with their group, in buckets of the hash of all key columns.

    The number of buckets is fixed with the index and kept in its folder names; opening it
    with another number is an error. A group has at most one run per tier, named
    ``tier-low-high`` by the groups in it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.schema, self.buckets = spark, schema, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.root = f"{path}/buckets={buckets}"
        others = [f for f in self._folders(path) if f.startswith("buckets=") and f != f"buckets={buckets}"]
        if others:
            raise ValueError(f"{path} was made with {others[0]}")

    def _folders(self, path: str) -> list[str]:
        """Names of the folders in a folder, none if it is missing."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(target):
            return []
        return sorted(s.getPath().getName() for s in system.listStatus(target) if s.isDirectory())

    def runs(self) -> list[tuple[int, int, int]]:
        """``(tier, low, high)`` of the runs; their number grows with the logarithm of the groups'."""
        names = [f for f in self._folders(self.root) if f[:1].isdigit()]
        return sorted(tuple(int(n) for n in f.split("-")) for f in names)

    def bucket(self) -> Column:
        """Bucket of a row of keys."""
        return F.pmod(F.xxhash64(*self.columns), F.lit(self.buckets)).cast("int")

    def paths(self, keys: DataFrame, group: int) -> list[str]:
        """Folders of earlier groups that may hold some of ``keys``."""
        asked = keys.select(self.bucket().alias("bucket")).distinct()
        wanted = {f"bucket={r.bucket}" for r in asked.collect()}  # one number per bucket at most
        found = []
        for tier, low, high in self.runs():
            if low < group:
                run = f"{self.root}/{tier}-{low}-{high}"
                found += [f"{run}/{b}" for b in self._folders(run) if b in wanted]
        return found

    def present(self, keys: DataFrame, group: int) -> DataFrame:
        """Rows of ``keys`` that a group before this one has added, each once."""
        keys = keys.select(*self.columns).distinct()
        paths = self.paths(keys, group)
        if not paths:
            return keys.limit(0)
        stored = self.spark.read.schema(f"{self.schema}, seen_by bigint").parquet(*paths)
        return keys.join(stored.where(F.col("seen_by") < group), self.columns, "left_semi")

    def add(self, keys: DataFrame, group: int) -> None:
        """Add a group's keys, or replace them, and merge runs of earlier groups."""
        rows = keys.select(*self.columns, F.lit(group).cast("bigint").alias("seen_by"))
        self._write(rows, f"{self.root}/0-{group}-{group}")
        self._merge(group)

    def _write(self, rows: DataFrame, path: str) -> None:
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def _merge(self, group: int) -> None:
        """Put ``FAN`` finished runs of a tier together; a row that is there twice does no harm."""
        tier = 0
        while True:
            due = [r for r in self.runs() if r[0] == tier and r[2] < group]
            if not due:
                return
            if len(due) >= FAN:
                folders = [f"{self.root}/{t}-{low}-{high}" for t, low, high in due]
                filled = [f"{f}/{b}" for f in folders for b in self._folders(f)]
                if filled:
                    merged = self.spark.read.schema(f"{self.schema}, seen_by bigint").parquet(*filled)
                    low, high = min(r[1] for r in due), max(r[2] for r in due)
                    self._write(merged.distinct(), f"{self.root}/{tier + 1}-{low}-{high}")
                for folder in folders:
                    discard(self.spark, folder)
            tier += 1


class DuplicateStore:
    """Digests and band keys of the documents seen so far, and the labels given to them.

    Labels do not depend on how the stream is cut into groups. Groups have numbers in
    stream order; a group may be repeated, as streams do after a failure.
    """

    LABELS = "ord bigint, label string"

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        threshold: float = DEDUP_THRESHOLD,
        num_perm: int = NUM_PERM,
        buckets: int = BUCKETS,
    ):
        self.spark, self.path = spark, path
        self.threshold, self.num_perm = threshold, num_perm
        self.bands, _ = band_shape(threshold, num_perm)
        self.seen = HashIndex(spark, f"{path}/digests", "digest binary", buckets)
        self.keys = HashIndex(spark, f"{path}/bands", "band int, key binary", buckets)
        spark.createDataFrame([], self.LABELS).write.mode("ignore").parquet(f"{path}/labels/group=-1")

    def add_exact(self, docs: DataFrame, group: int) -> DataFrame:
        """``(ord, label)`` of one group by digest alone."""
        prints = materialize(exact_digests(docs), "digests")
        firsts = prints.groupBy("digest").agg(F.min("ord").alias("ord"))
        new = materialize(firsts.join(self.seen.present(prints, group), "digest", "left_anti"), "new")
        self.seen.add(new, group)
        return self._label(document_labels(prints, new, new), group)

    def add(self, docs: DataFrame, group: int) -> DataFrame:
        """``(ord, label)`` of one group, exact and near duplicates."""
        prints = fingerprints(docs, self.threshold, self.num_perm)
        unique = unique_fingerprints(prints).select("digest", "ord", "keys")
        new = materialize(unique.join(self.seen.present(prints, group), "digest", "left_anti"), "new")
        stored = materialize(self.keys.present(band_rows(new), group), "stored_keys")
        kept = materialize(greedy_keep(new, self.bands, stored), "kept")
        self.seen.add(new, group)
        self.keys.add(band_rows(new.join(kept, "ord", "left_semi")), group)
        return self._label(document_labels(prints, new, kept), group)

    def _label(self, labels: DataFrame, group: int) -> DataFrame:
        path = f"{self.path}/labels/group={group}"
        labels.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.LABELS).parquet(path)

    def labels(self) -> DataFrame:
        """Labels of all groups so far."""
        return self.spark.read.schema(f"{self.LABELS}, group bigint").parquet(f"{self.path}/labels").drop("group")
