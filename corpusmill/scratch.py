"""Shared scratch space: where intermediate tables are written to cut lineage.

A table written here survives the loss of any executor, unlike blocks cached on
executors, and later stages read only the columns they need from it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder that every executor can reach"
            )
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="corpusmill-")
    return _LOCAL_ROOTS[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written to yet."""
    return f"{scratch_root(spark)}/corpusmill/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and return the table read back from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the scratch space, wherever that lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scope:
    """Intermediate tables of one job, deleted together when the job's result is written.

    ``with Scope(spark) as scope: ... return materialize(result, "result")``: what
    ``scope.keep`` wrote is gone at the end of the block, so nothing returned from it may
    read those tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """``materialize`` with the scope's lifetime."""
        path = new_path(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that later steps don't read."""
        for table in tables:
            path, _ = self.paths.pop(id(table))
            discard(self.spark, path)

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *error: object) -> None:
        self.drop(*[table for _, table in list(self.paths.values())])
