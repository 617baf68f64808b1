"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.plans.oracles import ORACLES
from corpusmill.plans.queries import QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
from check import TABLES, normal  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():  # the pipeline operators have tests of their own
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", ["packed_corpus", "near_dedup", "loss_ema", "dense_ids"])
def test_partitioning_does_not_matter(spark, db, name):
    want = normal(db.execute(entry.oracle_sql()[name]).df())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        for partitions in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert normal(entry.queries()[name](spark, FOLDER).toPandas()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_tasks_do_not_import_the_package():
    """From another folder, workers cannot import the package; queries run all the same."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from corpusmill.plans.oracles import ORACLES
from corpusmill.plans.queries import QUERIES
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("minhash_signature", "detokenize", "pack_layout", "stream_pack"):
    assert entry.queries()[name](spark, {FOLDER!r}).count() > 0
from corpusmill.operators.pack import layout
lengths = spark.range(40).selectExpr("0 AS epoch", "id AS pos", "5 AS n")
assert layout(lengths, 8, chunk_bits=2, group_bits=2).count() == 40
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=300
    )
    assert "done" in run.stdout, run.stderr[-2000:]


def test_rows_that_would_prove_nothing(spark, db):
    """Cuts and rules that must bite on the smallest tables."""
    sql = ORACLES["pack_sequences_lossy"]
    lossy = db.execute(sql).df()
    whole = entry.queries()["pack_sequences_lossy"](spark, FOLDER)
    assert whole.count() == len(lossy)
    from corpusmill.plans import queries as q

    assert q._packed(spark, FOLDER, True, q.LOSSY_BLOCK).count() > len(lossy)
    batches = q._val_batches(spark, FOLDER, q._lexicon(spark, FOLDER))
    assert batches.select("batch_id").distinct().count() > q.PREFIX_BATCHES
    assert q.choice_items(spark, FOLDER).count() > q.FIRST_ITEMS
    positions = q.documents(spark, FOLDER).count()
    assert positions >> (q.LEVEL_BITS[0] + 2 * q.LEVEL_BITS[1])  # three levels of packing
