"""Registered pipeline operators against SQL on the smallest tables, and their contracts."""

import os
import sys
from collections import defaultdict

import duckdb
import pytest

from corpusmill.llm.oracles import ORACLES
from corpusmill.llm.queries import QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from check import TABLES, normal  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_all_operators():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize(
    "name",
    [
        "op1_secret_scan", "op3_license_scan", "op4_shard", "op5_pii", "op6_mix", "op7_warc", "op8_top_k",
        "op9_decontaminate", "op10_jaccard_join", "op11_hard_negatives", "op12_sentencepiece", "op13_spelling_variants",
    ],
)
def test_partitioning_does_not_matter(spark, name):
    want = normal(QUERIES[name](spark, FOLDER).toPandas())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 3)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        assert normal(QUERIES[name](spark, FOLDER).toPandas()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_pipeline(spark, tmp_path):
    """Stage by stage: columns, and that each decision takes effect."""
    import corpus_pipeline
    from corpusmill.plans.tables import table

    docs = start = table(spark, FOLDER, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "sharding":
            assert out.columns == start.columns
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in seen.items()}
    good = {r.doc_id for r in QUERIES["op2_quality"](spark, FOLDER).where("kept").collect()}
    assert set(ids["quality"]) == good and len(ids["quality"]) == len(good)
    assert set(ids["near_duplicates"]) < good and len(set(ids["near_duplicates"])) == len(ids["near_duplicates"])
    leaks = {r.doc_id for r in QUERIES["op9_decontaminate"](spark, FOLDER).collect()}
    assert set(ids["decontamination"]) == set(ids["near_duplicates"]) - leaks
    counts = defaultdict(int)
    for i in ids["mixing"]:
        counts[i] += 1
    assert set(counts) <= set(ids["decontamination"]) and max(counts.values()) == 2
    assert sorted(ids["sharding"]) == sorted(ids["mixing"])
    again = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert normal(again) == normal(seen["sharding"].toPandas())


@pytest.mark.parametrize("kind", ["edge", "empty"])
def test_pipeline_of_odd_rows(spark, tmp_path, edge, empty, kind):
    """Nulls, empty and long texts, repeated rows, extra columns of clashing names, and no rows."""
    import corpus_pipeline

    folder = str(tmp_path)
    docs = {"edge": edge, "empty": empty}[kind]
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(8)] if kind == "edge" else []
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, "a row without an id but with a text"), (2, None), (3, "")] if kind == "edge" else []
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    stage_docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, stage_docs, folder)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        stage_docs = spark.read.parquet(f"{folder}/{name}")
        if kind == "empty":
            assert stage_docs.count() == 0
    leaked = [r.text for r in spark.read.parquet(f"{folder}/decontamination").select("text").collect()]
    assert "a row without an id but with a text" not in leaked


def test_native_plans_have_no_python(spark, capsys):
    """Operators 1, 5 and 6 are DataFrame functions all the way."""
    from corpusmill.llm import mixing, pii, secrets
    from corpusmill.plans.tables import table

    docs = table(spark, FOLDER, "documents")
    for df in (secrets.secret_report(docs), pii.pii_report(docs), mixing.mix_report(docs), mixing.mixed_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
