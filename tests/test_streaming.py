"""Streams over a growing folder give the batch result."""

import random

import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from corpusmill.operators.dedup import label_documents
from corpusmill.operators.store import DuplicateStore
from corpusmill.scratch import new_path
from corpusmill.streaming import jobs
from test_dedup import corpus
from test_pack import by_places

SCHEMA = "ord bigint, text string"


def folder(spark, rows, schema=SCHEMA, parts=3):
    """A folder whose files were written one after another, in stream order."""
    path = new_path(spark, "stream_test")
    rows = sorted(rows)
    size = len(rows) // parts + 1
    for i in range(0, len(rows), size):
        part = spark.createDataFrame(rows[i : i + size], schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def one_by_one(spark, path, schema=SCHEMA):
    return jobs.read_documents(spark, path, schema, files_per_batch=1)


def test_split_and_filter(spark):
    path = folder(spark, corpus(2, 60))
    stream = jobs.split_and_filter(one_by_one(spark, path))
    batch = jobs.split_and_filter(spark.read.parquet(path))
    got = jobs.append_to_table(stream.select("ord", "split"), new_path(spark, "split"))
    assert sorted(got.collect()) == sorted(batch.select("ord", "split").collect())


def test_dedup_streams(spark, tmp_path):
    path = folder(spark, corpus(6, 80))
    docs = spark.read.parquet(path)
    for near in (True, False):
        store = DuplicateStore(spark, str(tmp_path / f"store{near}"))
        stream = one_by_one(spark, path)
        query = jobs.dedup_stream(stream, store, str(tmp_path / f"check{near}"), near)
        query.awaitTermination()
        assert len(query.recentProgress) >= 3  # several micro-batches
        want = label_documents(docs)
        if not near:
            want = want.withColumn("label", F.regexp_replace("label", "near_dup", "kept"))
        assert sorted(store.labels().collect()) == sorted(want.collect())
    distinct = jobs.append_to_table(
        jobs.distinct_texts(one_by_one(spark, path)).select("digest"), new_path(spark, "distinct")
    )
    assert distinct.count() == want.where("label = 'kept'").count()


TOKENS = "ord bigint, tokens array<int>"


def shard_lists(blocks, shard):
    return [list(r.tokens) for r in sorted(blocks, key=lambda r: r.block_idx) if r.shard == shard]


def test_pack_stream_to_its_end(spark, tmp_path):
    """One delivery or many give the whole packing of each shard, its last block included."""
    rng = random.Random(4)
    rows = [(o, [rng.randrange(3, 99) for _ in range(rng.choice([0, 1, 7, 8, 15, 16, 19]))]) for o in range(60)]
    for parts in (1, 7):
        path = folder(spark, rows, TOKENS, parts)
        for lossless in (True, False):
            store = jobs.PackStore(spark, str(tmp_path / f"store{parts}{lossless}"), 2, 8, lossless)
            stream = one_by_one(spark, path, TOKENS)
            jobs.pack_stream(stream, store, str(tmp_path / f"check{parts}{lossless}")).awaitTermination()
            got = store.finish().collect()
            for shard in (0, 1):
                assert shard_lists(got, shard) == by_places([t for o, t in rows if o % 2 == shard], 8, lossless)


def test_pack_stream_restarts_after_growth(spark, tmp_path):
    rows = [(o, [5] * 3) for o in range(40)]
    path = folder(spark, rows[:10], TOKENS, 1)
    for grown in (False, True):
        if grown:
            spark.createDataFrame(rows[10:], TOKENS).coalesce(1).write.mode("append").parquet(path)
        store = jobs.PackStore(spark, str(tmp_path / "store"), 4, 8)
        jobs.pack_stream(one_by_one(spark, path, TOKENS), store, str(tmp_path / "check")).awaitTermination()
    store.add(spark.createDataFrame(rows[10:], TOKENS), 1)  # a repeated group changes nothing
    got = store.finish().collect()
    for shard in range(4):
        assert shard_lists(got, shard) == by_places([t for o, t in rows if o % 4 == shard], 8)
    with pytest.raises(ValueError, match="begun with"):
        jobs.PackStore(spark, str(tmp_path / "store"), 5, 8)
    ten = [(o, [7] * 3) for o in range(10)]
    store = jobs.PackStore(spark, str(tmp_path / "few"), 1, 1024)
    store.add(spark.createDataFrame(ten, TOKENS), 0)
    assert store.blocks().count() == 0 and store.finish().count() == 1


def test_pack_group_is_not_gathered(spark, tmp_path, monkeypatch):
    """Tokens of a shard never meet in one Python group; tails and repeated places still count."""
    rng = random.Random(9)
    rows = [(o, [rng.randrange(3, 99) for _ in range(rng.choice([0, 3, 8, 21]))]) for o in range(-9, 70)]
    rows += [(30, [1, 2]), (30, [1, 1])]
    seen = []
    original = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda g, f, schema: seen.append(g._df.columns) or original(g, f, schema))
    monkeypatch.setattr(GroupedData, "cogroup", lambda g, other: pytest.fail("shards are gathered"))
    for lossless in (True, False):
        store = jobs.PackStore(spark, str(tmp_path / f"store{lossless}"), 3, 8, lossless)
        for group, (low, high) in enumerate([(-9, 20), (20, 21), (21, 70)]):
            store.add(spark.createDataFrame([r for r in rows if low <= r[0] < high], TOKENS), group)
        got = store.finish().collect()
        for shard in range(3):
            assert shard_lists(got, shard) == by_places([t for o, t in sorted(rows) if o % 3 == shard], 8, lossless)
    assert seen and not any("tokens" in columns for columns in seen)
