"""What one Python worker holds of a table, and how many workers a task needs."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from corpusmill.llm import jaccard, quality


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_meet_posteriors_in_one_worker(spark):
    docs = spark.createDataFrame(
        [(i, f"some words of {i}, and more" if i % 2 else "$$ ## @@", "en", f"host{i % 3}") for i in range(60)],
        "doc_id bigint, text string, lang string, source string",
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    good = quality.good_documents(docs, labels)
    assert plan_of(good).count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in good.collect()) == list(range(1, 60, 2))


def test_sets_of_classes_need_one_worker(documents):
    texts = [f"a text of {i} words and its own set of shingles" for i in range(200)] + ["", None]
    rows = documents(texts)
    none = rows.sparkSession.sparkContext.broadcast(np.zeros(1 << 10, np.uint64))
    prints = jaccard.fingerprints(
        rows.select(F.col("doc_id").alias("_row"), "doc_id", F.lit(None).cast("binary").alias(jaccard.KEY), "text"),
        np.empty(0, np.uint64), none,
    )
    wanted = prints.where("n > 0 and _row % 50 = 3").select(F.col("_row").alias("cid"), "digest")
    found = jaccard.class_sets(rows.unionByName(rows), wanted.localCheckpoint())
    assert "ArrowEvalPython" not in plan_of(found)
    got = {r.cid: r.shingles for r in found.collect()}
    sets = [s.view(np.int64).tolist() for s in jaccard.shingle_sets(texts)]
    assert got == {i: sets[i] for i in (3, 53, 103, 153)}


def column_members(spark, rng, count):
    """Members of two columns, their bits near those of a few texts, in components of different size."""
    rows, texts = [], [[rng.getrandbits(63) for _ in range(2)] for _ in range(4)]
    for cid in range(count):
        bits = [w ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for w in rng.choice(texts)]
        own = [7, 9] if cid % 3 == 0 else [7 + 2 * (cid % 2)]
        n = sum(b.bit_count() for b in bits) + rng.randrange(9)
        rows += [(h, cid, n, rng.choice([0, 0, 1, 2, cid]), bits, own) for h in own]
    schema = "hash bigint, cid bigint, n bigint, component bigint, bits array<bigint>, columns array<bigint>"
    component = {cid: c for _, cid, _, c, _, _ in rows}
    rows = [(h, cid, n, component[cid], bits, own) for h, cid, n, _, bits, own in rows]
    return rows, spark.createDataFrame(rows, schema)


def brute_pairs(rows):
    out, size = set(), lambda n: int(np.floor(np.log(n) / np.log(100 / jaccard.PERCENT) + 1e-9))
    for h in {r[0] for r in rows}:
        column = [r for r in rows if r[0] == h]
        members = {c: sum(r[3] == c for r in column) for c in {r[3] for r in column}}
        largest = max(members, key=lambda c: (members[c], c))
        for x in column:
            for y in column:
                if x[3] == y[3] or x[3] == largest or abs(size(x[2]) - size(y[2])) > 1:
                    continue
                ones = [sum(b.bit_count() for b in r[4]) for r in (x, y)]
                common = sum((a & b).bit_count() for a, b in zip(x[4], y[4], strict=True))
                most = min(x[2] - ones[0], y[2] - ones[1]) + common
                if most * (100 + jaccard.PERCENT) >= jaccard.PERCENT * (x[2] + y[2]) and min({*x[5]} & {*y[5]}) == h:
                    out.add((min(x[1], y[1]), max(x[1], y[1])))
    return out


@pytest.mark.parametrize("block,visit,visitors", [(4096, 8192, 512), (32, 16, 5), (1, 1, 1)])
def test_blocks_lose_no_pair(spark, monkeypatch, block, visit, visitors):
    rows, split = column_members(spark, random.Random(3), 120)
    for name, value in (("BLOCK_ROWS", block), ("VISIT_ROWS", visit), ("VISITORS", visitors)):
        monkeypatch.setattr(jaccard, name, value)
    every = brute_pairs(rows)
    got = {tuple(r) for r in jaccard._blocked(split, False).collect()}
    best = {tuple(r) for r in jaccard._blocked(split, True).collect()}
    assert got == every and len(every) > 20
    assert best and best <= {tuple(sorted((x[1], y[1]))) for x in rows for y in rows if x[3] != y[3]}


def test_visits_of_a_block_are_dealt(spark, monkeypatch):
    """However many members lie outside of the largest component, a group's size is bounded."""
    real, members = GroupedData.applyInPandas, 2000
    counted = lambda key, rows: pd.DataFrame({"a": [len(rows)], "b": [0]})
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: real(self, counted, schema))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 64)
    monkeypatch.setattr(jaccard, "VISIT_ROWS", 64, raising=False)
    split = spark.range(members).select(
        F.lit(7).cast("long").alias("hash"), F.col("id").alias("cid"), F.lit(100).cast("long").alias("n"),
        (F.col("id") % 8).alias("component"), F.array(F.lit(0).cast("long")).alias("bits"),
        F.array(F.lit(7).cast("long")).alias("columns"),
    )
    sizes = [r.a for r in jaccard._blocked(split, True).collect()]
    assert max(sizes) < 4 * 64 and sum(sizes) > members


def similar(one, two):
    shared = len(one & two)
    return 100 * shared >= jaccard.PERCENT * (len(one) + len(two) - shared)


def near_sets(rng, bases, copies):
    """Sets around the limit of overlap, with passages that many of them have."""
    passages, sets = [[rng.getrandbits(62) for _ in range(40)] for _ in range(3)], []
    for _ in range(bases):
        base = [rng.getrandbits(62) for _ in range(30)] + rng.choice(passages) + rng.choice(passages)
        for _ in range(copies):
            changed = rng.randrange(14)
            sets.append({*base[changed:], *(rng.getrandbits(62) for _ in range(changed))})
    return sets


def test_new_columns_lose_no_pair(spark):
    """Sets that overlap enough share a column of the rarest first, and a group of merged columns."""
    sets = near_sets(random.Random(5), 6, 12)
    members = spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "cid bigint, n bigint")
    whole = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "cid bigint, shingles array<bigint>")
    columns = jaccard._rarest_first(members, whole).localCheckpoint()
    split = columns.withColumn("component", F.when(F.col("cid") % 12 < 6, F.col("cid") - F.col("cid") % 12).otherwise(F.col("cid")))
    groups = jaccard._merged(split)
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if similar(sets[i], sets[j])}
    for table in (columns, groups):
        held = {}
        for r in table.collect():
            held.setdefault(r.hash, set()).add(r.cid)
        assert all(any({*p} <= m for m in held.values()) for p in pairs) and len(pairs) > 50
    # The passages are of half of all sets; no column is. And copies come once per group, not once per column.
    assert columns.groupBy("hash").count().agg(F.max("count")).first()[0] < len(sets) / 2
    assert groups.count() < columns.count() / 4


@pytest.mark.parametrize("dense", [4, 16])
def test_hot_columns_of_copies_are_multiplied_once(spark, monkeypatch, dense):
    """Copies that share many columns: a member comes to products a few times, not once per column."""
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(304)]
    texts = [" ".join(words)]
    for _ in range(40):  # 6 to 15 words apart changed, five shingles each: 6 are near enough to the text
        copy = list(words)
        for at in rng.sample(range(0, 300, 12), rng.randrange(6, 16)):
            copy[at] = f"v{at}{rng.randrange(2)}"
        texts.append(" ".join(copy))
    seen, real = [], jaccard._blocked
    monkeypatch.setattr(jaccard, "_blocked", lambda split, best: seen.append(split.count()) or real(split, best))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    sets, least = [{*s.tolist()} for s in jaccard.shingle_sets(texts)], list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if similar(sets[i], sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    assert got == dict(enumerate(least))
    assert max(seen, default=0) <= 8 * len(texts)


def test_the_filter_grows_with_its_hashes():
    assert jaccard.shared_bits(0) == jaccard.shared_bits(1000) == jaccard.FILTER_BITS
    assert all(16 * n < jaccard.shared_bits(n) <= 32 * n for n in (10**6, 3 * 10**6, 10**7))
    assert jaccard.shared_bits(10**9) == jaccard.SHARED_BITS
