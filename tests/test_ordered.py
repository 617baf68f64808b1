"""Global index and running operators over chunks."""

import random

from corpusmill.operators.ordered import global_index, previous_row, running_min_before, running_total, take_first


def _rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for group, size in (("hot", 300), ("cold", 17), ("one", 1)):
        for o in rng.sample(range(5000), size):
            rows.append((group, o, rng.random()))
    rng.shuffle(rows)
    return rows


def test_index_across_parts(spark):
    rows = _rows()
    for scale, shift in ((1, 0), (1, -2500), (1 << 40, 0)):  # dense, negative, sparse orders
        placed = [(g, scale * o + shift, v) for g, o, v in rows]
        df = spark.createDataFrame(placed, "g string, ord bigint, v double")
        got = {(r.g, r.ord): r.idx for r in global_index(df, "ord", ["g"]).collect()}
        for g in ("hot", "cold", "one"):
            for i, o in enumerate(sorted(o for h, o, _ in placed if h == g)):
                assert got[g, o] == i
    whole = {r.ord: r.idx for r in global_index(df.where("g = 'hot'")).collect()}
    assert sorted(whole.values()) == list(range(300))


def test_running_total(spark):
    df = spark.createDataFrame([("a", i, i * i) for i in range(100)], "g string, ord bigint, v bigint")
    got = {r.ord: r.total for r in running_total(df, "v", "ord", ["g"]).collect()}
    assert got == {i: sum(j * j for j in range(i + 1)) for i in range(100)}


def test_take_first(spark):
    df = spark.createDataFrame(_rows(), "g string, ord bigint, v double")
    got = sorted(r.ord for r in take_first(df, 5, by=["g"]).where("g = 'hot'").collect())
    assert got == sorted(o for g, o, _ in _rows() if g == "hot")[:5]


def test_previous_and_running_min(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "g string, ord bigint, v double")
    idx = global_index(df, "ord", ["g"], "i")
    got = previous_row(idx, ["v"], ["g"], "i", bits=3)
    got = running_min_before(got, "v", ["g"], "i", bits=3)
    by = {(r.g, r.i): r for r in got.collect()}
    for g in ("hot", "cold", "one"):
        values = [v for _, v in sorted((o, v) for h, o, v in rows if h == g)]
        for i in range(len(values)):
            assert by[g, i].prev_v == (values[i - 1] if i else None)
            assert by[g, i].min_before == (min(values[:i]) if i else None)


def test_hot_group_is_split_over_window_partitions(spark):
    df = spark.createDataFrame(_rows(), "g string, ord bigint, v double")
    plan = global_index(df, "ord", ["g"])._jdf.queryExecution().executedPlan().toString()
    # Row numbers are given per part; only the table of part counts is grouped by g.
    numbering = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert numbering and all("_part" in line.split("row_number()")[1] for line in numbering)
    assert "SinglePartition" not in plan
