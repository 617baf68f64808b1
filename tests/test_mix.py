"""Interleaving against a step-by-step loop."""

import hashlib
import random

import pytest

from corpusmill.config import MixConfig
from corpusmill.operators import mix
from corpusmill.operators.mix import nested_interleave, thresholds, weighted_interleave


def loop(streams, weights, seed):
    """Draw a source, take its next record, look ahead, stop when one is exhausted."""
    at, out, step = {s: 0 for s in weights}, [], 0
    while True:
        u = int(hashlib.md5(f"{seed}:{step}".encode()).hexdigest()[:8], 16)
        source = next(s for s, end in thresholds(weights) if u < end)
        records = streams.get(source, [])
        if at[source] < len(records):
            out.append(records[at[source]])
        at[source] += 1
        if at[source] >= len(records):
            return out
        step += 1


def make(spark, sizes, seed=0):
    rng = random.Random(seed)
    streams = {s: [(s, o) for o in sorted(rng.sample(range(1000), n))] for s, n in sizes.items()}
    rows = [r for records in streams.values() for r in records]
    return streams, spark.createDataFrame(rows, "source string, ord bigint")


@pytest.mark.parametrize(
    "sizes", [{"a": 30, "b": 9, "c": 50}, {"a": 1, "b": 40, "c": 40}, {"a": 25, "b": 0, "c": 25}]
)
def test_weighted(spark, sizes):
    streams, docs = make(spark, sizes)
    weights = {"a": 0.5, "b": 0.2, "c": 0.3}
    got = weighted_interleave(docs, weights, 42, (0, 3)).orderBy("epoch", "pos").collect()
    for epoch in (0, 3):
        rows = [(r.source, r.ord) for r in got if r.epoch == epoch]
        assert rows == loop(streams, weights, 42 + epoch)
        assert [r.pos for r in got if r.epoch == epoch] == list(range(len(rows)))


def test_nested(spark):
    streams, docs = make(spark, {"web": 60, "code": 30, "math": 30, "arxiv": 12, "books": 15})
    config = MixConfig()
    got = nested_interleave(docs, config, 1337, (0, 1, 2)).orderBy("epoch", "pos").collect()
    for epoch in (0, 1, 2):
        inner = loop(streams, config.nested["academic"], 1337 + epoch)
        outer = loop(dict(streams, academic=inner), config.weights, 1337 + epoch)
        assert [(r.source, r.ord) for r in got if r.epoch == epoch] == outer


def test_short_estimate_falls_back_to_the_certain_number(spark, monkeypatch):
    streams, docs = make(spark, {"a": 30, "b": 30})
    real = mix.draws_needed
    monkeypatch.setattr(mix, "draws_needed", lambda n, w: (3, real(n, w)[1]))
    weights = {"a": 0.5, "b": 0.5}
    got = weighted_interleave(docs, weights, 7).orderBy("pos").collect()
    assert [(r.source, r.ord) for r in got] == loop(streams, weights, 7)
