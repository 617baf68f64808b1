"""Arrow lists are worked on in pieces of bounded size, whatever a batch holds."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import pieces as pc
from corpusmill.functions import subword, tokens


def test_pieces_hold_all_rows_in_order():
    rows = [[1] * n for n in (0, 0, 3, 5, 0, 9, 1, 1, 1, 0)]
    batch = pa.array([[7] * 4, *rows], pa.list_(pa.int32())).slice(1)
    old, pc.PIECE_ITEMS = pc.PIECE_ITEMS, 5
    try:
        parts = [p.to_pylist() for p in pc.pieces(iter([batch, batch.slice(0, 0)]))]
    finally:
        pc.PIECE_ITEMS = old
    assert [r for p in parts for r in p] == rows
    assert all(len(p) == 1 or sum(map(len, p)) <= 5 for p in parts)


class _Shared:
    def __init__(self, value):
        self.value = value


class _Vocabulary:
    """What a tokenizer asks of its vocabulary, without a session."""

    sparkContext = property(lambda self: self)
    sparkSession = property(lambda self: self)

    def __init__(self, known):
        self.known = known

    def broadcast(self, value):
        return _Shared(value)

    def agg(self, *_):
        return self

    def first(self):
        return (10,)

    def select(self, *_):
        return self

    def toArrow(self):
        return pa.table({"token": list(self.known), "id": list(self.known.values())})


@pytest.fixture
def functions(monkeypatch):
    """The functions that tokenizers hand to Spark, as they are, by name."""
    made = {}
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda f: made.setdefault(f.__name__, f))
    monkeypatch.setattr(F, "sum", lambda c: c)
    monkeypatch.setattr(F, "octet_length", lambda c: c)
    monkeypatch.setattr(pc, "PIECE_ITEMS", 8)
    return made


def _out(function, batch: pa.Array) -> tuple[list, list[int]]:
    found: Iterator[pa.Array] = function(iter([batch, batch]))
    parts = [p.to_pylist() for p in found]
    return [r for p in parts for r in p], [len(p) for p in parts]


def test_vocabulary_tokens_leave_in_pieces(functions):
    tokens.VocabTokenizer(_Vocabulary({"a": 3, "b": 4}))
    batch = pa.array([["a", "b", "x"]] * 10 + [[]], pa.list_(pa.string()))
    ids, sizes = _out(functions["lookup"], batch)
    assert ids == ([[3, 4, tokens.UNK_ID]] * 10 + [[]]) * 2
    assert max(sizes) <= 3
    texts, sizes = _out(functions["spell"], pa.array(ids[:11], pa.list_(pa.int32())))
    assert texts == (["a b"] * 10 + [""]) * 2
    assert max(sizes) <= 3


def test_subwords_leave_in_pieces(functions, monkeypatch):
    monkeypatch.setattr(subword, "LISTED", 2)
    ranks = subword.Ranks([bytes([b]) for b in range(256)] + [b"ab"])
    subword.SubwordTokenizer(_Vocabulary({}), ranks)
    batch = pa.array([["ab", "c", "é"]] * 10 + [[]], pa.list_(pa.string()))
    ids, sizes = _out(functions["look_up"], batch)
    assert ids == ([[256, 99, 0xC3, 0xA9]] * 10 + [[]]) * 2
    assert max(sizes) <= 3
    texts, sizes = _out(functions["spell"], pa.array(ids[:11], pa.list_(pa.int32())))
    assert texts == (["abcé"] * 10 + [""]) * 2
    assert max(sizes) <= 3
