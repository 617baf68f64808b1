"""Sub-words against the public library, and back to the text."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.subword import Ranks, SubwordTokenizer
from corpusmill.plans.queries import SUBWORD_RANKS, subword_tokenizer, subword_tokenize
from corpusmill.plans.tables import table

FOLDER = "/root/testdata/sf0.001"
PARTS = [
    "a", "The", " the", "don't", "we'll", "'S", "  ", " ", "\t", "\n", "\n\n", "é", "日本", "語", "\U0001f600", "12", " 345",
    "...", " !?", "\u00a0", "\u3000", "\x1c", "\x85", "e\u0301", "ﬁ", "<|endoftext|>", "_x_", "\x00", "\u200b", "x" * 40,
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(SUBWORD_RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_like_the_library_and_back(spark, library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(1500)]
    texts += ["", "word " * 20_000, "x" * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id bigint, text string").repartition(4)
    tokenizer = subword_tokenizer(spark)
    rows = docs.select("id", "text", tokenizer.encode(F.col("text")).alias("ids"))
    rows = rows.withColumn("back", tokenizer.decode(F.col("ids"))).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or ""), repr(r.text)
        assert r.back == (r.text or "")


def test_query(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in subword_tokenize(spark, FOLDER).collect()}
    for r in table(spark, FOLDER, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert not got


def test_ids_without_a_text(spark):
    ranks = Ranks([bytes([b]) for b in range(256)] + [b"ab"])
    tokenizer = SubwordTokenizer(spark, ranks)
    rows = spark.createDataFrame([([256, 257, 99],), ([0xC3],), (None,), ([-1],)], "ids array<int>")
    assert [r[0] for r in rows.select(tokenizer.decode(F.col("ids"))).collect()] == ["abc", "\ufffd", "", ""]


def test_words_may_be_forgotten(spark, library, monkeypatch):
    from corpusmill.functions import subword

    monkeypatch.setattr(subword, "REMEMBERED", 2)
    ranks = Ranks.read(spark, SUBWORD_RANKS)
    for word in ("one", " two", "three", "one", " two"):
        assert ranks.ids(word) == library.encode_ordinary(word)


def test_vocabularies_are_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="256 bytes"):
        Ranks([b"a"])
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="from 0 on"):
        Ranks.read(spark, str(path))
