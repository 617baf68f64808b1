"""Vocabulary, tokenizer and score tables."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.config import BOS_ID, EOS_ID, FIRST_WORD_ID, PAD_ID, UNK_ID
from corpusmill.functions import tokens as tk
from corpusmill.operators import evaluate
from corpusmill.operators.vocab import build_vocab, count_tokens, unigram_scores
from corpusmill.plans.corpus import Lexicon, tokenize

TEXTS = ["The cat, the hat. the END", "a_b c-d é 😀 \x0b x9", "  ", "the the cat " + "z" * 70]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "ord bigint, text string")


@pytest.fixture(scope="module")
def lexicon(docs):
    return Lexicon(docs)


def split(text):
    return re.findall(r"\w+|[^\s\w]", text)


def test_words_like_python(docs):
    for r in docs.select("text", tk.words(F.col("text")).alias("w")).collect():
        assert list(r.w) == split(r.text)


def test_vocabulary_order_and_limits(docs):
    counts = Counter(t for text in TEXTS for t in split(text))
    want = sorted(counts, key=lambda t: (-counts[t], t))
    for size in (FIRST_WORD_ID + 4, 32000):
        rows = build_vocab(count_tokens(docs), size).orderBy("id").collect()
        assert [r.token for r in rows] == want[: size - FIRST_WORD_ID]
        assert [r.id for r in rows] == list(range(FIRST_WORD_ID, FIRST_WORD_ID + len(rows)))
        assert [r.n for r in rows] == [counts[r.token] for r in rows]


def test_encode_and_decode(docs, lexicon):
    ids = {r.token: r.id for r in lexicon.vocab.collect()}
    coded = docs.select("text", lexicon.tokenizer.encode(F.col("text")).alias("ids"))
    coded = coded.withColumn("back", lexicon.tokenizer.decode(F.col("ids")))
    for r in coded.collect():
        assert list(r.ids) == [ids.get(t, UNK_ID) for t in split(r.text)]
        assert r.back == " ".join(t for t in split(r.text) if t in ids)


def test_decode_skips_special_and_foreign_ids(spark, lexicon):
    word = lexicon.vocab.orderBy("id").first()
    df = spark.createDataFrame(
        [([BOS_ID, word.id, EOS_ID, 31999, UNK_ID, word.id],), ([],), (None,)], "ids array<int>"
    )
    got = [r[0] for r in df.select(lexicon.tokenizer.decode(F.col("ids"))).collect()]
    assert got == [f"{word.token} {word.token}", "", ""]


def test_one_python_worker_makes_ids_and_text(spark, lexicon):
    rows = spark.createDataFrame([(0, "the cat"), (1, None), (2, "")], "ord bigint, text string")
    back = tokenize(rows, lexicon.tokenizer, "ord").select("ord", lexicon.tokenizer.decode(F.col("tokens")).alias("text"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.ord: r.text for r in back.collect()} == {0: "the cat", 1: "", 2: ""}
    ids = spark.createDataFrame([(None,), ([],), ([FIRST_WORD_ID, None],)], "ids array<int>").coalesce(1)
    assert [r.t for r in ids.select(lexicon.tokenizer.decode(F.col("ids")).alias("t")).collect()] == ["", "", "the"]


def test_lookup_on_sliced_batches(spark, lexicon):
    df = spark.range(500).select(F.concat(F.lit("the cat "), F.col("id")).alias("text"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        coded = df.where("id % 3 = 1").select(lexicon.tokenizer.encode(F.col("text")).alias("ids"))
        assert coded.distinct().count() == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vocabularies_of_any_length(spark, monkeypatch):
    """More than 32,000 tokens, and tokens of more than 64 characters, are looked up."""
    long = "x" * 300
    rows = spark.range(40_000).select(
        F.concat(F.when(F.col("id") == 39_999, long).otherwise("t"), F.col("id")).alias("token"),
        F.col("id").cast("int"),
        F.lit(1).alias("n"),
    )
    tokenizer = tk.VocabTokenizer(rows)
    df = spark.createDataFrame([(f"t38000 {long}39999 nothing",)], "text string")
    ids = tokenizer.encode(F.col("text"))
    assert df.select(ids).first()[0] == [38_000, 39_999, UNK_ID]
    assert df.select(tokenizer.decode(ids)).first()[0].startswith(f"t38000 {long}39999")
    counts = spark.createDataFrame([(long, 5), ("a", 9)], "token string, n bigint")
    assert [r.token for r in build_vocab(counts).orderBy("id").collect()] == ["a", long]
    monkeypatch.setattr(tk, "VOCAB_BYTES", 1000)
    larger = tk.VocabTokenizer(rows)
    with pytest.raises(ValueError, match="bytes"):
        larger.encode(F.col("text"))
    assert tokenize(df, larger).first().tokens == [38_000, 39_999, UNK_ID]


def test_large_vocabularies_give_the_same_ids(spark, monkeypatch):
    """Without a broadcast, over pages of few tokens and few rows, for all kinds of texts."""
    from corpusmill.operators import vocab as vocab_module

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(60))) for _ in range(900)]
    texts += [None, "", "  ", "!? é", "w1 " * 5000]
    docs = spark.createDataFrame([(i, str(i % 3), t) for i, t in enumerate(texts)], "ord bigint, source string, text string").repartition(3)
    small = build_vocab(count_tokens(docs.where("ord % 2 = 0")), 200)
    want = {r.ord: (r.source, r.tokens) for r in tokenize(docs, tk.VocabTokenizer(small), "ord", "source").collect()}
    monkeypatch.setattr(tk, "VOCAB_BYTES", 1 << 8)
    larger = tk.VocabTokenizer(small)
    assert not larger.fits
    for tokens, rows in ((1 << 15, 1 << 12), (50, 1 << 12), (1 << 15, 70)):
        monkeypatch.setattr(vocab_module, "PAGE_TOKENS", tokens)
        monkeypatch.setattr(vocab_module, "PAGE_ROWS", rows)
        got = {r.ord: (r.source, r.tokens) for r in tokenize(docs, larger, "ord", "source").collect()}
        assert got == want and UNK_ID in got[0][1] + got[1][1] + got[2][1]
    assert tokenize(docs.limit(0), larger, "ord").count() == 0


def test_array_helpers(spark):
    df = spark.createDataFrame([([1, 2, 3, 2],), ([7],), ([],)], "t array<int>")
    got = df.select(
        tk.crop_last(F.col("t"), 2).alias("crop"),
        tk.inputs(F.col("t")).alias("x"),
        tk.targets(F.col("t")).alias("y"),
        tk.counted_targets(F.col("t"), PAD_ID).alias("c"),
        tk.pad_to(F.col("t"), F.lit(5)).alias("p"),
        tk.attention_mask(F.col("t"), F.lit(5)).alias("m"),
    ).collect()
    assert [list(v) for v in got[0]] == [
        [3, 2], [1, 2, 3], [2, 3, 2], [3], [1, 2, 3, 2, 2], [1, 1, 1, 1, 0]
    ]
    assert [list(v) for v in got[1]] == [[7], [], [], [], [7, 2, 2, 2, 2], [1, 0, 0, 0, 0]]
    assert [list(v) for v in got[2]][:4] == [[], [], [], []]


def test_scores_are_add_one_unigram(docs, lexicon):
    counts = Counter(t for text in TEXTS for t in split(text))
    ids = {r.token: r.id for r in lexicon.vocab.collect()}
    total, size = sum(counts.values()), len(ids) + FIRST_WORD_ID
    got = {r.id: r.nll for r in unigram_scores(lexicon.counts, lexicon.vocab).collect()}
    assert got[ids["the"]] == pytest.approx(-math.log((counts["the"] + 1) / (total + size)))
    assert got[UNK_ID] == pytest.approx(-math.log(1 / (total + size)))  # no token is unknown
    assert sum(math.exp(-v) for v in got.values()) == pytest.approx(1.0)


def test_losses_and_their_means(spark):
    scores = spark.createDataFrame([(2, 5.0), (3, 1.0), (4, 2.0)], "id int, nll double")
    rows = [(0, 0, 0, [3, 4, 2, 2]), (0, 0, 1, [4, 3, 3, 2]), (0, 1, 0, [3, 3, 3, 3]), (1, 0, 0, [4, 4, 4, 4])]
    batches = spark.createDataFrame(rows, "epoch int, batch_id bigint, row_in_batch int, tokens array<int>")
    key = ["batch_id", "row_in_batch"]
    scorer = evaluate.table_scorer(scores)
    losses = evaluate.sequence_losses(evaluate.first_batches(batches, 9), scorer, key)
    with_pad = {(r[0], r[1]): r[2] for r in evaluate.mean_nll(losses, key).collect()}
    assert with_pad == {(0, 0): 4.0, (0, 1): pytest.approx(7 / 3), (1, 0): 1.0}
    without = {(r[0], r[1]): r[2] for r in evaluate.mean_nll(losses, key, ignore_pad=True).collect()}
    assert without == {(0, 0): 2.0, (0, 1): 1.0, (1, 0): 1.0}
    # Mean of batch means, not of tokens.
    row = evaluate.val_loss(batches, scorer).first()
    assert row.val_loss == pytest.approx((19 / 6 + 1.0) / 2) and row.batches == 2
    assert evaluate.val_loss(batches, scorer, 1).first().val_loss == pytest.approx(19 / 6)


def test_plugged_in_scorer(spark):
    df = spark.createDataFrame([(0, [3, 4, 5])], "id int, tokens array<int>")
    half = lambda t: F.transform(tk.targets(t), lambda x: x / 2)
    scored = evaluate.token_nll(df, half, ["id"])
    assert [(r.pos, r.token, r.nll) for r in scored.orderBy("pos").collect()] == [(0, 4, 2.0), (1, 5, 2.5)]
    row = evaluate.sequence_losses(df, half, ["id"], pad=5).first()
    assert (row.total, row.n, row.total_real, row.n_real) == (4.5, 2, 2.0, 1)


def test_ids_without_a_score(spark):
    """They have the unknown id's loss; without one, they are an error."""
    df = spark.createDataFrame([([1, 3, 99],)], "tokens array<int>")
    scores = spark.createDataFrame([(UNK_ID, 7.0), (3, 1.0)], "id int, nll double")
    rows = evaluate.token_nll(df, evaluate.table_scorer(scores), []).orderBy("pos").collect()
    assert [(r.token, r.nll) for r in rows] == [(3, 1.0), (99, 7.0)]
    with pytest.raises(Exception, match="no score for id 99"):
        evaluate.token_nll(df, evaluate.table_scorer(scores.where("id = 3")), []).collect()


def test_choices_and_ties(spark, lexicon):
    items = spark.createDataFrame(
        [(0, "the", ["cat", "the", "zzz", "the"], "1"), (1, "the", ["zzz", "qqq"], "1")],
        "item_id bigint, ctx string, endings array<string>, label string",
    )
    scored = evaluate.choice_scores(items, lexicon.tokenizer, lexicon.scorer())
    assert scored.count() == 6
    predicted = {r.item_id: r.pred for r in evaluate.choice_predict(scored).collect()}
    assert predicted == {0: 1, 1: 0}  # ties go to the lowest choice
    row = evaluate.choice_accuracy(evaluate.choice_predict(scored)).first()
    assert (row.accuracy, row.items) == (0.5, 2)
    texts = {r.text for r in evaluate.choice_texts(items).collect()}
    assert "the cat" in texts


def test_retokenized_rows_are_padded_to_their_batch(spark, docs, lexicon):
    second = Lexicon(docs, tk.space_words)
    word = {r.token: r.id for r in lexicon.vocab.collect()}
    rows = [(0, 0, 0, [word["the"]] * 3), (0, 0, 1, [word["cat"], EOS_ID]), (0, 1, 0, [PAD_ID])]
    batches = spark.createDataFrame(rows, "epoch int, batch_id bigint, row_in_batch int, tokens array<int>")
    got = evaluate.retokenize_padded(batches, lexicon.tokenizer, second.tokenizer, 2)
    by = {(r.batch_id, r.row_in_batch): (len(r.ids), list(r["mask"])) for r in got.collect()}
    assert by == {(0, 0): (2, [1, 1]), (0, 1): (2, [1, 0]), (1, 0): (0, [])}
