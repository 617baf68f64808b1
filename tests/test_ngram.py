"""N-gram losses against the recursive definition, order by order."""

import math
import random
from collections import Counter, defaultdict

import pytest

from corpusmill.config import BOS_ID, EOS_ID
from corpusmill.operators.ngram import NgramModel, context_val_loss, ngram_counts


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts, ids, order, discount):
        self.ids, self.discount = ids, discount
        grams = Counter()
        for t in texts:
            padded = [BOS_ID] * (order - 1) + list(t or []) + [EOS_ID]
            grams.update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.follow = {k: defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, n in c.items():
                self.follow[k][g[:-1]].append(n)

    def p(self, window):
        if not window:
            return 1 / self.ids
        k = len(window)
        seen = self.follow[k].get(window[:-1])
        below = self.p(window[1:])
        if not seen:
            return below
        own = max(self.counts[k][window] - self.discount, 0) / sum(seen)
        return own + self.discount * len(seen) / sum(seen) * below


def sequences(spark, lists):
    return spark.createDataFrame([(i, t) for i, t in enumerate(lists)], "id bigint, tokens array<int>")


@pytest.mark.parametrize("order,discount", [(1, 0.5), (2, 0.75), (4, 0.9)])
def test_losses_follow_the_definition(spark, order, discount):
    rng = random.Random(order)
    texts = [[rng.randrange(3, 9) for _ in range(rng.randrange(0, 25))] for _ in range(40)] + [None, []]
    model, plain = NgramModel(sequences(spark, texts), 12, order, discount), Plain(texts, 12, order, discount)
    asked = [[rng.randrange(0, 12) for _ in range(rng.randrange(0, 9))] for _ in range(30)] + [[2] * 20, [5], [], None, [4, 5]]
    got = {(r.id, r.pos): (r.token, r.nll) for r in model.token_nll(sequences(spark, asked), ["id"]).collect()}
    want = {
        (i, p): (t[p + 1], -math.log(plain.p(tuple(t[max(0, p + 2 - order) : p + 2]))))
        for i, t in enumerate(asked)
        for p in range(len(t or []) - 1)
    }
    assert got.keys() == want.keys()
    for key, (token, nll) in want.items():
        assert got[key][0] == token and got[key][1] == pytest.approx(nll, rel=1e-9)


def test_probabilities_add_up(spark):
    """Behind any context all ids together have probability one, the unseen ones too."""
    texts = [[3, 4, 5, 3, 4, 6], [5, 5, 3], [7]]
    model = NgramModel(sequences(spark, texts), 10)
    for context in ([3, 4], [5, 5], [9, 9], [4, 9], [9, 4], [7]):
        asked = sequences(spark, [[*context, i] for i in range(10)])
        losses = model.token_nll(asked, ["id"]).where(f"pos = {len(context) - 1}").collect()
        assert len(losses) == 10 and sum(math.exp(-r.nll) for r in losses) == pytest.approx(1.0)


def test_order_of_words_matters(spark):
    texts = [[3, 4, 5, 6, 7, 8]] * 5
    model = NgramModel(sequences(spark, texts), 10)
    both = sequences(spark, [[3, 4, 5, 6, 7, 8], [3, 6, 5, 8, 7, 4]])
    means = {r.id: r.m for r in model.token_nll(both, ["id"]).groupBy("id").agg({"nll": "avg"}).toDF("id", "m").collect()}
    assert means[0] < means[1] / 2


def test_nothing_counted(spark):
    model = NgramModel(sequences(spark, []), 8)
    batches = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4, 4]), (1, 0, [5, 5])], "epoch int, batch_id bigint, tokens array<int>")
    row = context_val_loss(batches, model).first()
    assert row.batches == 2 and row.val_loss == pytest.approx(math.log(8))


def test_bad_settings(spark):
    with pytest.raises(ValueError, match="discount"):
        NgramModel(sequences(spark, [[3]]), 8, discount=1.0)


def test_ngrams_are_no_array_keys(spark):
    """Joins and groups of the model go by a number per position; ids may be null."""
    model = NgramModel(sequences(spark, [[3, 4, None], [3, 4, 5], None]), 9)
    assert model.numbered.columns == ["g3", "g2", "g1", "log_p", "log_back"]
    assert all(r.gram is not None and 1 <= len(r.gram) <= 3 for r in model.table.collect())
    found = {tuple(r.gram): r.n for r in ngram_counts(sequences(spark, [[3, 4, None], [3, 4, 5], None])).collect()}
    assert found == {
        (BOS_ID, BOS_ID, 3): 2, (BOS_ID, 3, 4): 2, (3, 4, None): 1, (4, None, EOS_ID): 1, (3, 4, 5): 1, (4, 5, EOS_ID): 1,
        (BOS_ID, BOS_ID, EOS_ID): 1,
    }
