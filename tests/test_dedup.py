"""Duplicates against sequential rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import minhash as mh
from corpusmill.operators import dedup, store as stores
from corpusmill.operators.store import DuplicateStore


def keyed(spark, rows):
    data = [(o, [k.encode() for k in keys]) for o, keys in rows]
    return spark.createDataFrame(data, "ord bigint, keys array<binary>")


def greedy(rows, stored=()):
    seen, kept = set(stored), []
    for o, keys in sorted(rows):
        marked = {(b, k.encode()) for b, k in enumerate(keys)}
        if not marked & seen:
            seen |= marked
            kept.append(o)
    return kept


def ords(df):
    return sorted(r.ord for r in df.collect())


def labels_by_loop(texts, bands):
    """Labels in order, from digests and signatures worked out one text at a time."""
    rows = mh.band_shape()[1]
    seen, index, labels = set(), set(), {}
    for o, text in sorted(texts):
        text = " ".join(text.lower().split())
        if text in seen:
            labels[o] = "exact_dup"
            continue
        seen.add(text)
        sig = mh.signatures([text])[0]
        marked = {(b, sig[b * rows : (b + 1) * rows].tobytes()) for b in range(bands)}
        labels[o] = "near_dup" if marked & index else "kept"
        if labels[o] == "kept":
            index |= marked
    return labels


def corpus(seed=0, size=150):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(300)]
    texts = []
    for o in range(size):
        kind = rng.random()
        if texts and kind < 0.2:
            text = rng.choice(texts)[1].upper()
        elif texts and kind < 0.45:
            parts = rng.choice(texts)[1].split(" ")
            parts[rng.randrange(len(parts))] = "x"
            text = " ".join(parts)
        elif kind < 0.5:
            text = rng.choice(["a", "b  b", "c", "ab", "é"])
        else:
            text = " ".join(rng.choices(words, k=rng.randrange(50, 150)))
        texts.append((o * 7, text))
    return texts


def test_band_shape_of_the_defaults():
    assert mh.band_shape(0.9, 128) == (5, 25)


def test_signature_estimates_similarity():
    rng = random.Random(2)
    base = [rng.choice("etaoin shrdlu") for _ in range(3000)]
    other = list(base)
    for _ in range(150):
        other[rng.randrange(3000)] = rng.choice("etaoin shrdlu")
    a, b = "".join(base), "".join(other)
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for t in (a, b)]
    true = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
    sig = mh.signatures([a, b, "abcd", ""])
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15
    assert (sig[2] == mh.EMPTY_HASH).all() and (sig[3] == mh.EMPTY_HASH).all()


def test_signatures_do_not_depend_on_grouping(monkeypatch):
    texts = [t for _, t in corpus(4, 40)]
    whole = mh.signatures(texts)
    monkeypatch.setattr(mh, "_GROUP", 1)
    assert np.array_equal(whole, mh.signatures(texts))


@pytest.mark.parametrize("seed", range(6))
def test_greedy_rule_on_random_keys(spark, seed):
    rng = random.Random(seed)
    spread = rng.choice([3, 8, 30])
    rows = [(o, [f"{rng.randrange(spread)}" for _ in range(3)]) for o in rng.sample(range(999), 60)]
    assert ords(dedup.greedy_keep(keyed(spark, rows), 3)) == greedy(rows)


def test_greedy_rule_on_a_chain(spark):
    rows = [(o, [f"{o // 2}", f"{(o + 1) // 2}"]) for o in range(12)]
    assert ords(dedup.greedy_keep(keyed(spark, rows), 2)) == greedy(rows)


def test_greedy_rule_with_a_hot_key(spark):
    rows = [(o, ["hot" if o % 3 == 0 else f"a{o}", f"b{o % 50}"]) for o in range(400)]
    assert ords(dedup.greedy_keep(keyed(spark, rows), 2)) == greedy(rows)


def test_greedy_rule_with_stored_keys(spark):
    rng = random.Random(9)
    rows = [(o, [f"{rng.randrange(9)}" for _ in range(3)]) for o in range(40)]
    stored = [(b, f"{k}".encode()) for b in range(3) for k in (0, 4)]
    table = spark.createDataFrame(stored, "band int, key binary")
    assert ords(dedup.greedy_keep(keyed(spark, rows), 3, table)) == greedy(rows, stored)


def test_nothing_to_keep(spark):
    assert ords(dedup.greedy_keep(keyed(spark, [(1, ["a"])]).limit(0), 1)) == []


def test_labels_match_the_loop(spark):
    texts = corpus()
    docs = spark.createDataFrame(texts, "ord bigint, text string")
    got = {r.ord: r.label for r in dedup.label_documents(docs).collect()}
    want = labels_by_loop(texts, mh.band_shape()[0])
    assert got == want
    assert set(want.values()) == {"kept", "near_dup", "exact_dup"}
    report = dedup.dedup_report(dedup.label_documents(docs)).first()
    assert report.exact_unique == sum(v != "exact_dup" for v in want.values())
    assert report.near_dups == sum(v == "near_dup" for v in want.values())


def test_kept_documents_share_no_band(spark):
    docs = spark.createDataFrame(corpus(5), "ord bigint, text string")
    prints = dedup.fingerprints(docs)
    kept = dedup.label_documents(docs).where("label = 'kept'")
    rows = dedup.band_rows(prints.join(kept, "ord", "left_semi"))
    assert rows.groupBy("band", "key").count().where("count > 1").count() == 0


def test_candidates_are_earlier_kept_documents(spark):
    texts = corpus(3)
    docs = spark.createDataFrame(texts, "ord bigint, text string")
    unique = dedup.unique_fingerprints(dedup.fingerprints(docs))
    kept = dedup.greedy_keep(unique, mh.band_shape()[0])
    got = {(r.ord, r.candidate) for r in dedup.lsh_candidates(unique, kept).collect()}
    keys = {r.ord: set(enumerate(bytes(k) for k in r["keys"])) for r in unique.collect()}
    kept_ords = set(ords(kept))
    want = {(a, b) for a in keys for b in kept_ords if b < a and keys[a] & keys[b]}
    assert got == want and want


@pytest.mark.parametrize("cuts", [[0, 400], [0, 150, 300, 700]])
def test_groups_do_not_change_labels(spark, tmp_path, cuts):
    texts = corpus(1)
    docs = spark.createDataFrame(texts, "ord bigint, text string")
    store = DuplicateStore(spark, str(tmp_path / "store"))
    for group, (low, high) in enumerate(zip(cuts, [*cuts[1:], 10**9])):
        part = docs.where((F.col("ord") >= low) & (F.col("ord") < high))
        store.add(part, group)
        if group == 1:
            store.add(part, group)  # a repeated group changes nothing
    got = {r.ord: r.label for r in store.labels().collect()}
    assert got == labels_by_loop(texts, mh.band_shape()[0])


def test_exact_copies_and_dense_ids(spark):
    docs = spark.createDataFrame(
        [(5, "B b"), (2, "a  A"), (9, "b B"), (11, "c"), (1, "a a ")], "ord bigint, text string"
    )
    firsts = dedup.first_copies(docs)
    assert ords(firsts) == [1, 5, 11]
    assert {r.ord: r.dense_id for r in dedup.dense_ids(firsts).collect()} == {1: 0, 5: 1, 11: 2}


def test_null_texts_in_groups(spark, tmp_path):
    """Labels don't depend on how null and empty texts fall into groups, nor do first copies."""
    rows = [(0, None), (1, "some text that is long enough"), (2, None), (3, ""), (4, " "), (5, None)]
    docs = spark.createDataFrame(rows, "ord bigint, text string")
    want = {r.ord: r.label for r in dedup.label_documents(docs).collect()}
    assert want == {0: "kept", 1: "kept", 2: "exact_dup", 3: "exact_dup", 4: "exact_dup", 5: "exact_dup"}
    assert ords(dedup.first_copies(docs)) == [0, 1]
    for name, cuts in (("two", [2]), ("three", [1, 3]), ("each", [1, 2, 3, 4, 5])):
        store, exact = (DuplicateStore(spark, str(tmp_path / f"{name}-{kind}")) for kind in ("near", "exact"))
        for group, (low, high) in enumerate(zip([0, *cuts], [*cuts, 9], strict=True)):
            part = docs.where((F.col("ord") >= low) & (F.col("ord") < high))
            store.add(part, group)
            exact.add_exact(part, group)
        assert {r.ord: r.label for r in store.labels().collect()} == want
        assert {r.ord: r.label for r in exact.labels().collect()} == want


def test_null_texts_count_as_empty(spark):
    rows = [(0, None), (1, ""), (2, "a long enough text to have shingles"), (3, None)]
    docs = spark.createDataFrame(rows, "ord bigint, text string")
    got = {r.ord: r.label for r in dedup.label_documents(docs).collect()}
    plain = {r.ord: r.label for r in dedup.label_documents(docs.fillna("", ["text"])).collect()}
    assert got == plain and got[0] == got[2] == "kept" and got[3] == "exact_dup"


def numbers(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("digest"))


def test_groups_open_their_own_buckets_only(spark, tmp_path):
    index = stores.HashIndex(spark, str(tmp_path / "index"), "digest binary", buckets=16)
    index.add(numbers(spark, 0, 2000), 0)
    few = numbers(spark, 10, 12)
    asked = {f"bucket={r.b}" for r in few.select(index.bucket().alias("b")).collect()}
    paths = index.paths(few, 1)
    assert {p.rpartition("/")[2] for p in paths} == asked and len(paths) <= 2
    plan = index.present(few, 1)
    opened = {f.rpartition("/")[0].rpartition("/")[2] for f in plan.inputFiles() if "bucket=" in f}
    assert opened == asked and plan.count() == 2
    assert index.present(numbers(spark, 5000, 5003), 1).count() == 0
    assert index.present(few, 0).count() == 0  # the group itself is no earlier one
    with pytest.raises(ValueError, match="buckets=16"):
        stores.HashIndex(spark, str(tmp_path / "index"), "digest binary", buckets=8)


def test_files_stay_few_over_many_groups(spark, tmp_path, monkeypatch):
    """Runs are merged, and what earlier groups added is found, once, whatever its run."""
    monkeypatch.setattr(stores, "FAN", 3)
    index = stores.HashIndex(spark, str(tmp_path / "index"), "digest binary", buckets=4)
    most = 0
    for group in range(30):
        assert index.present(numbers(spark, 0, 400), group).count() == 10 * group
        index.add(numbers(spark, 10 * group, 10 * group + 10), group)
        most = max(most, len(index.paths(numbers(spark, 0, 400), 99)))
    # Three tiers of up to three runs and the newest one, of four buckets each.
    assert most <= 4 * 10 and len(index.runs()) <= 10
    index.add(numbers(spark, 50, 60), 5)  # a group repeated after its run was merged
    assert index.present(numbers(spark, 0, 400), 5).count() == 50
    assert index.present(numbers(spark, 0, 400), 30).count() == 300


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Alternating neighbours, branches and rings of them, against the loop."""
    rounds = 0
    real = dedup.materialize

    def counting(df, label):
        nonlocal rounds
        rounds += label == "undecided"
        return real(df, label)

    monkeypatch.setattr(dedup, "materialize", counting)
    chain = [(i, [f"a{i // 2}", f"b{(i + 1) // 2}"]) for i in range(2000)]
    assert ords(dedup.greedy_keep(keyed(spark, chain), 2)) == greedy(chain) == list(range(0, 2000, 2))
    assert rounds <= 15


@pytest.mark.parametrize("seed", range(3))
def test_chains_among_others(spark, monkeypatch, seed):
    monkeypatch.setattr(dedup, "CHAINS_FROM", seed % 2)
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        near = max(0, i - rng.choice([1, 1, 1, 2, 7]))
        rows.append((3 * i, [f"k{rng.choice([i, near])}" for _ in range(3)]))
    assert ords(dedup.greedy_keep(keyed(spark, rows), 3)) == greedy(rows)
