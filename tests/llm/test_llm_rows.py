"""Mixing, sharding, archives, joins, search, licences, quality and decontamination on small fixtures."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, jaccard, licenses, mixing, quality, rows, sharding, vectors, warc
from corpusmill.llm.graph import components
from corpusmill.scratch import Scope
from corpusmill.scratch import Scope

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu".split()) + str(rng.randrange(40)) for _ in range(n))


# Mixing


def fair_targets(sizes, weights=(3, 1, 2)):
    """Excess reshared by weight, round by round."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        scale = total / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * scale > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * scale for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            open_.remove(s)
    return target


def test_mix(spark, edge, empty, tmp_path):
    rng = random.Random(5)
    texts = [(i, prose(rng, rng.randrange(1, 60)), rng.choice("abcccccc"), "en") for i in range(400)]
    path = str(tmp_path / "d")
    spark.createDataFrame([(i, t, None if s == "b" else s, g) for i, t, s, g in texts], "doc_id bigint, text string, source string, lang string").write.parquet(path)
    docs = spark.read.parquet(path)
    got = mixing.mix_report(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = fair_targets(sizes)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
    for s, target in want.items():
        assert abs(taken[s] - target) <= 2 * 60
    mixed = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in got if r.copies})
    edge_rows = mixing.mix_report(edge).collect()
    assert len(edge_rows) == edge.count()
    assert {r.doc_id: r.size for r in edge_rows}[4] == 150_000
    assert mixing.mix_report(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(edge).columns == edge.columns


def test_copies_of_repeated_rows(spark, documents):
    docs = documents(["same"]).unionByName(documents(["same"], "b")).unionByName(documents(["same", "other"], "c"))
    copies = docs.select(rows.row_key().alias(rows.KEY), F.lit(2).alias("copies"))
    assert Counter(r.text for r in rows.take_copies(docs, copies).collect()) == {"same": 6, "other": 2}


# Sharding


def test_best_fit_decreasing():
    assert sharding.best_fit_decreasing([5, 7, 3, 5], 10) == [1, 0, 0, 1]
    assert sharding.best_fit_decreasing([12, 4], 10) == [0, 1]
    assert sharding.best_fit_decreasing([], 10) == []
    sizes = [random.Random(1).randrange(1, 50) for _ in range(300)]
    bins = Counter()
    for size, b in zip(sizes, sharding.equal_bins(sizes, 8), strict=True):
        bins[b] += size
    assert len(bins) == 8 and max(bins.values()) - min(bins.values()) <= 50
    heavy = sharding.equal_bins([1000, 1, 1, 1, 1], 3)
    assert heavy[0] == 0 and Counter(heavy[1:]) == {1: 2, 2: 2}


def test_shards(documents, edge, empty):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(1, 40)) for _ in range(3000)]
    texts += [texts[0]] * 50 + [None, None, ""]
    docs = documents(texts)
    got = sharding.shard_documents(docs).collect()
    load, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        text = texts[r.doc_id]
        data = (text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text].add(r.shard)
    assert sorted(load) == list(range(40))
    assert max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    assert len(got) == len(texts)
    assert len(sharding.shard_documents(edge).collect()) == edge.count()
    assert sharding.shard_documents(empty).count() == 0


# Archives

HTML = [
    "<p>plain</p>" * 20,
    "<p>plain</p>" * 20,
    None,
    "",
    "short",
    "short",
    "ends in blank\r\n" * 9,
    "x\r\n\r\n" * 40,
    "\r\n\r\nstarts blank" * 8,
    "é" * 200 + "\r\n",
    "y" * 120 + "\r\n\r",
    # Records inside a payload: one that leads on, one that claims too much, one without length.
    "z" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\nContent-Length: 99999999\r\n\r\nd",
    "WARC/1.1\r\nContent-Length: 0\r\n\r\n" * 6,
    "w" * 100 + "\r\n\r\nWARC/1.1\r\nno length\r\n\r\n",
    "\r\nWARC/1.1\r\nContent-Length: 1\r\n\r\n" * 5,
    "a very long page " * 200_000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "\r\n\r\nof many parts" * 20_000,
]


@pytest.mark.parametrize("per_file", [1, 4, 1000])
def test_archives(spark, tmp_path, per_file):
    import hashlib

    pages = [(i, f"http://a/{i}\r\nX: y", h, "?", "?") for i, h in enumerate(HTML)] + [(40 + i, None, HTML[0], "?", "?") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, digest string, n string").coalesce(2)
    warc.write_archives(df, str(tmp_path / "w"), per_file)
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert sorted(got) == sorted(p[0] for p in pages)
    first = {}
    for page_id, _, html, *_ in pages:
        data = (html or "").encode()
        r = got[page_id]
        assert r.intact, (page_id, r)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        seen = first.setdefault(data, page_id) if len(data) >= 100 else page_id
        assert (r.record_type, r.refers_to) == (("response", None) if seen == page_id else ("revisit", seen))


def test_archives_of_odd_rows(spark):
    odd = [(None, None, "q" * 200), (None, "u", "q" * 200), (3, "u", "q" * 200), (3, "u", "q" * 200), (None, None, None)]
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(odd, "page_id bigint, url string, html string")).collect())
    assert got == {(3, "response", None): 2, (None, "revisit", 3): 2, (None, "response", None): 1}
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_pointer_jumping(spark):
    """A long chain broken by look-alikes at every step, and a second chain beside it."""
    found = []
    for i in range(40):
        found += [("f", 100 * i, 100 * i, 100 * (i + 1)), ("f", 100 * i + 50, 100 * i + 50, 100 * (i + 1) + 50)]
    found += [("g", 10, 10, 20)]
    df = spark.createDataFrame([(f, o, s, 0, n) for f, o, s, n in found], "file string, offset bigint, start bigint, content bigint, successor bigint")
    with Scope(spark) as scope:
        got = sorted((r.file, r.offset) for r in warc.reachable(scope, df).collect())
    assert got == [("f", 100 * i) for i in range(40)]


# Jaccard join


def shingle_sets(texts):
    out = []
    for t in texts:
        w = re.findall(WORD, (t or "").translate(LOWER))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets):
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                x, y = sorted((root(i), root(j)), key=lambda k: ids[k])
                label[y] = x
    return [ids[root(i)] for i in range(len(sets))]


def near_copies(rng):
    base = prose(rng, 120).split()
    texts = [" ".join(base)]
    for _ in range(150):  # a chain of small changes: linked, but not all with each other
        words = rng.choice(texts[-20:]).split()
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    passage = prose(rng, 60)
    texts += [f"{passage} {prose(rng, 60)}" for _ in range(120)]  # share half, link with nothing
    texts += [f"{passage} {rng.randrange(10**6)} {rng.randrange(10**6)}" for _ in range(60)]
    for n in (1, 2, 4, 5, 6, 9, 10, 11):
        t = prose(rng, n)
        texts += [t, t.upper(), t + " more"]
    return texts + [None, "", "  "]


def around_the_limit(rng, copies):
    """Copies of one text with so many changed words that they overlap by 75, 79, 80 or 81 percent."""
    base = prose(rng, 404).split()  # 400 shingles
    texts = [" ".join(base)]
    for i in range(copies):
        # Words apart change five shingles each: c of 400 changed give (400 - c) / (400 + c).
        changed = (11, 9, 9, 8, 7)[i % 5]
        words, step = list(base), rng.randrange(7, 9)
        for j in range(changed):
            words[10 + i % 3 + j * step * 5 % 390] = f"new{rng.randrange(10**9)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(
    "frequent,dense,block,visitors", [(64, 32, 4096, 512), (5, 4, 16, 5), (10**6, 10**6, 4096, 512)]
)
def test_jaccard_join(documents, monkeypatch, frequent, dense, block, visitors):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "VISITORS", visitors)
    monkeypatch.setattr(jaccard, "COUNTED", 1 << 10)
    rng = random.Random(11)
    texts = near_copies(rng) + around_the_limit(rng, 120)
    rng.shuffle(texts)
    got = {r.doc_id: r for r in jaccard.jaccard_components(documents(texts)).collect()}
    sets = shingle_sets(texts)
    assert [got[i].n_shingles for i in range(len(texts))] == list(map(len, sets))
    assert [got[i].component_id for i in range(len(texts))] == brute_components(range(len(texts)), sets)
    assert {i for i in got if got[i].first} == {got[i].component_id for i in got}


def test_words_of_a_pattern_differ(documents):
    """Words whose hashes would agree if they were linear in the letters, in joins and in runs."""
    texts = []
    for size in (256, 1024, 4096, 8192):
        one = "a"
        while len(one) < size:
            one += one.translate(str.maketrans("ab", "ba"))
        texts += [f"a b c d {one}", f"a b c d {one.translate(str.maketrans('ab', 'ba'))}"]
    got = jaccard.jaccard_components(documents(texts)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 8


def test_rows_of_hot_columns_grow_with_the_group(spark, monkeypatch):
    """Twice the members of one column: twice the rows that its blocks get."""
    from pyspark.sql import functions as F

    def rows_of(members):
        split = spark.range(members).select(
            F.lit(7).cast("long").alias("hash"), F.col("id").alias("cid"), F.lit(100).cast("long").alias("n"),
            (F.col("id") % 8 == 0).cast("long").alias("component"),
        )
        seen = []
        from pyspark.sql import GroupedData

        monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: seen.append(self._df) or self._df)
        jaccard._blocked(split.withColumns({"bits": F.array(F.lit(0)), "columns": F.array("hash")}), True)
        return seen[0].count()

    one, two = rows_of(3000), rows_of(6000)
    assert one < 1.2 * 3000 and two < 2.3 * one


def test_jaccard_join_of_odd_rows(spark, edge, empty):
    got = jaccard.jaccard_components(edge).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(
        [("0", 0, "0"), ("1", 0, "1"), ("2", 0, "2"), ("3", 1, "3"), ("4", 5, "4"), ("5", 1, "3"), ("6", 5, "6")]
        + [("6", 5, "6"), ("None", 5, "None"), ("None", 0, "None"), ("7", 1, "7")]
    )
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.first_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "2", "3", "4", "6", "7", "None", "None"]
    assert jaccard.first_of_each(empty).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + rng.randrange(1, 300)) for _ in range(200)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain + star, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(c == 1000 for n, c in got.items() if n >= 1000)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Search


def test_top_inner_products(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TREE_ROWS", 400)
    monkeypatch.setattr(vectors, "PAGE", 16)
    monkeypatch.setattr(vectors, "FAN", 4)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    points = [(centers[i % 6] + 0.1 * rng.normal(size=8)).tolist() for i in range(900)]
    points += [points[0]] * 300 + [[0.0] * 8] * 20
    table = [(i, p, "?") for i, p in enumerate(points)]
    table += [(5000, None, "?"), (5100, [1.0, None], "?"), (5200, [float("nan")] * 8, "?"), (5300, [float("inf")] * 8, "?")]
    table += [(None, points[3], "?"), (6000, [1.0, 2.0], "?"), (6001, [3.0, 1.0], "?"), (7000, [], "?"), (100, points[100], "?")]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, score string")
    got = vectors.top_inner_products(df).collect()
    whole = {}
    for n, (i, p, _) in enumerate(table):
        if i is not None and p is not None and all(c is not None and np.isfinite(c) for c in p):
            whole[n] = (i, np.floor(1024 * np.asarray(p, np.float32).astype(float)).astype(int))
    want = Counter()
    for n, (i, q) in whole.items():
        if i % 100 == 0:
            found = sorted((-int(v @ q), j) for m, (j, v) in whole.items() if m != n and len(v) == len(q))[:10]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    assert vectors.top_inner_products(df.where("vec_id < 0")).count() == 0


def test_trees_skip_work():
    """On clustered points, most distances are never computed."""
    rng = np.random.default_rng(0)
    centers = 200 * rng.normal(size=(40, 4))
    points = np.rint(centers[np.arange(8000) % 40] + rng.normal(size=(8000, 4))).astype(np.int64)
    tree = vectors.MTree(np.arange(8000), np.arange(8000), points)
    tree.search(0, points[0], 10)
    assert 0 < tree.scored < 2000


def leaves(node, depth=0):
    return [(depth, len(node.rows))] if node.rows is not None else [x for c in node.children for x in leaves(c, depth + 1)]


def tree_of(folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{folder}') ORDER BY vec_id").fetchnumpy()
    points = np.floor(1024 * np.stack(rows["embedding"]).astype(np.float64)).astype(np.int64)[: vectors.TREE_ROWS]
    ids = np.asarray(rows["vec_id"])[: vectors.TREE_ROWS]
    return vectors.MTree(ids, ids, points), ids, points


@pytest.mark.parametrize("folder,most", [("sf0.1/embeddings.parquet", 1.0), ("check_s/embeddings.parquet/*.parquet", 0.97)])
def test_trees_of_the_given_vectors(folder, most):
    """Balanced trees with inner nodes; how much they avoid depends on how the vectors lie.

    Those of the small tables are random directions, which no bound tells apart.
    """
    tree, ids, points = tree_of(f"/root/testdata/{folder}")
    found = leaves(tree.root)
    assert min(d for d, _ in found) >= 1 and max(d for d, _ in found) <= min(d for d, _ in found) + 2
    assert min(n for _, n in found) >= vectors.PAGE // 4 and max(n for _, n in found) <= vectors.PAGE
    queries = np.flatnonzero(ids % 100 == 0)
    for q in queries:
        got = tree.search(int(ids[q]), points[q], 10)
        scores = points @ points[q]
        assert got == sorted(((int(s), int(i)) for s, i in zip(scores, ids, strict=True) if i != ids[q]), key=lambda x: (-x[0], x[1]))[:10]
    assert tree.scored <= most * len(queries) * len(ids)


@pytest.mark.parametrize("size", [1e4, 1e6, 1e8])
def test_bounds_hold_at_any_magnitude(size):
    rng = np.random.default_rng(9)
    points = np.rint(size * rng.normal(size=(1500, 16))).astype(np.int64)
    tree = vectors.MTree(np.arange(1500), np.arange(1500), points)
    for q in range(0, 1500, 50):
        scores = points @ points[q]
        want = sorted(((int(s), i) for i, s in enumerate(scores) if i != q), key=lambda x: (-x[0], x[1]))[:10]
        assert tree.search(q, points[q], 10) == want


# Licences


def test_licenses(documents, edge, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    texts = [
        f"Intro words. {mit}. The end",
        "Under the MIT License; see apache-license or General Public  License. mit license",
        "permission is hereby granted without restriction",
        "the permission to copy this software without charge to any person",
        "smit license, mit licenses, général public license mit" + " license" * 3,
        f"{mit.replace('without restriction, ', '')}",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions",
    ]
    got = {r.doc_id: r for r in licenses.license_scan(documents(texts)).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        places = [(j, phrases[p]) for p in phrases for j in range(len(words)) if words[j : j + len(p.split())] == p.split()]
        at = [j for j, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == (min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1
    assert [got[i].labels for i in range(7)] == ["mit", "apache,gpl,mit", "", "", "mit", "", "bsd,bsd-2-clause"]
    assert got[0].score > 0.9 and got[3].score == 0 and got[1].score == licenses.PHRASE_SCORE
    odd = licenses.license_scan(edge).collect()
    assert len(odd) == edge.count() and {r.doc_id: r.n_words for r in odd}[4] == 150_000
    assert licenses.license_scan(empty).count() == 0


def test_licenses_beside_others(documents):
    """Neither the other licences nor scattered licence words hide a passage."""
    passages = {label: text for label, (text, _) in licenses.TEMPLATES.items()}
    rng = random.Random(5)
    scattered = sorted(licenses.Templates().vocabulary())
    noise = lambda n: " ".join(w.decode() + " x" * 3 for w in rng.choices(scattered, k=n))
    fours = [rng.sample(sorted(passages), 4) for _ in range(150)]
    texts = [" ".join(f"{noise(30)} {text}" for text in passages.values())]
    texts += [" . ".join(passages[label] for label in four) for four in fours]
    texts += [f"{noise(400)} {text} {noise(400)}" for text in passages.values()] + [noise(2000)]

    def expected(chosen):
        out = set(chosen) | ({"gpl"} if any("gpl" in label for label in chosen) else set())
        return out | ({"bsd-2-clause"} if "bsd" in out and not out & {"bsd-3-clause", "bsd-4-clause"} else set())

    want = [expected(c) for c in ([*passages], *fours, *[[label] for label in passages], [])]
    got = {r.doc_id: r for r in licenses.license_scan(documents(texts)).collect()}
    assert [set(filter(None, got[i].labels.split(","))) for i in range(len(texts))] == want
    assert all(got[i].score == 1.0 for i in range(len(texts) - 1))
    assert len(passages) >= 25


def plain_matches(words, idf):
    """``label -> share`` from every place of every template, without postings."""
    templates, found = licenses.Templates(), {}
    index = licenses.Index(templates, idf)
    for label, wanted in templates.words.items():
        places = defaultdict(list)
        for place, word in enumerate(wanted):
            places[word].append(place)
        at = {w: {i - p for i, x in enumerate(words) if x == w for p in places[w]} for w in index.rare[label]}
        for start in range(-len(wanted), len(words)):
            agree = sum(any(start + d in offsets for d in range(-4, 5)) for offsets in at.values())
            if agree < 3 or not any(start in offsets for offsets in at.values()):
                continue
            low, high = max(0, start - 4), start + len(wanted) + 4
            inside = b" ".join([b"", *words[low:high], b""])
            if any(b" ".join([b"", *p, b""]) not in inside for p in templates.phrases[label]):
                continue
            share = sum((Counter(wanted) & Counter(words[low:high])).values()) / len(wanted)
            if share >= 0.7:
                found[label] = max(found.get(label, 0), share)
    for label, (plain, others) in licenses.WITHOUT.items():
        if label in found and not any(o in found for o in others):
            found[plain] = found[label]
    return found


def test_index_against_every_place():
    """Changed passages under frequencies of several corpora; the frequencies decide what is indexed."""
    rng, templates = random.Random(17), licenses.Templates()
    vocabulary = sorted(templates.vocabulary())
    hits = 0
    for case in range(60):
        idf = {w: rng.choice([0.1, 1.0, 5.0]) * rng.random() for w in vocabulary}
        index, words = licenses.Index(templates, idf), []
        for label in rng.sample(sorted(templates.words), 3):
            own = list(templates.words[label])
            for _ in range(rng.choice([0, 2, 6, 12])):
                kind, at = rng.randrange(3), rng.randrange(len(own))
                if kind == 0:
                    own.insert(at, rng.choice(vocabulary))
                elif kind == 1:
                    del own[at]
                else:
                    own[at] = b"other"
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(20))] + own
        got = index.matches(words, set(vocabulary).intersection(words))
        assert got == pytest.approx(plain_matches(words, idf))
        hits += len(got)
    assert hits > 60
    one, two = ({w: float(i % m) for i, w in enumerate(vocabulary)} for m in (7, 11))
    assert licenses.Index(templates, one).rare["mit"] != licenses.Index(templates, two).rare["mit"]
    assert all(len(r) < len(set(templates.words[label])) for label, r in licenses.Index(templates, one).rare.items())


# Quality


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen, held = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r.kept for r in quality.quality_scores(docs, seen).collect()}
    right = sum(got[i] == bool(q) for i, q in held.items())
    assert right / len(held) >= 0.97
    kept = sorted(r.doc_id for r in quality.good_documents(docs, seen).collect())
    assert kept == sorted(i for i, k in got.items() if k)


def test_sparse_paths_are_shrunk(spark, documents):
    """Many junk documents make a path doubtful; a path with one hardly moves."""
    junk, fine = "zz zz zz " * 40, "this is a fine and varied sentence about number {}, written with care"
    texts = [fine.format(i) for i in range(60)] + [junk] * 40
    docs = documents(texts).withColumn("source", F.when(F.col("doc_id") % 50 == 0, "rare").when(F.col("doc_id") >= 60, "bad").otherwise("good"))
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 100, 2)] + [(1, None), (None, 1), (10**9, 0)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert got[61].path_quality < got[0].path_quality < got[1].path_quality
    assert got[61].posterior <= got[61].evidence and got[1].posterior >= got[1].evidence
    assert not got[61].kept and got[1].kept and got[50].kept


def test_quality_of_odd_rows(spark, edge, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1), (6, 1)], "doc_id bigint, quality int")
    assert quality.quality_scores(edge, labels).count() == edge.count()
    assert quality.good_documents(edge, labels).columns == edge.columns
    assert quality.quality_scores(empty, labels).count() == 0 and quality.good_documents(empty, labels).count() == 0
    none = quality.quality_scores(edge, labels.limit(0)).collect()
    assert len(none) == edge.count() and len({r.evidence for r in none}) == 1
    assert quality.features(None) == quality.features(" ") == [0.0] * len(quality.FEATURES)


# Decontamination


def test_decontamination(spark, documents, edge, empty, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(3, 70))) for i in range(50)] + [(50, None), (51, ""), (None, "x y"), (3, prose(rng, 20))]
    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(200)]
    for k in range(0, 200, 5):
        item = items[k % 50][1].split()
        if k % 2:  # some words changed
            for _ in range(k % 4):
                item[rng.randrange(len(item))] = "changed"
        cut = len(texts[k]) // 2
        texts[k] = f"{texts[k][:cut]} {' '.join(item).upper()} {texts[k][cut:]}"
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")

    def run():
        return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(texts, str(rng.random())), benchmark).collect()}

    want = set()
    for d, text in enumerate(texts):
        (have,) = shingle_sets([text])
        for i, item in items:
            words = (item or "").translate(LOWER).split()
            if i is None or not words:
                continue
            half = -(-len(words) // 2)
            shares = [len(s & have) / len(s) if s else 1 for s in shingle_sets([item, " ".join(words[:half]), " ".join(words[half:])])]
            if len(shingle_sets([item])[0]) <= 5:
                shares = shares[:1] * 3
            if shares[0] >= 0.8 and min(shares[1:]) >= 0.5:
                want.add((d, i))
    assert len(want) >= 20
    assert run() == want
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)  # several indexes
    assert run() == want
    docs = documents(texts, "clean")
    clean = decontaminate.clean_documents(docs, benchmark)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(range(200)) - {d for d, _ in want})
    assert decontaminate.contaminated(edge, benchmark).count() == 0
    assert decontaminate.contaminated(empty, benchmark).count() == 0
    assert decontaminate.contaminated(edge, benchmark.limit(0)).count() == 0
    assert decontaminate.clean_documents(edge, benchmark).columns == edge.columns


def test_index_grows_as_its_words(documents, monkeypatch):
    """Postings take a bounded size per word of the items; split indexes find the same."""
    rng = random.Random(11)

    def index(n):
        items = [(i, " ".join(f"w{rng.randrange(10 * n)}" for _ in range(40))) for i in range(n)]
        sets = [{int(w) for w in decontaminate._text_words(t).view(np.int64)} for _, t in items]
        df = Counter(itertools.chain(*sets))
        return items, df, decontaminate.ItemIndex(items, df, n, 40.0)

    sizes = [len(cloudpickle.dumps(index(n)[2])) for n in (200, 1600)]
    assert sizes[1] < 9 * sizes[0] and sizes[1] < 100 * 1600 * 40
    items, df, whole = index(300)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(150)) + " " + items[k][1] for k in range(0, 300, 10)]
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", len(cloudpickle.dumps(whole)) // 3)
    parts = list(decontaminate._serialised(items, df, 300, 40.0))
    assert len(parts) >= 4 and max(map(len, parts)) <= decontaminate.BROADCAST_BYTES
    parts = [cloudpickle.loads(p) for p in parts]
    for k, text in zip(range(0, 300, 10), texts, strict=True):
        hits = whole.hits(text)
        assert k in [h[0] for h in hits]
        assert hits == sorted(h for p in parts for h in p.hits(text))
        # Windows scored one by one, without any bound.
        words = decontaminate._text_words(text)
        terms, want = whole.terms(words), {}
        for block in whole.blocks:
            for a in range(0, max(len(words) - block.window // 2, 1), block.window // 2):
                own = block.find(np.unique(terms[a : a + block.window]))
                scores = block.scores(own[own < len(block.terms)])
                for item, score, least in zip(block.items.tolist(), scores.tolist(), block.thresholds, strict=True):
                    if score >= least - decontaminate.SLACK:
                        want[item] = max(want.get(item, 0.0), score)
        assert whole.retrieve(terms) == pytest.approx(want)


def test_short_items(spark, documents):
    """Items of one to four words are found where they stand together, and nowhere else."""
    rng = random.Random(31)
    filler = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = spark.createDataFrame(
        [(1, "quagga"), (2, "Blue Quokka"), (3, "seven tame okapis"), (4, "who wrote the zyzzyva"), (5, "")],
        "item_id bigint, text string",
    )
    texts = [
        f"{filler(40)} quagga {filler(40)}",
        f"{filler(10)} blue quokka {filler(3000)}",
        f"{filler(10)} blue {filler(2)} quokka",
        f"seven tame okapis {filler(5)} who wrote the zyzzyva",
        f"seven okapis tame {filler(5)} wrote who the zyzzyva",
        "blue quokka",
        filler(60),
    ]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(texts), items).collect()}
    assert got == {(0, 1), (1, 2), (3, 3), (3, 4), (5, 2)}
    clean = decontaminate.clean_documents(documents(texts, "again"), items)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 6]


def test_rows_that_the_classifier_is_fitted_on(spark):
    """The first by hash, whatever bounds the sort; weights don't depend on it."""
    rng = np.random.default_rng(2)
    rows = [(i, i, rng.normal(size=len(quality.FEATURES)).tolist()) for i in range(300)]
    computed = spark.createDataFrame(rows, "doc_id bigint, _row bigint, x array<double>")
    labels = spark.createDataFrame([(i, int(x[0] > 0)) for i, _, x in rows if i % 3], "doc_id bigint, quality int")
    hashes = {r.id: r.h for r in spark.range(300).select("id", F.xxhash64("id").alias("h")).collect()}
    chosen = sorted((i for i in range(300) if i % 3), key=hashes.get)
    for most in (1, 40, 200, 1000):
        own = chosen[:most]
        want = quality.fit(np.array([rows[i][2] for i in own]), np.array([float(rows[i][2][0] > 0) for i in own]))
        assert np.allclose(quality.train(computed, labels, most), want)


def test_a_round_of_components_writes_two_tables(spark, monkeypatch):
    written, keep = [], Scope.keep
    monkeypatch.setattr(Scope, "keep", lambda scope, df, label: written.append(label) or keep(scope, df, label))
    got = {r.node: r.component for r in components(spark.createDataFrame([(1, 2)], "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1}
    assert written == ["links", "labels", "labels", "labels"]  # the first labels and one round
