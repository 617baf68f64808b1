"""Hard negatives, sub-word pieces and spelling variants against plain code and the public library."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import negatives, pieces, variants
from corpusmill.llm.queries import QUERIES, piece_model

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, part int, score string, positives string"


def plain_negatives(rows):
    """All answers as a multiset, from all scores."""
    kept = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        kept.append((vec_id, whole, (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = Counter()
    for a, (anchor, x, label) in enumerate(kept):
        if anchor % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y, strict=True)), i, z) for b, (i, y, z) in enumerate(kept) if a != b and len(x) == len(y)]
        alike, others = sorted(s[:2] for s in scored if s[2] == label), sorted(s[:2] for s in scored if s[2] != label)
        for p, positive in alike[:5]:
            window = [(n, i) for n, i in others if 80 * -p <= 100 * -n <= 100 * -p]
            for rank, (n, i) in enumerate(window[:5], 1):
                out[anchor, positive, rank, i, -p, -n] += 1
    return out


def answers(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_negatives(spark, monkeypatch, scale):
    """Clusters, ties, repeated rows, nulls, other lengths and magnitudes, over several parts."""
    monkeypatch.setattr(negatives, "PART_ROWS", 90)
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(600):
        spread = rng.choice([0.0, 0.05, 0.5, 3.0])
        v = [round(scale * (c + rng.gauss(0, spread)), 3) for c in rng.choice(centres)]
        rows.append((i, v, 3 if rng.random() < 0.4 else rng.randrange(10)))
    rows += [(100, rows[100][1], rows[100][2]), (101, rows[101][1], rows[101][2])]
    rows += [(None, rows[0][1], 1), (700, None, 1), (701, rows[1][1], None), (702, [None] * 12, 1), (800, [float("nan")] * 12, 1)]
    rows += [(900, [0.0] * 12, 2), (901, [float("inf")] * 12, 2), (1000, [1.0, 2.0], 3), (1001, [1.5, 2.0], 3), (1002, [1.4, 2.0], 4), (1100, [], 1)]
    df = spark.createDataFrame([(*r, 0, "s", "p") for r in rows], VECTORS)
    got = answers(negatives.hard_negatives(df))
    assert got == plain_negatives(rows) and len(got) > 50


def test_negatives_of_nothing(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_postings_and_bounds():
    """Parts of all vectors stay out of the index, and no bound lies below its score."""
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(size=(500, 64)) * np.linspace(2, 0.1, 64)).astype(np.int64)
    own = np.arange(500)
    index = negatives.Index(own, own, own % 10, vectors)
    assert 0 < index.lengths.sum() < vectors.size / 2
    anchors = vectors[:50][:, index.order]
    bounds = index.bounds(anchors)
    scores = np.stack([index.scores(a, np.arange(500)) for a in anchors])
    assert (bounds >= scores).all()
    # The thresholds that five rows need leave most rows unverified.
    work = negatives.Candidates(index, anchors[0], bounds[0], np.ones(500, bool))
    assert work.best(5) == sorted(zip(scores[0], index.ids, strict=True), key=lambda s: (-s[0], s[1]))[:5]
    assert len(work.open) > 250


# Sub-word pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


PARTS = [
    "a", "b", "th", "▁", " ", "  ", "\t", "\n", "é", "日本", "語", "\U0001f600", "<s>", "<0x0A>", "ing", "tion", " the",
    "x", "0", "12", "\x00", " " * 18, "ﬁ", "́", "Ünter", "'s", "...", "​",
]


def test_pieces_like_the_library(library):
    model, rng = piece_model(), random.Random(4)
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode(text)
        assert decoder.decode(ids) == library.decode(ids.tolist())
    for _ in range(3000):  # any ids, those of bytes that are no text among them
        ids = [rng.randrange(32_000) if rng.random() < 0.6 else rng.randrange(260) for _ in range(rng.randrange(12))]
        assert decoder.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENTS", 4)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    encoder = pieces.Encoder(piece_model())
    for text in ("one two three two one four five six seven one", "x" * 500, "ab " * 200):
        assert encoder.encode(text).tolist() == library.encode(text)


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "model"
    path.write_bytes(b"\x12\x02\x18\x01")  # a model of another kind, without pieces
    with pytest.raises(ValueError, match="no pair-merge model"):
        pieces.Model.read(str(path))


def piece_rows(library, rows):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = Counter()
    for r in rows:
        ids = library.encode(r.text or "")
        out[r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))] += 1
    return out


def test_piece_report(spark, library, edge, empty):
    from corpusmill.plans.tables import table

    got = Counter(map(tuple, pieces.piece_report(edge, piece_model()).collect()))
    assert got == piece_rows(library, edge.collect())
    assert pieces.piece_report(empty, piece_model()).count() == 0
    got = Counter(map(tuple, QUERIES["op12_sentencepiece"](spark, FOLDER).collect()))
    assert got == piece_rows(library, table(spark, FOLDER, "documents").collect())


def test_encode_and_decode_columns(spark, edge):
    encode, decode = pieces.encoder(spark, piece_model()), pieces.decoder(spark, piece_model())
    out = edge.select("*", encode("text").alias("ids")).withColumn("back", decode(F.col("ids"))).collect()
    assert all(r.back == (r.text or "") for r in out) and len(out) == edge.count()
    nulls = spark.createDataFrame([(None,), ([],), ([0, 1, 259],)], "ids array<int>")
    assert [r[0] for r in nulls.select(decode(F.col("ids"))).collect()] == [None, "", " ⁇   "]


# Spelling variants


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            at = h % len(word)
            counts[word[:at] + word[at + 1 :] if h % 199 == 0 else word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            for c in {x for other in words for x in other} | {""}:
                for v in (w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]):
                    if v != w and v in words:
                        near[w].add(v)
                        near[v].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def found_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def spelled(rng):
    """Texts of a few stems, each with rarer and rarer edits of it."""
    words = ["wonderful"] * 900 + ["wonderfull"] * 100 + ["wonderfulll"] * 15  # a chain of forms
    for stem in ("pronounce", "crème", "brûlées", "letters", "lettersx", "ÀLÂTRE", "straße", "abcdefghijkl"):
        for edits, copies in ((0, 900), (1, 150), (1, 60), (2, 12), (2, 6)):
            word = list(stem)
            for _ in range(edits):
                at = rng.randrange(len(word))
                kind = rng.randrange(3)
                if kind == 0:
                    word.insert(at, rng.choice("abcéÿ"))
                elif kind == 1 and len(word) > 1:
                    del word[at]
                else:
                    word[at] = rng.choice("xyzà")
            words += ["".join(word)] * copies
    rng.shuffle(words)
    return [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]


@pytest.mark.parametrize("block", [1 << 12, 3])
def test_variants(spark, documents, edge, empty, monkeypatch, block):
    """Also with blocks so small that all are cut again by their letters."""
    monkeypatch.setattr(variants, "BLOCK_WORDS", block)
    monkeypatch.setattr(variants, "TILE", 16)
    texts = [None, "", *spelled(random.Random(8))]
    docs = documents(texts)
    got = found_variants(variants.variants(docs))
    want = plain_variants(enumerate(texts))
    assert got == want and any(w[1] != w[0] and w[0] for w in want.values())
    if block == 3:
        assert found_variants(variants.variants(edge)) == plain_variants((r.doc_id, r.text) for r in edge.collect())
        assert variants.variants(empty).count() == 0


def test_flushes_add_up(documents, monkeypatch):
    texts = spelled(random.Random(9))
    docs = documents(texts)
    want = {r.word: r.n for r in variants.word_counts(docs).collect()}
    monkeypatch.setattr(variants, "COUNTED", 3)
    assert {r.word: r.n for r in variants.word_counts(docs).collect()} == want
