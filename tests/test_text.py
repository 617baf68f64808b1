"""Split, filters, normalisation and digests against plain Python."""

import hashlib
import string

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.split import hash_bucket, in_split, split_name
from corpusmill.functions.text import digest, length_ok, normalize
from corpusmill.sources import corpora
from corpusmill.sources.corpora import (
    CODE_COLUMNS,
    PAPER_COLUMNS,
    CorpusSource,
    canonical_text,
    first_text,
    load_corpora,
    peek_first,
    read_source,
    resolve_text_column,
)

SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()]
TEXTS = [
    "", " ", "abcde", "abcdef", "x" * 19999, "x" * 20000, "Hello\tWorld  again\n",
    "".join(f"a{s}B{s}{s}" for s in SPACES), "İstanbul ΟΔΟΣ Σ", " é ü ",
    "mixed\x1c\x1f\x85text", string.printable, "𝔘nicode 😀 astral",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(len(TEXTS), None)]
    return spark.createDataFrame(rows, "id int, text string")


def test_hash_bucket_is_md5_modulo(texts):
    got = texts.where("text is not null").select("text", hash_bucket(F.col("text")).alias("b")).collect()
    for r in got:
        assert r.b == int(hashlib.md5(r.text.encode()).hexdigest(), 16) % 100


def test_splits_are_disjoint_and_cover(texts):
    train = texts.where(in_split(F.col("text"), "train")).count()
    val = texts.where(in_split(F.col("text"), "val")).count()
    assert train + val == len(TEXTS) + 1
    missing = texts.where("text is null").select(split_name(F.col("text"))).first()[0]
    assert missing == "train"  # like empty text, bucket 66


def test_unknown_split_is_refused():
    with pytest.raises(ValueError):
        in_split(F.lit("x"), "test")


def test_normalize_like_python(texts):
    for r in texts.where("text is not null").select("text", normalize(F.col("text")).alias("n")).collect():
        assert r.n == " ".join(r.text.lower().split())


def test_digest(texts):
    for r in texts.where("text is not null").select("text", digest(F.col("text")).alias("d")).collect():
        assert bytes(r.d) == hashlib.sha256(r.text.encode()).digest()


def test_length_limits_are_exclusive(texts):
    kept = {r.text for r in texts.where(length_ok(F.col("text"))).collect()}
    assert kept == {t for t in TEXTS if 5 < len(t) < 20000}


def test_first_text_skips_empty(spark):
    rows = [("a", "b", "c"), ("", "b", "c"), (None, "", "c"), (None, None, None), ("", "", "")]
    df = spark.createDataFrame(rows, "text string, content string, markdown string")
    assert [r[0] for r in df.select(first_text(df.columns)).collect()] == ["a", "b", "c", "", ""]
    only = df.select("content")
    assert [r[0] for r in only.select(first_text(only.columns)).collect()] == ["b", "b", "", "", ""]


def test_text_column_is_resolved_from_the_schema(spark):
    assert resolve_text_column(["id", "code"], CODE_COLUMNS) == "code"
    assert resolve_text_column(["text", "markdown"], PAPER_COLUMNS) == "markdown"
    with pytest.raises(ValueError, match="found"):
        resolve_text_column(["id", "body"], CODE_COLUMNS)
    df = spark.createDataFrame([(1, "x", "y")], "ord int, content string, other string")
    assert canonical_text(df, CODE_COLUMNS, "ord").columns == ["ord", "text"]


def test_partition_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "code")
    spark.createDataFrame(
        [("a", "python"), ("b", "rust")], "content string, lang string"
    ).write.partitionBy("lang").parquet(path)
    df = read_source(spark, CorpusSource("code", path, part=("lang", "python")))
    assert [r.content for r in df.collect()] == ["a"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan
    with pytest.raises(ValueError):
        read_source(spark, CorpusSource("code", path, format="xlsx"))


def test_load_corpora_orders_by_file_position(spark, tmp_path):
    web, code = str(tmp_path / "web"), str(tmp_path / "code")
    spark.createDataFrame([(f"web text {i}",) for i in range(20)], "text string").coalesce(1).write.parquet(web)
    spark.createDataFrame([(f"code {i}",) for i in range(9)], "code string").coalesce(1).write.parquet(code)
    sources = [CorpusSource("web", web), CorpusSource("code", code, text_columns=CODE_COLUMNS)]
    rows = load_corpora(spark, sources).orderBy("source", "ord").collect()
    assert [r.text for r in rows] == [f"code {i}" for i in range(9)] + [f"web text {i}" for i in range(20)]
    both = [load_corpora(spark, sources, s).count() for s in ("train", "val")]
    assert sum(both) == 29
    assert peek_first(load_corpora(spark, sources).where("source = 'web'")).first().text == "web text 0"


def test_json_and_csv_sources(spark, tmp_path):
    df = spark.createDataFrame([('say "hi"\nthere',), ("plain",)], "text string")
    df.write.json(str(tmp_path / "j"))
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    for name, fmt in (("j", "json"), ("c", "csv")):
        source = CorpusSource(name, str(tmp_path / name), fmt, schema="text string", options=(("multiLine", "true"),) if fmt == "csv" else ())
        assert sorted(r.text for r in read_source(spark, source).collect()) == ["plain", 'say "hi"\nthere']


def test_corpora_without_an_order_are_refused(spark, tmp_path):
    spark.createDataFrame([("a", 3)], "text string, n int").write.json(str(tmp_path / "j"))
    with pytest.raises(ValueError, match="name an order column"):
        load_corpora(spark, [CorpusSource("j", str(tmp_path / "j"), "json", schema="text string, n int")])
    named = CorpusSource("j", str(tmp_path / "j"), "json", schema="text string, n int", order="n")
    assert [(r.ord, r.text) for r in load_corpora(spark, [named]).collect()] == [(3, "a")]


def test_file_order_counts_on_over_many_files(spark, tmp_path, monkeypatch):
    """Dense positions over files and rows, whether the table of files is broadcast or joined."""
    path = str(tmp_path / "many")
    spark.range(0, 60, 1, 12).write.parquet(path)
    for limit in (1 << 16, 3):
        monkeypatch.setattr(corpora, "BROADCAST_FILES", limit)
        got = sorted((r.ord, r.id) for r in corpora.with_file_order(spark.read.parquet(path)).collect())
        assert got == [(i, i) for i in range(60)]
