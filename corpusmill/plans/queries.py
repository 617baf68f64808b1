"""Registered queries: name -> function of (session, data folder)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import BLOCK_SIZE, FIRST_WORD_ID, PASSES_PER_STEP, SEQUENCES_PER_PASS, SPLIT_SEEDS
from corpusmill.functions import minhash as mh
from corpusmill.functions import tokens as tk
from corpusmill.functions.split import hash_bucket, in_split, split_name
from corpusmill.functions.subword import Ranks, SubwordTokenizer
from corpusmill.functions.text import digest, length_ok, normalize
from corpusmill.operators import dedup, evaluate, mix, ngram, pack, trainlog, vocab
from corpusmill.operators.store import DuplicateStore
from corpusmill.plans import corpus
from corpusmill.plans.tables import (
    arrivals,
    choice_items,
    documents,
    spread_documents,
    table,
    training_log,
)
from corpusmill.scratch import materialize, new_path
from corpusmill.sources import corpora, logs, packed
from corpusmill.streaming import jobs

FLAT_WEIGHTS = {"web": 0.45, "code": 0.25, "math": 0.20, "arxiv": 0.05, "books": 0.05}
EPOCHS = (0, 1, 2)
BATCH = 4
VAL_BATCH = 4
VAL_BLOCK = 32  # small, so that there are more batches than a prefix takes
PREFIX_BATCHES = 10  # of the prefix that is a query of its own
WORLD_SIZE = 3
VALIDATE_STEPS = 5  # between validations: runs are short here
SUBWORD_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # of a public tokenizer
SHUFFLE_SEED = 7
FIRST_ITEMS = 25
FIRST_TEXTS = 300
CONTEXT = BLOCK_SIZE
LOSSY_BLOCK = 64  # small, so that documents longer than a block meet an empty buffer
LEVEL_BITS = (3, 2)  # of packing through many chunks and levels
FILES_PER_BATCH = 4  # of streams whose result does not depend on the order
SHARDS = 4  # of the streaming packer, for the life of its store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[function.__name__] = function
    return function


def _joined(ids: str | Column = "tokens") -> Column:
    return F.array_join(ids, ",").alias("tokens")


def _fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(length_ok(F.col("text")))


def _fitting_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_documents(spark, sf_dir).where(length_ok(F.col("text")))


def _lexicon(spark: SparkSession, sf_dir: str, split=tk.words) -> corpus.Lexicon:
    return corpus.Lexicon(corpus.training_texts(spread_documents(spark, sf_dir)), split)


# Sources and sinks


@query
def scan_split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpora.scan_split(table(spark, sf_dir, "documents"), "train")
    return docs.select("doc_id", "source", F.length("text").alias("chars"))


@query
def scan_partition_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "by_lang")
    table(spark, sf_dir, "documents").write.partitionBy("lang").parquet(path)
    source = corpora.CorpusSource("english", path, part=("lang", "en"))
    docs = corpora.read_source(spark, source)
    return docs.select("doc_id", "source", F.length("text").alias("chars"))


@query
def resolve_text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    renamed = {
        "code": ("content", corpora.CODE_COLUMNS),
        "arxiv": ("markdown", corpora.PAPER_COLUMNS),
        "web": ("text", corpora.TEXT_COLUMNS),
        "math": ("text", corpora.TEXT_COLUMNS),
        "books": ("text", corpora.PAPER_COLUMNS),
    }
    result = None
    for name, (column, candidates) in renamed.items():
        raw = docs.where(F.col("source") == name).withColumnRenamed("text", column)
        part = corpora.canonical_text(raw, candidates, "doc_id", "source")
        result = part if result is None else result.unionByName(part)
    return result


@query
def load_mixed_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five corpora in files of different formats and columns, read back with a split."""
    docs = documents(spark, sf_dir)
    sources = []
    for name, kind, column, candidates, ordered in (
        ("web", "parquet", "text", corpora.TEXT_COLUMNS, False),
        ("code", "json", "content", corpora.CODE_COLUMNS, True),
        ("math", "csv", "text", corpora.TEXT_COLUMNS, True),
        ("arxiv", "orc", "markdown", corpora.PAPER_COLUMNS, True),
        ("books", "parquet", "text", corpora.TEXT_COLUMNS, False),
    ):
        path = new_path(spark, f"corpus_{name}")
        rows = docs.where(F.col("source") == name).repartitionByRange(4, "ord").sortWithinPartitions("ord")
        rows = rows.select(F.col("ord").alias("place"), F.col("text").alias(column))
        quoted = {"header": True, "escape": '"', "quoteAll": True} if kind == "csv" else {}
        spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False} if quoted else {}
        rows.write.format(kind).options(**quoted, **spaces).save(path)
        options = (("multiLine", "true"),) if kind == "csv" else ()
        order = "place" if ordered else None
        schema = f"place bigint, {column} string"
        sources.append(
            corpora.CorpusSource(name, path, kind, candidates, schema=schema, order=order, options=options)
        )
    return corpora.load_corpora(spark, sources, "train")


@query
def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 5
    docs = documents(spark, sf_dir).select(
        "doc_id",
        F.when(kind == 0, F.col("text")).when(kind == 1, F.lit("")).alias("text"),
        F.when(kind.isin(1, 2), F.col("text")).when(kind == 3, F.lit("")).alias("content"),
        F.when(kind.isin(2, 3), F.concat(F.lit("# "), "text")).alias("markdown"),
    )
    return docs.select("doc_id", corpora.first_text(docs.columns).alias("text"))


@query
def peek_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.peek_first(documents(spark, sf_dir)).select("doc_id", "source", "text")


@query
def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packed.first_items(choice_items(spark, sf_dir), FIRST_ITEMS, "item_id")
    return items.select("item_id", "ctx", F.array_join("endings", "|").alias("endings"), "label")


@query
def log_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = trainlog.with_steps(training_log(spark, sf_dir))
    path = new_path(spark, "train_log")
    logs.append_log(log.where("step <= 20"), path)
    logs.append_log(log.where("step > 20"), path)
    return logs.read_log(spark, path)


@query
def validation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation log, appended line group by line group, and the best loss of each run in it."""
    log = trainlog.with_steps(training_log(spark, sf_dir)).where(F.col("step") % VALIDATE_STEPS == 0)
    path = new_path(spark, "val_log")
    for part in (F.col("step") <= 3 * VALIDATE_STEPS, F.col("step") > 3 * VALIDATE_STEPS):
        logs.append_log(log.where(part), path, logs.VALIDATION_DIGITS)
    return logs.read_log(spark, path).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("validations"),
        F.min("loss").alias("best_loss"),
        F.min_by("step", F.struct("loss", "step")).alias("best_step"),
    )


@query
def packed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "packed")
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    for split, epochs in (("train", (0, 1)), ("val", (0,))):
        blocks = corpus.packed_corpus(spread_documents(spark, sf_dir), tokenizer, split, epochs)
        packed.write_packed(blocks, path, split)
    blocks = packed.read_packed(spark, path)
    return blocks.groupBy("split", "epoch").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.max("block_idx").alias("last_block"),
        F.sum(F.expr("aggregate(tokens, 0L, (s, t) -> s + t)")).alias("id_sum"),
    )


@query
def packed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rank's blocks in a range of an epoch, from the files that hold the range."""
    path = new_path(spark, "packed_range")
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    blocks = corpus.packed_corpus(spread_documents(spark, sf_dir), tokenizer, "train", (0, 1))
    packed.write_packed(blocks, path, "train")
    last = packed.read_zones(spark, path).where("epoch = 1").agg(F.max("high")).first()[0] or 0
    # The second quarter of the epoch.
    found = packed.read_range(spark, path, "train", 1, last // 4, last // 2, 1, WORLD_SIZE)
    return found.select("block_idx", _joined())


@query
def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = corpus.packed_corpus(spread_documents(spark, sf_dir), _lexicon(spark, sf_dir).tokenizer)
    preview = packed.batch_preview(pack.batch_blocks(blocks, BATCH))
    return preview.select("epoch", "rows", "columns", F.array_join("head", ",").alias("head"))


@query
def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus.text_corpus(documents(spark, sf_dir))
    return texts.select("epoch", "pos", "source", F.col("ord").alias("doc_id"), "text")


# Filters


@query
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id",
        hash_bucket(F.col("text")).alias("bucket"),
        split_name(F.col("text")).alias("split"),
    )


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _fitting(spark, sf_dir)
    return docs.groupBy(split_name(F.col("text")).alias("split")).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")
    )


@query
def length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitting(spark, sf_dir).select("doc_id", F.length("text").alias("chars"))


@query
def take_n_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = corpus.text_corpus(documents(spark, sf_dir), epochs=EPOCHS)
    first = corpus.first_texts(texts, FIRST_TEXTS)
    return first.select("idx", "epoch", "pos", F.col("ord").alias("doc_id"))


@query
def val_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = evaluate.first_batches(_val_batches(spark, sf_dir, _lexicon(spark, sf_dir)), PREFIX_BATCHES)
    return prefix.select("batch_id", "row_in_batch", _joined())


# Mixing


def _train_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where(in_split(F.col("text"), "train"))


@query
def weighted_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.weighted_interleave(
        _train_documents(spark, sf_dir), FLAT_WEIGHTS, SPLIT_SEEDS["train"]
    )
    return mixed.select("pos", "source", F.col("ord").alias("doc_id"))


@query
def mix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = weighted_interleave(spark, sf_dir)
    return mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.max("pos").alias("last_pos")
    )


@query
def nested_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = corpus.mixed_keys(documents(spark, sf_dir), "train", (0,))
    return mixed.select("pos", "source", F.col("ord").alias("doc_id"))


@query
def epoch_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = corpus.mixed_keys(documents(spark, sf_dir), "train", EPOCHS)
    return mixed.select("epoch", "pos", "source", F.col("ord").alias("doc_id"))


@query
def resume_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "packed")
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    blocks = corpus.packed_corpus(spread_documents(spark, sf_dir), tokenizer, "train", EPOCHS)
    packed.write_packed(blocks, path, "train")
    resumed = packed.read_packed(spark, path, "train", start_epoch=2)
    return resumed.select("epoch", "block_idx", _joined())


# Text and tokens


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))


@query
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        "doc_id", F.lower(F.hex(digest(normalize(F.col("text"))))).alias("digest")
    )


@query
def char_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_documents(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))
    return docs.select("doc_id", mh.shingle_counts(F.col("text")).alias("c")).select("doc_id", "c.*")


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_documents(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("text"))
    return docs.select("doc_id", mh.minhash(F.col("text")).alias("sig"))


@query
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signatures(spark, sf_dir).select("doc_id", F.array_join("sig", ",").alias("sig"))


@query
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _signatures(spark, sf_dir).select("doc_id", mh.band_keys(F.col("sig")).alias("keys"))
    rows = keyed.select("doc_id", F.posexplode("keys").alias("band", "key"))
    return rows.select("doc_id", "band", F.lower(F.hex("key")).alias("key"))


@query
def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.build_vocab(vocab.count_tokens(corpus.training_texts(spread_documents(spark, sf_dir))))


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    coded = corpus.tokenize(spread_documents(spark, sf_dir), tokenizer, "doc_id")
    return coded.select("doc_id", F.size("tokens").alias("n"), _joined())


@query
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    coded = corpus.tokenize(spread_documents(spark, sf_dir), tokenizer, "doc_id")
    return coded.select("doc_id", tokenizer.decode(F.col("tokens")).alias("text"))


def subword_tokenizer(spark: SparkSession) -> SubwordTokenizer:
    """Sub-words of the public vocabulary."""
    return SubwordTokenizer(spark, Ranks.read(spark, SUBWORD_RANKS))


@query
def subword_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids under a public byte-level vocabulary."""
    coded = corpus.tokenize(spread_documents(spark, sf_dir), subword_tokenizer(spark), "doc_id")
    return coded.select("doc_id", F.size("tokens").alias("n_tokens"), F.sha2(_joined(), 256).alias("ids_sha256"))


@query
def subword_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their sub-words."""
    tokenizer = subword_tokenizer(spark)
    coded = corpus.tokenize(spread_documents(spark, sf_dir), tokenizer, "doc_id")
    return coded.select("doc_id", tokenizer.decode(F.col("tokens")).alias("text"))


@query
def packed_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of sub-words of all fitting texts, in order; the end id follows the last rank."""
    tokenizer = subword_tokenizer(spark)
    coded = corpus.tokenize(_fitting_spread(spark, sf_dir), tokenizer, "ord")
    rows = materialize(coded.select(F.lit(0).alias("epoch"), F.col("ord").alias("pos"), "tokens"), "subwords")
    blocks = pack.pack(rows, eos_id=tokenizer.size, pad_id=tokenizer.size)
    return blocks.select("block_idx", F.sha2(_joined(), 256).alias("ids_sha256"))


@query
def crop_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    coded = corpus.tokenize(spread_documents(spark, sf_dir), tokenizer, "doc_id")
    return coded.select("doc_id", _joined(tk.crop_last(F.col("tokens"), CONTEXT)))


@query
def retokenize_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _lexicon(spark, sf_dir)
    second = _lexicon(spark, sf_dir, tk.space_words)
    rows = evaluate.retokenize_padded(
        _val_batches(spark, sf_dir, first), first.tokenizer, second.tokenizer, VAL_BLOCK
    )
    return rows.select(
        "batch_id", "row_in_batch", F.array_join("ids", ",").alias("ids"),
        F.array_join("mask", ",").alias("mask"),
    )


# Duplicates


@query
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = dedup.first_copies(_fitting_spread(spark, sf_dir))
    return firsts.select(F.lower(F.hex("digest")).alias("digest"), F.col("ord").alias("doc_id"))


@query
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = materialize(dedup.first_copies(_fitting_spread(spark, sf_dir)).select("ord"), "firsts")
    return dedup.dense_ids(firsts).select(F.col("ord").alias("doc_id"), "dense_id")


@query
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = dedup.label_documents(_fitting_spread(spark, sf_dir))
    return labels.select(F.col("ord").alias("doc_id"), "label")


@query
def dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_report(dedup.label_documents(_fitting_spread(spark, sf_dir)))


@query
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = dedup.fingerprints(_fitting_spread(spark, sf_dir))
    unique = materialize(dedup.unique_fingerprints(prints), "unique")
    kept = dedup.greedy_keep(unique, mh.band_shape()[0])
    found = dedup.lsh_candidates(unique, kept)
    return found.select(F.col("ord").alias("doc_id"), "candidate")


@query
def incremental_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _fitting_spread(spark, sf_dir).select("ord", "text")
    low, high = docs.agg(F.min("ord"), F.max("ord")).first()
    width = (high - low) // 3 + 1
    store = DuplicateStore(spark, new_path(spark, "store"))
    for group in range(3):
        start = low + group * width
        store.add(docs.where((F.col("ord") >= start) & (F.col("ord") < start + width)), group)
    return store.labels().select(F.col("ord").alias("doc_id"), "label")


# Packing


def _packed(
    spark: SparkSession, sf_dir: str, lossless: bool = True, block_size: int = BLOCK_SIZE
) -> DataFrame:
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    return corpus.pack_in_order(spread_documents(spark, sf_dir), tokenizer, block_size, lossless)


@query
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("block_idx", _joined())


@query
def pack_sequences_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir, False, LOSSY_BLOCK).select("block_idx", _joined())


@query
def pack_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tk.words(F.col("text"))
    lengths = spread_documents(spark, sf_dir).select(
        F.lit(0).alias("epoch"), F.col("ord").alias("pos"), F.size(tokens).alias("n")
    )
    chunk_bits, group_bits = LEVEL_BITS
    placed = pack.layout(materialize(lengths, "lengths"), BLOCK_SIZE, True, chunk_bits, group_bits)
    return pack.block_layout(placed).drop("epoch")


@query
def packed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = corpus.packed_corpus(
        spread_documents(spark, sf_dir), _lexicon(spark, sf_dir).tokenizer, "train", (0, 1)
    )
    return blocks.select("epoch", "block_idx", _joined())


@query
def batch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = pack.batch_blocks(_packed(spark, sf_dir), BATCH)
    return batches.select("batch_id", "row_in_batch", _joined())


@query
def shift_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select(
        "block_idx",
        F.array_join(tk.inputs(F.col("tokens")), ",").alias("x"),
        F.array_join(tk.targets(F.col("tokens")), ",").alias("y"),
    )


@query
def target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select(
        "block_idx",
        F.size(tk.targets(F.col("tokens"))).alias("targets"),
        F.size(tk.counted_targets(F.col("tokens"))).alias("counted"),
    )


@query
def shard_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = pack.shard_blocks(materialize(_packed(spark, sf_dir), "blocks"), WORLD_SIZE)
    return shards.select("rank", "slot", "block_idx", _joined())


@query
def shuffled_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two epochs dealt over ranks, in another order each epoch."""
    tokenizer = _lexicon(spark, sf_dir).tokenizer
    blocks = corpus.packed_corpus(spread_documents(spark, sf_dir), tokenizer, "train", (0, 1))
    shards = pack.shard_blocks(materialize(blocks, "blocks"), WORLD_SIZE, SHUFFLE_SEED)
    return shards.select("epoch", "rank", "slot", "block_idx", _joined())


@query
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = pack.token_budget(_packed(spark, sf_dir))
    return budget.withColumn("optimizer_steps", F.round("optimizer_steps", 6))


# Evaluation


def _val_batches(spark: SparkSession, sf_dir: str, lexicon: corpus.Lexicon) -> DataFrame:
    blocks = corpus.packed_corpus(
        spread_documents(spark, sf_dir), lexicon.tokenizer, "val", (0,), VAL_BLOCK
    )
    return materialize(pack.batch_blocks(blocks, VAL_BATCH, VAL_BLOCK), "val_batches")


def _val_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, evaluate.Scorer]:
    """The whole validation split packed in document order, and its scorer."""
    lexicon = _lexicon(spark, sf_dir)
    docs = documents(spark, sf_dir).where(in_split(F.col("text"), "val"))
    blocks = corpus.pack_in_order(docs, lexicon.tokenizer, VAL_BLOCK)
    batches = pack.batch_blocks(blocks, VAL_BATCH, VAL_BLOCK)
    return batches, lexicon.scorer()


@query
def token_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, scorer = _val_rows(spark, sf_dir)
    losses = evaluate.token_nll(batches, scorer, ["batch_id", "row_in_batch"])
    return losses.withColumn("nll", F.round("nll", 6))


@query
def seq_mean_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, scorer = _val_rows(spark, sf_dir)
    key = ["batch_id", "row_in_batch"]
    mean = lambda total, n: F.round(F.when(F.col(n) > 0, F.col(total) / F.col(n)), 6)
    return evaluate.sequence_losses(batches, scorer, key).select(
        *key, mean("total", "n").alias("with_pad"), mean("total_real", "n_real").alias("without_pad")
    )


@query
def val_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    loss = evaluate.val_loss(_val_batches(spark, sf_dir, lexicon), lexicon.scorer())
    return loss.withColumn("val_loss", F.round("val_loss", 6))


def _ngram_model(spark: SparkSession, sf_dir: str, lexicon: corpus.Lexicon) -> ngram.NgramModel:
    """Trigrams of the training texts under their own vocabulary."""
    texts = corpus.training_texts(spread_documents(spark, sf_dir))
    coded = corpus.tokenize(texts, lexicon.tokenizer)
    return ngram.NgramModel(coded, lexicon.vocab.count() + FIRST_WORD_ID)


@query
def ngram_token_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses that depend on the words in front, of the whole validation split."""
    lexicon = _lexicon(spark, sf_dir)
    docs = documents(spark, sf_dir).where(in_split(F.col("text"), "val"))
    batches = pack.batch_blocks(corpus.pack_in_order(docs, lexicon.tokenizer, VAL_BLOCK), VAL_BATCH, VAL_BLOCK)
    losses = _ngram_model(spark, sf_dir, lexicon).token_nll(batches, ["batch_id", "row_in_batch"])
    return losses.withColumn("nll", F.round("nll", 6))


@query
def ngram_val_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    model = _ngram_model(spark, sf_dir, lexicon)
    loss = ngram.context_val_loss(_val_batches(spark, sf_dir, lexicon), model)
    return loss.withColumn("val_loss", F.round("val_loss", 6))


@query
def val_loss_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _lexicon(spark, sf_dir)
    second = _lexicon(spark, sf_dir, tk.space_words)
    compared = evaluate.compare_val_loss(
        _val_batches(spark, sf_dir, first),
        first.tokenizer,
        first.scorer(),
        second.tokenizer,
        second.scorer(),
        VAL_BLOCK,
    )
    return compared.withColumn("val_loss", F.round("val_loss", 6))


def _choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = _lexicon(spark, sf_dir)
    return evaluate.choice_scores(choice_items(spark, sf_dir), lexicon.tokenizer, lexicon.scorer())


@query
def choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choice_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


@query
def choice_plugged_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy under a tokenizer and a scorer that are no tables."""

    class Letters:
        """Ids from 3 on for the code points of a text."""

        def encode(self, text):
            letters = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)
            return F.transform(letters, lambda c: F.ascii(c) % 97 + 3)

        def decode(self, ids):
            return F.lit(None).cast("string")

    def rare(tokens):
        return F.transform(tk.targets(tokens), lambda t: F.log(t.cast("double")))

    scored = evaluate.choice_scores(choice_items(spark, sf_dir), Letters(), rare)
    return evaluate.choice_predict(scored)


@query
def choice_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.choice_predict(_choice_scores(spark, sf_dir))


@query
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy = evaluate.choice_accuracy(choice_predict(spark, sf_dir))
    return accuracy.withColumn("accuracy", F.round("accuracy", 6))


# Training logs


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainlog.with_steps(training_log(spark, sf_dir))


@query
def log_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trainlog.every_n(_log(spark, sf_dir))
    return lines.select("run_id", "step", "loss", "validates", "saves")


@query
def loss_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainlog.loss_ema(_log(spark, sf_dir)).withColumn("smoothed", F.round("smoothed", 6))


@query
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    step_tokens = SEQUENCES_PER_PASS * PASSES_PER_STEP * BLOCK_SIZE
    rates = trainlog.throughput(_log(spark, sf_dir), step_tokens)
    return rates.select(
        "run_id", "step", F.round("seconds", 6).alias("seconds"),
        F.round("tokens_per_sec", 3).alias("tokens_per_sec"),
    )


@query
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trainlog.best_so_far(_log(spark, sf_dir))


@query
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = trainlog.learning_rate(F.col("ord"))
    return training_log(spark, sf_dir).select("run_id", F.col("ord").alias("step"), F.round(rate, 9).alias("lr"))


# Streams


def _streamed(
    spark: SparkSession, sf_dir: str, label: str, transform: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Table written by ``transform`` of the document stream, one run per delivery."""
    docs = documents(spark, sf_dir).select("ord", "text")
    out = new_path(spark, label)
    for path in arrivals(docs, "stream_input"):
        stream = jobs.read_documents(spark, path, "ord bigint, text string", FILES_PER_BATCH)
        result = jobs.append_to_table(transform(stream), out)
    return result


@query
def stream_split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    def transform(stream: DataFrame) -> DataFrame:
        kept = jobs.split_and_filter(stream)
        return kept.select(F.col("ord").alias("doc_id"), "split", F.length("text").alias("chars"))

    return _streamed(spark, sf_dir, "stream_split", transform)


def _dedup_stream(spark: SparkSession, sf_dir: str, near: bool) -> DataFrame:
    docs = documents(spark, sf_dir).select("ord", "text")
    out = new_path(spark, "stream_dedup")
    store = DuplicateStore(spark, f"{out}/store")
    for path in arrivals(docs, "stream_input"):
        stream = jobs.read_documents(spark, path, "ord bigint, text string")
        fitting = stream.where(length_ok(F.col("text")))
        jobs.dedup_stream(fitting, store, f"{out}/checkpoint", near).awaitTermination()
    return store.labels().select(F.col("ord").alias("doc_id"), "label")


@query
def stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup_stream(spark, sf_dir, near=False)


@query
def stream_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dedup_stream(spark, sf_dir, near=True)


@query
def stream_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def transform(stream: DataFrame) -> DataFrame:
        distinct = jobs.distinct_texts(stream.where(length_ok(F.col("text"))))
        return distinct.select(F.lower(F.hex("digest")).alias("digest"))

    return _streamed(spark, sf_dir, "stream_distinct", transform)


@query
def stream_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = _lexicon(spark, sf_dir).tokenizer.encode
    docs = documents(spark, sf_dir).select("ord", "text")
    out = new_path(spark, "stream_pack")
    for path in arrivals(docs, "stream_input"):
        # Opened anew per delivery, as a job that is started again would do.
        store = jobs.PackStore(spark, f"{out}/store", SHARDS)
        stream = jobs.read_documents(spark, path, "ord bigint, text string")
        fitting = stream.where(length_ok(F.col("text")))
        coded = fitting.select("ord", encode(F.col("text")).alias("tokens"))
        jobs.pack_stream(coded, store, f"{out}/checkpoint").awaitTermination()
    return store.finish().select("shard", "block_idx", _joined())
