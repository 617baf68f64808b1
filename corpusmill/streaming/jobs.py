"""Streaming forms of the corpus jobs.

Reading a few files at a time (``maxFilesPerTrigger``) bounds how far a job reads
ahead. Where "first seen" must be exact, each micro-batch runs the batch operator
against a stored table; batch ids make repeated batches harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.config import BLOCK_SIZE, EOS_ID, PAD_ID
from corpusmill.functions.split import split_name
from corpusmill.functions.text import digest, length_ok, normalize
from corpusmill.operators.pack import assemble, layout
from corpusmill.operators.store import DuplicateStore
from corpusmill.scratch import Scope

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_documents(
    spark: SparkSession,
    path: str,
    schema: str = DOCUMENT_SCHEMA,
    files_per_batch: int | None = None,
) -> DataFrame:
    """A stream of documents from a folder of Parquet files.

    Files are taken in the order of their times. ``files_per_batch`` bounds a micro-batch;
    where order matters, use it only if files arrive one after another in stream order.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def split_and_filter(docs: DataFrame) -> DataFrame:
    """Add ``split`` and keep texts of fitting length; no state."""
    return docs.where(length_ok(F.col("text"))).withColumn("split", split_name(F.col("text")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One document per normalised text, by state store; which copy is left open."""
    normal = normalize(F.coalesce("text", F.lit("")))
    return docs.withColumn("digest", digest(normal)).dropDuplicates(["digest"])


def append_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over the input not yet seen, append to a Parquet table, return it.

    Progress is kept next to the table, so calling again goes on where it stopped.
    """
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def dedup_stream(
    docs: DataFrame, store: DuplicateStore, checkpoint: str, near: bool = True
) -> StreamingQuery:
    """Label each micro-batch of ``docs (ord, text)`` against everything before it.

    Batch ids name the store's groups, so a store belongs to one checkpoint.
    """

    def label(batch: DataFrame, batch_id: int) -> None:
        (store.add if near else store.add_exact)(batch, batch_id)

    return (
        docs.writeStream.foreachBatch(label)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class PackStore:
    """Blocks of a growing stream, packed per shard, as tables.

    Document ``ord`` belongs to shard ``ord % shards``; the number of shards is fixed with
    the store and kept in it, so growth or a restart never moves a document. Each group
    writes its blocks and, per shard, the tokens of the unfinished block with its number,
    in ``group=<id>`` folders that a repeated group replaces. ``finish`` pads what is left.
    """

    BLOCKS = "shard int, block_idx bigint, tokens array<int>, done boolean"

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        shards: int,
        block_size: int = BLOCK_SIZE,
        lossless: bool = True,
        eos_id: int = EOS_ID,
    ):
        self.spark, self.path, self.shards = spark, path, shards
        self.block_size, self.lossless, self.eos_id = block_size, lossless, eos_id
        settings = spark.createDataFrame(
            [(shards, block_size, lossless, eos_id)],
            "shards int, block_size int, lossless boolean, eos_id int",
        )
        settings.write.mode("ignore").parquet(f"{path}/settings")
        kept = spark.read.parquet(f"{path}/settings").first()
        if tuple(kept) != (shards, block_size, lossless, eos_id):
            raise ValueError(f"the store at {path} was begun with {kept}")
        empty = spark.createDataFrame([], self.BLOCKS)
        empty.write.mode("ignore").parquet(f"{path}/blocks/group=-1")

    def _blocks(self) -> DataFrame:
        return self.spark.read.schema(f"{self.BLOCKS}, group bigint").parquet(f"{self.path}/blocks")

    def _tails(self, before: int) -> DataFrame:
        """``(shard, block_idx, tokens)``: each shard's unfinished block before a group."""
        open_ = self._blocks().where(~F.col("done") & (F.col("group") < before))
        last = F.max_by(F.struct("block_idx", "tokens"), "group").alias("t")
        return open_.groupBy("shard").agg(last).select("shard", "t.*")

    def add(self, docs: DataFrame, group: int) -> None:
        """Pack ``docs (ord, tokens)`` behind all earlier groups.

        Only lengths are scanned, in chunks; tokens go to ranges of blocks, so no task
        holds a shard. A shard's unfinished block is its first document, and a document
        of no tokens at its end tells where the others have led. Documents of one ``ord``
        follow each other in order of their tokens.
        """
        with Scope(self.spark) as scope:
            shard = F.pmod("ord", F.lit(self.shards)).cast("int").alias("epoch")
            copy = F.row_number().over(Window.partitionBy("ord").orderBy("tokens")).alias("copy")
            held = scope.keep(docs.select(shard, "ord", copy, "tokens"), "pack_documents")
            tails = scope.keep(self._tails(group).withColumnRenamed("shard", "epoch"), "pack_tails")
            low, high, most = held.agg(F.min("ord"), F.max("ord"), F.max("copy")).first()
            low, high, most = low or 0, high or 0, most or 1
            steps = F.floor((F.col("ord") - low) / self.shards).cast("bigint")
            end = ((high - low) // self.shards + 1) * most + 1
            parts = held.select("epoch", (steps * most + F.col("copy")).alias("pos"), "tokens").unionByName(
                tails.select("epoch", F.lit(0).cast("bigint").alias("pos"), "tokens")
            )
            ends = parts.select("epoch").distinct().select(
                "epoch", F.lit(end).cast("bigint").alias("pos"), F.lit(0).alias("n")
            )
            lengths = scope.keep(parts.select("epoch", "pos", F.size("tokens").alias("n")).unionByName(ends), "pack_lengths")
            placed = scope.keep(layout(lengths, self.block_size, self.lossless), "pack_layout")
            blocks = assemble(
                placed.join(parts, ["epoch", "pos"]), self.block_size, self.lossless, self.eos_id
            )
            last = placed.where(F.col("pos") == end).join(tails.withColumnRenamed("block_idx", "first"), "epoch", "left")
            last = last.select("epoch", "state", "block", F.coalesce("first", F.lit(0).cast("bigint")).alias("first"))
            done = F.col("block_idx") < F.col("block")
            left = F.slice("tokens", F.lit(1), F.col("state"))
            packed = blocks.join(F.broadcast(last), "epoch").select(
                F.col("epoch").alias("shard"),
                (F.col("first") + F.col("block_idx")).alias("block_idx"),
                F.when(done, F.col("tokens")).otherwise(left).alias("tokens"),
                done.alias("done"),
            )
            none = last.where("state = 0").select(
                F.col("epoch").alias("shard"),
                (F.col("first") + F.col("block")).alias("block_idx"),
                F.array().cast("array<int>").alias("tokens"),
                F.lit(False).alias("done"),
            )
            packed.unionByName(none).write.mode("overwrite").parquet(f"{self.path}/blocks/group={group}")

    def blocks(self) -> DataFrame:
        """``(shard, block_idx, tokens)`` of the blocks finished so far."""
        return self._blocks().where("done").select("shard", "block_idx", "tokens")

    def finish(self, pad_id: int = PAD_ID) -> DataFrame:
        """All blocks at the declared end of the stream: unfinished ones are padded."""
        missing = F.lit(self.block_size) - F.size("tokens")
        padded = F.concat("tokens", F.array_repeat(F.lit(pad_id), missing)).alias("tokens")
        tails = self._tails(1 << 62).where(F.size("tokens") > 0)
        return self.blocks().unionByName(tails.select("shard", "block_idx", padded))


def pack_stream(docs: DataFrame, store: PackStore, checkpoint: str) -> StreamingQuery:
    """Pack each micro-batch of ``docs (ord, tokens)`` behind everything before it.

    A task holds lengths of a chunk of documents or the tokens of a run of blocks, however
    large a micro-batch is. Batch ids name the store's groups.
    """
    return (
        docs.writeStream.foreachBatch(store.add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
