"""Reading corpora into the canonical table ``(source, ord, doc_id, text)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.split import in_split
from corpusmill.operators.ordered import running_total
from corpusmill.scratch import materialize

# Column names tried in turn, per kind of corpus.
TEXT_COLUMNS = ("text",)
PAPER_COLUMNS = ("markdown", "text")
CODE_COLUMNS = ("content", "code")
FALLBACK_COLUMNS = ("text", "content", "markdown")

BROADCAST_FILES = 1 << 16  # table of files up to which it is broadcast
READERS = ("parquet", "json", "csv", "text", "orc")


@dataclass(frozen=True)
class CorpusSource:
    """One named corpus: where it lies, its order, and which columns may hold its text.

    ``order`` names a column of whole numbers. Parquet files need none: their rows have
    a position. ``options`` are the reader's, such as ``multiLine`` for CSV.
    """

    name: str
    path: str
    format: str = "parquet"
    text_columns: tuple[str, ...] = TEXT_COLUMNS
    part: tuple[str, str] | None = None  # (partition column, value)
    schema: str | None = None
    order: str | None = None
    options: tuple[tuple[str, str], ...] = ()


def resolve_text_column(columns: list[str], candidates: tuple[str, ...]) -> str:
    """The first candidate present in ``columns``; reads the schema only."""
    for name in candidates:
        if name in columns:
            return name
    raise ValueError(f"no text column among {list(candidates)}; found {list(columns)}")


def canonical_text(df: DataFrame, candidates: tuple[str, ...], *keep: str) -> DataFrame:
    """Keep the text column, renamed to ``text``, and the columns in ``keep``."""
    name = resolve_text_column(df.columns, candidates)
    return df.select(*keep, F.col(name).alias("text"))


def first_text(columns: list[str]) -> Column:
    """First non-empty value of the fallback columns that exist, else ``''``."""
    present = [F.nullif(F.col(c), F.lit("")) for c in FALLBACK_COLUMNS if c in columns]
    return F.coalesce(*present, F.lit(""))


def read_source(spark: SparkSession, source: CorpusSource) -> DataFrame:
    """Open one corpus lazily; a ``part`` becomes a partition filter."""
    if source.format not in READERS:
        raise ValueError(f"unknown format {source.format!r}; use one of {READERS}")
    reader = spark.read.format(source.format)
    if source.schema:
        reader = reader.schema(source.schema)
    if source.format == "csv":
        reader = reader.option("header", True).option("escape", '"')
    for key, value in source.options:
        reader = reader.option(key, value)
    df = reader.load(source.path)
    if source.part:
        column, value = source.part
        df = df.where(F.col(column) == value)
    return df


def scan_split(df: DataFrame, split: str) -> DataFrame:
    """Keep the rows of one split, decided by the fallback text."""
    return df.where(in_split(first_text(df.columns), split))


def with_file_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Add an order over the rows of Parquet files: by path, then position in the file.

    Positions count on from file to file, so neither files nor rows have a limit. The
    table of files reads no column; if it is long, it is joined instead of broadcast.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = df.select(file.alias("_file"), row.alias("_row")).groupBy("_file")
    files = files.agg((F.max("_row") + 1).alias("_rows"))
    bases = materialize(running_total(files, "_rows", "_file", name="_end"), "files")
    bases = bases.select("_file", (F.col("_end") - F.col("_rows")).alias("_base"))
    if bases.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:
        bases = F.broadcast(bases)
    placed = df.select("*", file.alias("_file"), row.alias("_row"))
    joined = placed.join(bases, "_file").withColumn(name, F.col("_base") + F.col("_row"))
    return joined.drop("_file", "_row", "_base")


def with_order(df: DataFrame, source: CorpusSource) -> DataFrame:
    """Add ``ord``: the source's order column, or the position in Parquet files."""
    if source.order:
        return df.withColumn("ord", F.col(source.order).cast("long"))
    if source.format == "parquet":
        return with_file_order(df)
    raise ValueError(
        f"corpus {source.name!r}: rows of {source.format} files have no position; name an order column"
    )


def peek_first(df: DataFrame, order: str = "ord") -> DataFrame:
    """The first record in stream order."""
    return df.orderBy(order).limit(1)


def load_corpora(
    spark: SparkSession, sources: list[CorpusSource], split: str | None = None
) -> DataFrame:
    """Union of all sources as ``(source, ord, text)``, in file order or by a column.

    The split is decided before the text column is renamed, as the fallback chain
    looks at the original column names; code corpora are renamed first.
    """
    tables = []
    for source in sources:
        df = with_order(read_source(spark, source), source)
        if source.text_columns == CODE_COLUMNS:
            df = canonical_text(df, source.text_columns, "ord")
        if split:
            df = scan_split(df, split)
        df = canonical_text(
            df, TEXT_COLUMNS if source.text_columns == CODE_COLUMNS else source.text_columns, "ord"
        )
        tables.append(df.select(F.lit(source.name).alias("source"), "ord", "text"))
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table)
    return result
