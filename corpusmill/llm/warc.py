"""WARC archives: written by Spark's text writer, read back along verified record chains.

A record is a header, a blank line, the payload and a blank line, all of it UTF-8 text
here; so records are lines of the text source with CR LF CR LF as the line separator.
Reading with the same separator gives pieces: headers, and parts of payloads that hold
blank lines themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.rows import bit_filter, may_hold
from corpusmill.scratch import Scope, discard, materialize, new_path

BLANK = "\r\n\r\n"
MAGIC = "WARC/1.1\r\n"
SHARED_BYTES = 100  # payloads from this size on are stored once
RECORDS_PER_FILE = 2048
DATE = "1970-01-01T00:00:00Z"  # of all records, so that reruns write the same bytes


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of ``pages (page_id, url, html)`` into the gzip files of ``path``.

    A packed file is read by one task, so its number of records is bounded.

    Of equal payloads of at least ``SHARED_BYTES`` the one with the smallest page_id is
    stored, as a response; the others are revisits that refer to it. Null html counts as
    empty; rows that repeat the smallest page_id are responses too; a null page_id is
    larger than any other.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), payload.alias("html")
    ).withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    large = F.col("n") >= SHARED_BYTES
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    with Scope(pages.sparkSession) as scope:
        # Only digests take part in finding repeated payloads; a filter of fixed size lets the
        # others' rows pass where they stand.
        repeated = scope.keep(firsts.where("rows > 1").select("digest", "first"), "warc_repeated")
        shared = bit_filter(repeated.select(F.xxhash64("digest").alias("hash")))
        maybe = rows.withColumn("maybe", large & may_hold(shared, F.xxhash64("digest")))
        single = maybe.where(~F.col("maybe")).withColumn("first", F.lit(None).cast("long"))
        joined = maybe.where("maybe").join(repeated, "digest", "left").select(*single.columns).unionByName(single)
        revisit = F.coalesce(~F.col("first").eqNullSafe(F.col("page_id")), F.lit(False)) & F.col("first").isNotNull()
        url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
        refers = F.when(revisit, _line("WARC-Refers-To", _urn(F.col("first")))).otherwise("")
        header = F.concat(
            F.lit(MAGIC),
            _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            _line("WARC-Record-ID", _urn(F.col("page_id"))),
            refers,
            _line("WARC-Date", F.lit(DATE)),
            _line("WARC-Target-URI", url),
            _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            _line("WARC-Payload-Length", F.col("n").cast("string")),
            _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))),
        )
        body = F.when(revisit, "").otherwise(F.col("html"))
        # The header's last line end is the first half of the blank line.
        records = joined.select(F.concat(header, F.lit("\r\n"), body).alias("value"))
        writer = records.write.option("lineSep", BLANK).option("maxRecordsPerFile", records_per_file)
        writer.option("compression", "gzip").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, size, piece)`` in the order of each file.

    A packed file is read by one task from its beginning. ``file`` is a hash of its path:
    of a million files two share one with a chance of 3e-8.
    """
    pieces = spark.read.option("lineSep", BLANK).text(path)
    size = F.octet_length("value").cast("long") + len(BLANK)
    return pieces.select(F.xxhash64("_metadata.file_path").alias("file"), size.alias("size"), F.col("value").alias("piece"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``size`` turned into the offset in the file, by running sums from file to file."""
    current, end = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files, sizes = batch.column("file").to_numpy(), batch.column("size").to_numpy()
        ends = np.cumsum(sizes)
        begins = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1]]))
        base = (ends - sizes)[begins]
        if files[0] == current:
            base[0] = -end
        offsets = ends - sizes - np.repeat(base, np.diff(np.concatenate([begins, [len(files)]])))
        current, end = files[-1], int(offsets[-1] + sizes[-1])
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(offsets), batch.column("piece")], ["file", "offset", "piece"])


def read_pieces(lines: DataFrame) -> DataFrame:
    """``(file, offset, piece)`` of ``_lines``; offsets in unpacked bytes. Nothing is shuffled."""
    return lines.mapInArrow(_placed, "file bigint, offset bigint, piece string")


def _field(piece: Column, name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(piece, rf"\r\n{name}: {pattern}", 1), F.lit(""))


def _looks_like_header(piece: Column) -> Column:
    return F.startswith(piece, F.lit(MAGIC)) | F.startswith(piece, F.lit("\r\n" + MAGIC))


def candidates(pieces: DataFrame) -> DataFrame:
    """Pieces that look like a header, with the offset at which the next record would start.

    A payload that ends in CR LF leaves these two bytes in front of the next header,
    since the separator matches as early as it can.
    """
    lead = F.when(F.startswith("piece", F.lit("\r\n" + MAGIC)), 2).otherwise(0)
    content = F.expr(r"try_cast(nullif(regexp_extract(piece, '\r\nContent-Length: ([0-9]{1,18})(?:\r|$)', 1), '') as bigint)")
    header = F.octet_length("piece").cast("long") + 2 * len(BLANK)
    return pieces.where(_looks_like_header(F.col("piece"))).select(
        "file",
        "offset",
        (F.col("offset") + lead).alias("start"),
        content.alias("content"),
        (F.col("offset") + header + content).alias("successor"),
    )


def reachable(scope: Scope, found: DataFrame) -> DataFrame:
    """``(file, offset)`` of the candidates on the chain that starts each file.

    Neighbours whose successor is the next candidate form runs; within a run everything
    behind a reached candidate is reached. Only where runs are entered takes pointer
    jumping: each entry points to the one its run's end leads to, pointers double per
    round, and what the file's start reaches grows with them. An archive whose payloads
    hold no look-alikes is one run and takes no round.
    """
    order = Window.partitionBy("file").orderBy("start")
    linked = F.col("successor") == F.lag("start", -1).over(order)
    runs = found.withColumn("_end", ~F.coalesce(linked, F.lit(False)))
    ended = F.count_if("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = scope.keep(
        runs.withColumn("_run", F.coalesce(ended, F.lit(0)))
        .withColumn(
            "_exit", F.max(F.when(F.col("_end"), F.col("successor"))).over(Window.partitionBy("file", "_run"))
        )
        .select("file", "offset", "start", "_run", "_end", "_exit"),
        "warc_runs",
    )
    exits = runs.where("_end").select("file", F.col("_exit").alias("start")).distinct()
    entered = runs.where(F.col("start") == 0).select("file", "start", "_run", "_exit").unionByName(
        runs.where(F.col("start") > 0).join(exits, ["file", "start"], "left_semi").select("file", "start", "_run", "_exit")
    )
    entered = scope.keep(entered, "warc_entries")
    reached = scope.keep(entered.where(F.col("start") == 0).select("file", "start"), "warc_reached")
    pointers = entered.select("file", "start", F.col("_exit").alias("next"))
    pointers = pointers.join(
        entered.select("file", F.col("start").alias("next")), ["file", "next"], "left_semi"
    ).select("file", "start", "next")
    pointers = scope.keep(pointers, "warc_pointers")
    while not pointers.isEmpty():
        ahead = reached.join(pointers, ["file", "start"]).select("file", F.col("next").alias("start"))
        new = scope.keep(ahead.join(reached, ["file", "start"], "left_anti").distinct(), "warc_new")
        if new.isEmpty():
            break
        reached = scope.keep(reached.unionByName(new), "warc_reached")
        twice = pointers.select("file", F.col("start").alias("next"), F.col("next").alias("_far"))
        pointers = scope.keep(
            pointers.join(twice, ["file", "next"]).select("file", "start", F.col("_far").alias("next")),
            "warc_pointers",
        )
    first = entered.join(reached, ["file", "start"], "left_semi").groupBy("file", "_run").agg(
        F.min("start").alias("_from")
    )
    return runs.join(first, ["file", "_run"]).where(F.col("start") >= F.col("_from")).select("file", "offset")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, intact)`` per record.

    Only records on a file's chain count, so a header inside a payload is payload. Length
    and digest of a response are those of the payload as read; ``intact`` tells whether
    they are what its header says. A revisit has them from its header.
    """
    with Scope(spark) as scope:
        return materialize(_records(scope, _lines(spark, path)), "warc_records")


def _records(scope: Scope, lines: DataFrame) -> DataFrame:
    # Payloads stay behind while candidates are placed.
    heads = lines.withColumn("piece", F.when(_looks_like_header(F.col("piece")), F.col("piece")))
    found = scope.keep(candidates(read_pieces(heads)), "warc_candidates")
    chain = scope.keep(reachable(scope, found), "warc_chain")
    # A record's mark comes right in front of its header, and then its payload's parts.
    marks = chain.select("file", "offset", F.lit(None).cast("string").alias("piece"), F.lit(0).alias("kind"))
    parts = read_pieces(lines).withColumn("kind", F.lit(1))
    order = Window.partitionBy("file").orderBy("offset", "kind")
    record = F.last(F.when(F.col("kind") == 0, F.col("offset")), ignorenulls=True).over(order)
    is_header = F.col("offset") == F.col("_record")
    part = F.when(~is_header, F.struct("offset", "piece"))
    records = (
        marks.unionByName(parts)
        .withColumn("_record", record)
        .where("kind = 1 and _record is not null")
        .groupBy("file", "_record")
        .agg(F.max(F.when(is_header, F.col("piece"))).alias("header"), F.array_sort(F.collect_list(part)).alias("parts"))
    )
    h = F.col("header")
    content = _field(h, "Content-Length", "([0-9]+)").cast("long")
    joined = F.array_join(F.transform("parts", lambda p: p["piece"]), BLANK)
    # A final CR LF of the payload was left in front of the next header, or at the file's
    # end as a piece of its own.
    records = records.select("header", joined.alias("payload"))
    size = F.octet_length("payload").cast("long")
    whole = (
        F.when(size + 2 == content, F.concat("payload", F.lit("\r\n")))
        .when(size - len(BLANK) == content, F.left("payload", F.length("payload") - len(BLANK)))
        .otherwise(F.col("payload"))
    )
    records = records.withColumn("payload", whole)
    kind = _field(h, "WARC-Type", "([a-z]+)")
    said = _field(h, "WARC-Payload-Digest", "sha256:([0-9a-f]+)")
    said_bytes = _field(h, "WARC-Payload-Length", "([0-9]+)").cast("long")
    response = kind == "response"
    read_bytes, read_digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    return records.select(
        _field(h, "WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        F.when(response, read_bytes).otherwise(said_bytes).alias("payload_bytes"),
        F.when(response, read_digest).otherwise(said).alias("payload_digest"),
        kind.alias("record_type"),
        _field(h, "WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        F.when(response, (read_bytes == said_bytes) & (read_digest == said))
        .otherwise(F.octet_length("payload") == 0)
        .alias("intact"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the scratch folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    result = read_archives(pages.sparkSession, path)
    discard(pages.sparkSession, path)
    return result
