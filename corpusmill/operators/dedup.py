"""Exact and near duplicates, first in stream order kept.

One scan turns each text into a narrow fingerprint: digest and band keys. All grouping
and joining after that moves fingerprints only. Signatures are computed for exact
copies too, which costs CPU but avoids sending every surviving text through a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.config import DEDUP_THRESHOLD, NUM_PERM
from corpusmill.functions.minhash import band_keys, band_shape, minhash
from corpusmill.functions.text import digest, normalize
from corpusmill.operators.ordered import global_index
from corpusmill.scratch import materialize, new_path

SALTS = 64  # pieces a hot band key is cut into
CHAINS_FROM = 3  # rounds after which chains of neighbours are walked by doubling
_LEADERS = "ord bigint, led bigint, shared array<struct<band: int, key: binary>>"


def _normal_text() -> Column:
    """The normalised text; null counts as empty, since null digests are equal to nothing."""
    return normalize(F.coalesce("text", F.lit("")))


def exact_digests(docs: DataFrame) -> DataFrame:
    """``(ord, digest)`` of the normalised text."""
    return docs.select("ord", digest(_normal_text()).alias("digest"))


def first_copies(docs: DataFrame) -> DataFrame:
    """``(digest, ord)`` of the first document of each normalised text."""
    return exact_digests(docs).groupBy("digest").agg(F.min("ord").alias("ord"))


def dense_ids(survivors: DataFrame) -> DataFrame:
    """``(ord, dense_id)``: survivors numbered from 0 in stream order."""
    return global_index(survivors.select("ord"), "ord", name="dense_id")


def fingerprints(
    docs: DataFrame, threshold: float = DEDUP_THRESHOLD, num_perm: int = NUM_PERM
) -> DataFrame:
    """``(ord, digest, keys)``: one pass over the texts, written once."""
    normal = docs.select("ord", _normal_text().alias("text"))
    signed = normal.select(
        "ord", digest(F.col("text")).alias("digest"), minhash(F.col("text"), num_perm).alias("sig")
    )
    return materialize(
        signed.select("ord", "digest", band_keys(F.col("sig"), threshold, num_perm).alias("keys")),
        "fingerprints",
    )


def unique_fingerprints(prints: DataFrame) -> DataFrame:
    """First document of each digest, with its band keys (equal texts share them)."""
    return prints.groupBy("digest", "keys").agg(F.min("ord").alias("ord"))


def band_rows(keyed: DataFrame) -> DataFrame:
    """``(ord, band, key)``: one row per band of each document."""
    return keyed.select("ord", F.posexplode("keys").alias("band", "key"))


def _salt(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salted_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", _salt(F.col("ord")))


def _salted_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys (band, key, ...)`` once per salt under which ``rows`` holds the key.

    A join on ``(band, key, salt)`` then spreads one key over ``SALTS`` tasks, so a key
    shared by a large part of the corpus is not one task, while a rare key is repeated
    no more often than it has rows. The distinct cells are found map-side first, at most
    ``SALTS`` per key; ``keys`` holds each key once.
    """
    cells = rows.select("band", "key", "salt").distinct()
    return cells.join(keys, ["band", "key"])


def _members(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct ``ord`` of the band rows whose ``(band, key)`` is in ``keys``."""
    salted = _salted_rows(rows)
    wanted = _salted_keys(salted, keys)
    return salted.join(wanted, ["band", "key", "salt"], "left_semi").select("ord").distinct()


def greedy_keep(
    keyed: DataFrame, bands: int, stored: DataFrame | None = None
) -> DataFrame:
    """``ord`` of the documents kept by the first-come rule.

    In order, a document is kept unless an earlier kept one shares a band key with it.
    ``stored (band, key)`` holds the keys of documents kept before this call.

    Documents with equal keys in all bands stand or fall with their first, so groups of
    copies shrink to one row before anything else. Then, per round: a document that
    comes first in all its buckets is kept, and the other members of these buckets are
    not. No pairs are formed; a bucket costs its number of members.
    """
    spark = keyed.sparkSession
    rest = keyed.groupBy("keys").agg(F.min("ord").alias("ord"))
    if stored is not None:
        rows = band_rows(rest)
        present = rows.select("band", "key").distinct()
        known = stored.join(present, ["band", "key"], "left_semi").distinct()
        rest = rest.join(_members(rows, known), "ord", "left_anti")
    rest = materialize(rest, "undecided")
    path, step = new_path(spark, "leaders"), 0
    leaders = spark.read.schema(_LEADERS)
    while not rest.isEmpty():
        buckets = band_rows(rest).groupBy("band", "key").agg(
            F.min("ord").alias("ord"), F.count(F.lit(1)).alias("members")
        )
        # At most one entry per band and document, so these lists are short.
        shared = F.when(F.col("members") > 1, F.struct("band", "key"))
        leading = buckets.groupBy("ord").agg(F.count(F.lit(1)).alias("led"), F.collect_list(shared).alias("shared"))
        if step >= CHAINS_FROM:
            alike = F.transform("keys", lambda key, band: F.struct(band.alias("band"), key.alias("key")))
            followers = rest.join(_chain_kept(rest, bands), "ord", "left_semi")
            leading = leading.where(F.col("led") == bands).unionByName(
                followers.select("ord", F.lit(bands).cast("bigint").alias("led"), alike.alias("shared"))
            )
        leading.write.parquet(f"{path}/round={step}")
        kept = leaders.parquet(f"{path}/round={step}").where(F.col("led") == bands)
        hit = kept.select(F.explode("shared").alias("s")).select("s.band", "s.key")
        rest = rest.join(kept.select("ord"), "ord", "left_anti")
        rest = rest.join(_members(band_rows(rest), hit), "ord", "left_anti")
        rest = materialize(rest, "undecided")
        step += 1
    if step == 0:
        return keyed.select("ord").limit(0)
    return leaders.parquet(path).where(F.col("led") == bands).select("ord")


def _chain_kept(rest: DataFrame, bands: int) -> DataFrame:
    """``ord`` of the documents that chains of single earlier neighbours show to be kept.

    A document with exactly one earlier neighbour is kept if that one is not. So it points
    there, pointers double by parity, and where they end at a document without earlier
    neighbours, which is kept, those an even number of steps away are kept too. Of a
    bucket only the first two members count: any other has two earlier neighbours.
    """
    order = Window.partitionBy("band", "key").orderBy("ord")
    rows = band_rows(rest).withColumn("nth", F.row_number().over(order)).where("nth <= 2")
    pairs = rows.groupBy("band", "key").agg(F.min("ord").alias("first"), F.max("ord").alias("second"))
    places = F.array(
        F.struct(F.col("first").alias("ord"), F.lit(None).cast("bigint").alias("before")),
        F.when(F.col("first") < F.col("second"), F.struct(F.col("second").alias("ord"), F.col("first").alias("before"))),
    )
    seen = pairs.select(F.explode(places).alias("p")).where("p is not null").select("p.*")
    known = seen.groupBy("ord").agg(F.count(F.lit(1)).alias("placed"), F.collect_set("before").alias("before"))
    known = materialize(known.where(F.col("placed") == bands).drop("placed"), "chains")
    heads = known.where(F.size("before") == 0).select("ord")
    links = known.where(F.size("before") == 1).select("ord", F.col("before")[0].alias("root"), F.lit(1).alias("steps"))
    while True:
        ahead = links.select(F.col("ord").alias("root"), F.col("root").alias("_far"), F.col("steps").alias("_more"))
        jumped = links.join(ahead, "root", "left").select(
            "ord",
            F.coalesce("_far", "root").alias("root"),
            ((F.col("steps") + F.coalesce("_more", F.lit(0))) % 2).alias("steps"),
            F.col("_far").isNotNull().alias("moved"),
        )
        jumped = materialize(jumped, "chains")
        links = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            break
    even = links.where("steps = 0").join(heads.withColumnRenamed("ord", "root"), "root", "left_semi")
    return even.select("ord")


def label_documents(
    docs: DataFrame, threshold: float = DEDUP_THRESHOLD, num_perm: int = NUM_PERM
) -> DataFrame:
    """``(ord, label)`` with label ``kept``, ``near_dup`` or ``exact_dup``."""
    bands, _ = band_shape(threshold, num_perm)
    prints = fingerprints(docs, threshold, num_perm)
    unique = unique_fingerprints(prints)
    kept = greedy_keep(unique, bands)
    return document_labels(prints, unique, kept)


def document_labels(prints: DataFrame, unique: DataFrame, kept: DataFrame) -> DataFrame:
    """``(ord, label)`` of all ``prints``: kept, first of its digest but not kept, or a copy."""
    label = (
        F.when(F.col("is_kept"), "kept").when(F.col("is_first"), "near_dup").otherwise("exact_dup")
    )
    firsts = unique.select("ord", F.lit(True).alias("is_first")).join(
        kept.select("ord", F.lit(True).alias("is_kept")), "ord", "left"
    )
    return prints.select("ord").join(firsts, "ord", "left").select("ord", label.alias("label"))


def dedup_report(labels: DataFrame) -> DataFrame:
    """Exact-unique documents (near duplicates included) and near duplicates."""
    return labels.agg(
        F.count_if(F.col("label") != "exact_dup").alias("exact_unique"),
        F.count_if(F.col("label") == "near_dup").alias("near_dups"),
    )


def lsh_candidates(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """``(ord, candidate)``: earlier kept documents sharing a band key with each document.

    A bucket holds at most one kept document, so there are at most as many candidates
    per document as bands, and no pairs within a bucket.
    """
    indexed = band_rows(keyed.join(kept.select("ord"), "ord", "left_semi"))
    indexed = indexed.withColumnRenamed("ord", "candidate")
    salted = _salted_rows(band_rows(keyed))
    found = salted.join(_salted_keys(salted, indexed), ["band", "key", "salt"])
    return found.where(F.col("candidate") < F.col("ord")).select("ord", "candidate").distinct()
