"""Exact dedup by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import SPACE, materialize, skew_join

#: Characters under the prefix hash, and the least and most slots of the survivors' filter (its broadcast is at most that many longs).
PREFIX_CHARS = 256
SLOTS = (1 << 16, 1 << 22)


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Rounds: rows are grouped by length and, within it, by a hash of the prefix; only rows of
    groups with a second member have their full content hashed, and only those hashes are
    shuffled. Which rows those are travels as a filter of at most SLOTS longs, eight for each such
    group while that lasts: a row of a lonely group that shares a slot is hashed too, ends in a group
    of one, and stays. With more groups than slots more is hashed than needed, and nothing is lost.
    The second pass over the text writes id and hash once; what follows reads those alone.

    Null texts count as empty, and empty texts equal each other. Of equal texts the smallest
    id stays; a null id is larger than any, and rows that repeat the staying id all stay with
    it. ``text_sha256`` is null where no full hash was needed, unless ``digest_all``. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__norm"))
    keyed = rows.withColumn("__len", F.length("__norm")).withColumn("__pre", F.xxhash64(F.substring("__norm", 1, PREFIX_CHARS)))
    shared = keyed.groupBy("__len", "__pre").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__len", "__pre")
    shared = materialize(shared, "shared-prefixes")
    slots, many = SLOTS[0], shared.count()
    while slots < SLOTS[1] and slots < 8 * many:
        slots *= 2
    slot = F.pmod(F.xxhash64("__len", "__pre"), F.lit(slots))
    live = shared.select(slot.alias("__slot"), F.lit(True).alias("__live")).distinct()
    digest = F.sha2("__norm", 256)
    probed = keyed.withColumn("__slot", slot).join(F.broadcast(live), "__slot", "left")
    hashed = probed.select("__id", F.col("__live").isNotNull().alias("__live"), (digest if digest_all else F.when(F.col("__live"), digest)).alias("__sha"))
    hashed = materialize(hashed, "exact")

    groups = hashed.where("__live").groupBy("__sha").agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    joined = skew_join(hashed, groups, ["__sha"], F.col("__id"))
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("__id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("__id").eqNullSafe(keep).alias("kept"), F.col("__sha").alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
"""
