"""WARC fixity audit: Merkle trees over ordered offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm._common import materialize, release

PER_FILE = 1000
RANGE = 1 << 16  # bytes under one node of the lowest range level
FAN = 16  # ranges under one node of the next
SHELF = 64  # files under one root
#: Key columns of each level, from the roots down; a level's key extends its parent's.
LEVELS = (["shelf"], ["shelf", "file"], ["shelf", "file", "wide"], ["shelf", "file", "wide", "near"], ["shelf", "file", "wide", "near", "offset"])


def warc_record(url: Column, payload: Column) -> Column:
    """A response record; null counts as empty."""
    u, body = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), u, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def lay_out(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(page_id, file, offset, length, record): pages as records of files of bounded size.

    A file takes the pages of ``per_file`` consecutive ids, in order of id and url. Pages without an id,
    and those of ids that so many pages share that a file would have more than four times ``per_file``,
    are dealt by a hash of url and content to files of negative number. Other columns are not read.
    """
    rows = pages.select("page_id", F.floor(F.col("page_id") / per_file).cast("long").alias("block"), "url", "html")
    crowded = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 4 * per_file) | F.col("block").isNull()).select(F.coalesce("block", F.lit(-1)).alias("of"), F.ceil(F.col("n") / per_file).alias("parts"))
    part = F.pmod(F.xxhash64("url", "html"), F.col("parts"))
    rows = rows.withColumn("of", F.coalesce("block", F.lit(-1))).join(crowded, "of", "left")
    file = F.when(F.col("parts").isNull(), F.col("block")).otherwise(-1 - F.pmod(F.xxhash64("of", part), F.lit(1 << 40)))
    rows = rows.select("page_id", file.cast("long").alias("file"), "url", warc_record(F.col("url"), F.col("html")).alias("record"))
    rows = rows.withColumn("length", F.octet_length("record").cast("long"))
    before = F.sum("length").over(W.partitionBy("file").orderBy("page_id", "url", F.xxhash64("record")).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).select("page_id", "file", "offset", "length", "record")


def leaves(records: DataFrame, name: str) -> DataFrame:
    """Digests of records with the keys of all levels above, written once for each replica."""
    slim = records.select(
        F.floor(F.col("file") / SHELF).cast("long").alias("shelf"), "file", F.floor(F.col("offset") / (RANGE * FAN)).cast("long").alias("wide"),
        F.floor(F.col("offset") / RANGE).cast("long").alias("near"), "offset", "length", F.sha2("record", 256).alias("digest"),
    )
    return materialize(slim, name)


def tree(leaf: DataFrame, name: str) -> list[DataFrame]:
    """Nodes of each level, roots first: a node is the digest of its children in order.

    Children of a node are few by construction, so each is one small row. Every level is written, from
    slim rows of the one below it, so an audit reads levels and computes none twice.
    """
    levels = [leaf]
    for keys in reversed(LEVELS[:-1]):
        child = LEVELS[len(keys)][-1]
        ordered = F.array_sort(F.collect_list(F.struct(F.col(child).alias("k"), F.col("digest").alias("d"))))
        nodes = levels[0].groupBy(*keys).agg(F.sha2(F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", c["k"].cast("string"), c["d"])), "\n"), 256).alias("digest"))
        levels.insert(0, materialize(nodes, f"{name}-{len(keys)}"))
    return levels


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, length, kind, digest, found) of each record that the replicas don't share.

    Both sides have file, offset, length and record. Roots are compared first; then each level reads
    the children of the nodes that differ from what was written, and nothing else. ``kind`` is altered,
    missing (not in theirs) or extra. A null record has no digest and differs from any that has; replicas
    that agree, and two empty ones, give no rows. Offsets are unique in a file. The result is written, and
    the trees are deleted.
    """
    a, b = (tree(leaves(side, f"replica-{k}"), f"level-{k}") for k, side in enumerate((ours, theirs)))
    differing, used = None, [*a, *b]
    for keys, x, y in zip(LEVELS, a, b, strict=True):
        if differing is not None:
            x, y = (side.join(differing, parent, "left_semi") for side in (x, y))
        both = x.alias("x").join(y.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys], "full_outer").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
        picked = [F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys]
        if keys is not LEVELS[-1]:
            differing, parent = materialize(both.select(*picked), "differing"), keys
            used.append(differing)
    kind = F.when(F.col("y.offset").isNull(), "missing").when(F.col("x.offset").isNull(), "extra").otherwise("altered")
    out = both.select(*picked, F.coalesce("x.length", "y.length").alias("length"), kind.alias("kind"), F.col("x.digest").alias("digest"), F.col("y.digest").alias("found")).select("file", "offset", "length", "kind", "digest", "found")
    out = materialize(out, "faults")
    release(*used)
    return out


def damaged(records: DataFrame) -> DataFrame:
    """A replica with faults planted: bytes altered in one of 101 records, zeroed in one of 211, and one of 503 lost."""
    hit = lambda k: F.coalesce(F.col("page_id") % k == 5, F.lit(False))
    zeroed = F.repeat(F.lit("0"), F.col("length").cast("int"))
    return records.where(~hit(503)).withColumn("record", F.when(hit(211), zeroed).when(hit(101), F.regexp_replace("record", "^WARC/1.0", "WARC/1.1")).otherwise(F.col("record")))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all pages, laid out as WARC files, against a replica with planted faults."""
    records = lay_out(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return audit(records, damaged(records))


ORACLE_SQL = r"""
WITH r AS (SELECT page_id, page_id // 1000 AS file, url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
o AS (SELECT *, strlen(record)::BIGINT AS length, coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM r),
d AS (SELECT *, CASE WHEN page_id % 503 = 5 THEN NULL WHEN page_id % 211 = 5 THEN repeat('0', length) WHEN page_id % 101 = 5 THEN 'WARC/1.1' || substr(record, 9) ELSE record END AS theirs FROM o)
SELECT file, "offset", length, CASE WHEN theirs IS NULL THEN 'missing' ELSE 'altered' END AS kind, sha256(record) AS digest, sha256(theirs) AS found FROM d WHERE theirs IS NULL OR theirs <> record
"""
