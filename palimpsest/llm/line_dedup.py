"""Line dedup by site-relative frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import SPACE, materialize, skew_join

#: A line is boilerplate of a host if more than this share of the host's pages hold it, and at least so many: what
#: two or three pages share may as well be copies of a page, whose lines would all go.
RATIO = 0.05
MIN_PAGES = 4
_TRIM = rf"^{SPACE}+|{SPACE}+$"
_BLOCKS = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|article|section|nav|footer|header|table|tr|td|title|body|html|head)\b[^>]*>"
_HIDDEN = (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->")
#: The entities that HTML text needs, the ampersand last.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Visible text of a page, one line per block element; null stays null."""
    out = html
    for pattern in _HIDDEN:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, _BLOCKS, "\n"), r"<[^>]*>", "")
    for entity, char in _ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, rf"{SPACE}*\n{SPACE}*", "\n"), _TRIM, "")


def url_host(url: Column) -> Column:
    """Lower-case host and port of a url; the empty text if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1))


def line_key(line: Column) -> Column:
    """128 bits of a trimmed line; null if it is blank, so that blank lines always stay."""
    trimmed = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed != "", F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b")))


def line_dedup(docs: DataFrame, host: Column, text: Column, spread: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` plus __lines, __kept (arrays of lines) by dropping the host's boilerplate lines.

    Each page counts a line once. Line keys, not lines, are counted: (host, key) is summed
    before the shuffle, then divided by the host's pages. The lines above ``ratio`` of one host
    number at most (lines per page) / ratio, so a host's list is one small row; pages meet it
    by a salted join on the host that AQE turns into a broadcast only if the lists measure small.

    A null host is a host of its own; null text has no lines; blank lines always stay; repeated
    rows count as pages of their own. Columns of ``docs`` are kept as they are, but two: ``__lines`` and
    ``__kept`` are the result's, and a column of ``docs`` of such a name is an error.
    """
    if taken := {"__lines", "__kept"} & set(docs.columns):
        raise ValueError(f"columns that the result adds: {sorted(taken)}")
    lines = F.split(text, "\n")
    none, name = host.isNull(), F.coalesce(host, F.lit(""))
    incidence = docs.select(none.alias("__none"), name.alias("__host"), F.explode(F.array_distinct(F.transform(lines, line_key))).alias("__key")).where("__key IS NOT NULL")
    counts = incidence.groupBy("__none", "__host", "__key").agg(F.count(F.lit(1)).alias("__pages")).where(F.col("__pages") >= min_pages)
    totals = docs.groupBy(none.alias("__none"), name.alias("__host")).agg(F.count(F.lit(1)).alias("__total"))
    often = skew_join(counts, totals, ["__none", "__host"], F.col("__key.a"), "inner").where(F.col("__pages") > F.col("__total") * ratio)
    boiler = often.groupBy("__none", "__host").agg(F.collect_list("__key").alias("__boiler"))
    mine = docs.select(F.struct(*docs.columns).alias("__doc"), none.alias("__none"), name.alias("__host"), lines.alias("__split"), spread.alias("__spread"))
    joined = skew_join(mine, boiler, ["__none", "__host"], F.col("__spread"))
    halves = lambda keys: F.transform(keys, lambda k: k["a"])
    keyed = joined.withColumn("__keys", F.when(F.col("__boiler").isNotNull(), F.transform("__split", line_key)))
    found = keyed.withColumn("__half", F.array_intersect(halves(F.col("__keys")), halves(F.col("__boiler"))))  # by hashing, not pair by pair
    found = found.withColumn("__hits", F.when(F.size("__half") > 0, F.filter("__boiler", lambda k: F.array_contains("__half", k["a"]))))
    kept = F.filter("__split", lambda line, i: ~F.coalesce(F.array_contains("__hits", F.get("__keys", i)), F.lit(False)))
    return found.select("__doc.*", F.col("__split").alias("__lines"), F.when(F.col("__hits").isNull(), F.col("__split")).otherwise(kept).alias("__kept"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", url_host(F.col("url")).alias("host"), html_text(F.coalesce("html", F.lit(""))).alias("text"))
    pages = materialize(pages, "page-text")  # cleaned once, for the counts and for the result
    out = line_dedup(pages, F.col("host"), F.col("text"), F.col("page_id"))
    return out.select("page_id", "host", F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"), F.array_join("__kept", "\n").alias("kept_text"))


ORACLE_SQL = r"""
WITH t1 AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)', 1)) AS host,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
t2 AS (SELECT page_id, host, regexp_replace(regexp_replace(t, '(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|article|section|nav|footer|header|table|tr|td|title|body|html|head)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM t1),
t3 AS (SELECT page_id, host, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&') AS t FROM t2),
t4 AS (SELECT page_id, host, string_split(regexp_replace(regexp_replace(t, '[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*', chr(10), 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), chr(10)) AS lines FROM t3),
l AS (SELECT page_id, host, pos, lines[pos] AS line, regexp_replace(lines[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS pos FROM t4)),
h AS (SELECT host, count(*) AS total FROM t4 GROUP BY host),
c AS (SELECT host, key, count(DISTINCT page_id) AS n FROM l WHERE key <> '' GROUP BY host, key),
b AS (SELECT c.host, c.key FROM c JOIN h USING (host) WHERE n >= 4 AND n > total * 0.05)
SELECT page_id, l.host, count(*) AS n_lines, count(b.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.key IS NULL), '') AS kept_text
FROM l LEFT JOIN b ON l.host = b.host AND l.key = b.key GROUP BY page_id, l.host
"""
