"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm._common import WORD, materialize, skew_join

#: Bins of the rank scale: a source's running sums are taken over at most so many rows.
BINS = 1 << 14
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def random_unit(key: Column, seed: str) -> Column:
    """A reproducible number within (0, 1), from 52 bits of a digest of the key."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _level(rows: DataFrame, groups: list[str], weight: str, cap: str, total: str, ties: list[str]) -> DataFrame:
    """``rows`` with the level at which least(cap, weight * level) sums to total in each group.

    Water filling in closed form. Rows are sorted by how soon they fill. If all before one are
    capped, the level is what is left over by the open weight; it rises until the first row that
    stays under its cap and falls after it, so the highest is the right one. Rows without weight don't count.
    """
    within = [F.col(g) for g in groups] or [F.lit(1)]
    fill = W.partitionBy(*within).orderBy(F.col(cap) / F.col(weight), *ties)
    before = F.coalesce(F.sum(cap).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum(weight).over(fill.rowsBetween(0, W.unboundedFollowing))
    staged = rows.withColumns({"__before": before, "__open": open_})
    level = F.max((F.col(total) - F.col("__before")) / F.col("__open")).over(W.partitionBy(*within))
    return staged.withColumn("level", level).drop("__before", "__open")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(no_source, source, source_size) with weight and target. One row per source goes through an unpartitioned window; that is a summary, not the data."""
    order = W.orderBy("no_source", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    s = s.withColumn("total", F.sum("source_size").over(W.partitionBy(F.lit(1))) * share)
    s = _level(s, [], "weight", "cap", "total", ["no_source", "source"])
    return s.withColumn("target", F.least("cap", F.col("weight") * F.col("level"))).select("no_source", "source", "source_size", "weight", "target")


def size_class(size: Column) -> Column:
    """Documents of twice the words are one class further: 0 without words, 1 for one, 2 up to three, 3 up to seven."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(rows, rule): a row (__id, no_source, source, size, class) for each document, and the rule per source and class.

    Longer documents are likelier: a document of class c is expected 1 + c times as often as one
    without words, at most ``most`` times, at the level at which the expected sizes sum to the source's
    target. The whole part of that is certain copies. For the rest, documents are ranked by random odds
    over inclusion odds (Pareto), and taken in that order while the running size stays within half a
    document of what is missing. The running size is summed over BINS bins of the rank scale; only
    the bin in which the target falls is ordered row by row, so no task sees a whole source.

    Null and empty texts have size 0 and are ranked like others. A null source is one source,
    ordered last. Rows that repeat an id share its random number and are taken together. The texts are
    read once: what is needed of them is written.
    """
    no_source, size = F.col(source_col).isNull(), word_count(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("__id"), no_source.alias("no_source"), F.coalesce(source_col, F.lit("")).alias("source"), size.alias("size"))
    rows = materialize(rows, "sizes").withColumn("class", size_class(F.col("size")))
    keys = ["no_source", "source"]
    classes = rows.groupBy(*keys, "class").agg(F.sum("size").alias("class_size"))
    sizes = classes.groupBy(*keys).agg(F.sum("class_size").alias("source_size"))
    rule = classes.join(targets(sizes, weights, share, most).drop("weight"), keys)  # a row for each source and class
    rule = rule.withColumns({"pull": F.col("class") + F.lit(1.0), "weight": (F.col("class") + F.lit(1.0)) * F.col("class_size"), "cap": F.col("class_size") * float(most)})
    level = _level(rule.where("class_size > 0"), keys, "weight", "cap", "target", ["class"]).groupBy(*keys).agg(F.max("level").alias("level"))
    rule = rule.join(level, keys, "left").withColumn("times", F.least(F.lit(float(most)), F.col("pull") * F.coalesce("level", F.lit(0.0))))
    rule = rule.withColumns({"whole": F.floor("times").cast("long"), "odds": F.col("times") - F.floor("times")})
    rest = rule.groupBy(*keys).agg((F.max("target") - F.sum(F.col("whole") * F.col("class_size"))).alias("rest"))
    rule = materialize(rule.join(rest, keys).select(*keys, "class", "source_size", "target", "whole", "odds", "rest"), "mix-rule")

    ranked = _beside(rows, rule).where("odds > 0").withColumn("rank", pareto_rank(F.col("__id"), F.col("odds"), seed))
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") * BINS).cast("int"))
    bins = ranked.groupBy(*keys, "bin").agg(F.sum("size").alias("in_bin"), F.first("rest").alias("rest"))
    running = F.sum("in_bin").over(W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    edge = bins.withColumn("upto", running).withColumn("below", F.col("upto") - F.col("in_bin")).where("below <= rest AND rest < upto").select(*keys, F.col("bin").alias("edge_bin"), "below")
    edge = edge.groupBy(*keys).agg(F.max("edge_bin").alias("edge_bin"), F.max("below").alias("below"))

    at_edge = skew_join(ranked, edge, keys, F.col("__id"), "inner").where("bin = edge_bin")
    within = F.col("below") + F.sum("size").over(W.partitionBy(*keys).orderBy("rank").rangeBetween(W.unboundedPreceding, 0))
    cut = at_edge.withColumn("upto", within).where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy(*keys).agg(F.max("rank").alias("cut"))
    ends = edge.join(cut, keys, "left")
    floor_cut = F.when(F.col("edge_bin").isNull(), F.lit(1.0)).otherwise(F.coalesce("cut", (F.col("edge_bin") - F.lit(1e-9)) / BINS))
    return rows, rule.join(ends, keys, "left").withColumn("cut", floor_cut).select(*keys, "class", "source_size", "target", "whole", "odds", "cut")


def _beside(rows: DataFrame, rule: DataFrame) -> DataFrame:
    return skew_join(rows, rule, ["no_source", "source", "class"], F.col("__id"))


def pareto_rank(key: Column, odds: Column, seed: str) -> Column:
    """Random odds over inclusion odds, mapped to (0, 1) without changing the order."""
    u = random_unit(key, seed)
    q = (u / (1 - u)) / (odds / (1 - odds))
    return F.when(odds > 0, q / (1 + q))


def copies(rows: DataFrame, rule: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` of :func:`mix` plus the rule's columns and ``copies``."""
    extra = F.coalesce((pareto_rank(F.col("__id"), F.col("odds"), seed) <= F.col("cut")).cast("long"), F.lit(0))
    return _beside(rows, rule).withColumn("copies", F.col("whole") + extra)


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, expected, copies, taken) for each row of ``docs``; see :func:`mix`."""
    rows, rule = mix(docs, id_col, text_col, source_col, **options)
    out = copies(rows, rule, options.get("seed", "mix"))
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("whole") + F.col("odds")).alias("expected"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it, all columns as they are; see :func:`mix`."""
    _, rule = mix(docs, id_col, text_col, source_col, **options)
    whole = F.struct(*docs.columns)
    rows = docs.select(whole.alias("__doc"), F.col(id_col).alias("__id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(source_col, F.lit("")).alias("source"), size_class(word_count(F.col(text_col))).alias("class"))
    taken = copies(rows, rule, options.get("seed", "mix")).where("copies > 0")
    return taken.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH r AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
c AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS class FROM r),
s AS (SELECT no_source, source, sum(size)::BIGINT AS source_size FROM r GROUP BY ALL),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY no_source, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS before,
  sum(weight) OVER (ORDER BY cap / weight, no_source, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
l AS (SELECT *, max((total - before) / open_weight) OVER () AS level FROM f),
t AS (SELECT no_source, source, source_size, least(cap, weight * level) AS target FROM l),
k AS (SELECT no_source, source, class, sum(size)::BIGINT AS class_size, (class + 1)::DOUBLE AS pull, (class + 1)::DOUBLE * sum(size)::DOUBLE AS weight, sum(size) * 2.0::DOUBLE AS cap FROM c GROUP BY no_source, source, class),
kf AS (SELECT k.*, t.target, coalesce(sum(cap) OVER (PARTITION BY k.no_source, k.source ORDER BY cap / weight, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS before,
  sum(weight) OVER (PARTITION BY k.no_source, k.source ORDER BY cap / weight, class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM k JOIN t ON k.no_source = t.no_source AND k.source = t.source WHERE class_size > 0),
kl AS (SELECT no_source, source, max((target - before) / open_weight) AS level FROM kf GROUP BY no_source, source),
e AS (SELECT k.no_source, k.source, class, class_size, t.source_size, t.target, least(2.0::DOUBLE, pull * coalesce(level, 0.0::DOUBLE)) AS times
  FROM k JOIN t ON k.no_source = t.no_source AND k.source = t.source LEFT JOIN kl ON k.no_source = kl.no_source AND k.source = kl.source),
m AS (SELECT *, times - floor(times) AS odds, target - sum(floor(times) * class_size) OVER (PARTITION BY no_source, source) AS rest FROM e),
q AS (SELECT c.*, m.source_size, m.target, m.times, m.odds, m.rest, CASE WHEN odds > 0 THEN (u / (1 - u)) / (odds / (1 - odds)) END AS q FROM c JOIN m ON c.no_source = m.no_source AND c.source = m.source AND c.class = m.class),
o AS (SELECT *, sum(size) FILTER (WHERE odds > 0) OVER (PARTITION BY no_source, source ORDER BY q / (1 + q) NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
x AS (SELECT *, (floor(times) + CASE WHEN odds > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM o)
SELECT doc_id, size, source_size, target, floor(times) + odds AS expected, copies, size * copies AS taken FROM x
"""
