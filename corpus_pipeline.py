"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Null texts, empty tables and repeated rows are handled as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import jaccard_join, line_dedup, mixing, sentencepieces, toxicity
from palimpsest.llm._common import materialize

#: Words of a shingle and least similarity, in percent, of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Share of a source's documents above which a line is boilerplate, and the least number of documents.
LINE_RATIO, LINE_DOCS = 0.05, 4
#: Bytes of rows that go to a Python worker at once. Spark's own limits are 64 MB and 10,000 rows: 35 MB of these
#: texts, held by each task in the JVM, whose buffers double while they fill, in the worker, and there again as strings.
BATCH_BYTES, BATCH_LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage with batches of at most about BATCH_BYTES, or fewer if the session says so.

    The limit stays in the session: what a stage returns is run later, by whoever writes it.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
            spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic; it learns from the texts that come in."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject_toxic(docs, toxicity.train(docs, labels))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate of their source; every document stays."""
    out = line_dedup.line_dedup(docs, F.col("source"), F.col("text"), F.col("doc_id"), LINE_RATIO, LINE_DOCS)
    changed = F.size("__kept") < F.size("__lines")
    text = F.when(changed, F.array_join("__kept", "\n")).otherwise(F.col("text"))
    return out.withColumn("__text", text).select(*[F.col("__text").alias(c) if c == "text" else F.when(changed, F.length("__text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@bounded
def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the smallest id; ids are unique."""
    parts = jaccard_join.jaccard_components(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)
    keep = parts.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; copies are rows of their own."""
    return mixing.mixed(docs)


@bounded
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row that the mix took."""
    return sentencepieces.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepieces", encode_pieces),
]

#: A learnt classifier and a tokenizer aren't SQL; ``tests/llm/test_pipeline.py`` holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
