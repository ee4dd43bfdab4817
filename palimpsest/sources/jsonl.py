"""JSON and JSON-lines tables with a fixed schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of JSON lines; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document; no rows if the path doesn't exist."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, broken): lines that fit the schema, and the text of those that don't."""
    every = spark.read.schema(f"{schema}, __broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__broken").json(path)
    lines = spark.read.text(path)
    good = every.where("__broken IS NULL").drop("__broken")
    parsed = lines.selectExpr("value", f"from_json(value, '{schema}, __broken string', map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '__broken')) AS r")
    return good, parsed.where("r.__broken IS NOT NULL").select("value")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Overwrite a folder of JSON lines; null fields are left out."""
    df.write.mode("overwrite").json(path)
