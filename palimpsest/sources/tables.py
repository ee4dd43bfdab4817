"""The tables of a mirror, with their schemas: read failing on what doesn't fit, or apart from it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.jsonl import read_json, read_jsonl

_REF = "struct<segment_id:string,source_hash:string>"
SCHEMAS = {
    "pages": "url string NOT NULL, canonical_url string, status int, content_type string, snapshot_path string, output_path string, page_hash string, discovered_from string, asset_refs array<string>, extracted_at string",
    "assets": "url string NOT NULL, cache_path string, output_path string, content_type string, content_hash string",
    "segments": "segment_id string NOT NULL, reuse_key string, page_url string, dom_path string, kind string, attribute_name string, source_text string, normalized_text string, source_hash string, tag_name string, title string, ord int",
    "assembly": "page_url string NOT NULL, bindings array<struct<segment_id:string,dom_path:string,kind:string,attribute_name:string>>",
    "translations": "segment_id string NOT NULL, reuse_key string, target_locale string, translated_text string, source_hash string, status string, provider string, updated_at string, inline_plan struct<group_id:string,segment_ids:array<string>,parts:array<struct<kind:string,text:string,dom_path:string>>>",
    "tasks": "task_id string NOT NULL, source_url string, target_locale string, created_at string, page_url string, title string, content array<struct<id:string,text:string,note:string>>, glossary array<struct<source:string,target:string>>",
    "mappings": f"task_id string NOT NULL, source_url string, target_locale string, page_url string, items array<struct<id:string,kind:string,segments:array<{_REF}>,codes:array<struct<text:string,dom_path:string>>,slots:array<int>>>",
    "results": "task_id string NOT NULL, provider string, model string, completed_at string, translations array<struct<id:string,translated_text:string>>",
    "manifest": "task_id string NOT NULL, page_url string, title string, content_count int, status string, completed_at string, provider string, model string, last_verified_at string, last_verify_status string, last_verify_error_count int, last_run_at string, last_run_status string, last_run_error string",
    "glossary": "source string NOT NULL, target string",
    "reports": "task_id string NOT NULL, checked_at string, ok boolean, result_hash string, error_count int, warning_count int, errors array<struct<code:string,message:string,json_path:string>>, warnings array<struct<code:string,message:string,json_path:string>>",
    "run_failures": "task_id string NOT NULL, failed_at string, attempt_count int, message string, errors array<struct<code:string,message:string,json_path:string>>",
    "config": "source_url string NOT NULL, target_locale string, entry_urls array<string>, include_patterns array<string>, exclude_patterns array<string>, request_headers map<string,string>",
}
#: The statuses and kinds that rows may have.
ALLOWED = {"translations.status": ("draft", "accepted", "stale"), "segments.kind": ("text", "attr", "meta"), "manifest.status": ("pending", "done", "applied", "invalid")}


def scan(spark: SparkSession, path: str, name: str, single: bool = False) -> DataFrame:
    """A table of the mirror; a row that doesn't fit its schema fails the read, a missing document has no rows.

    Keys that the schema doesn't know are left out. A null key, or a value that isn't allowed, is an
    error when the row is read.
    """
    rows = read_json(spark, path, SCHEMAS[name]) if single else read_jsonl(spark, path, SCHEMAS[name])
    for rule, values in ALLOWED.items():
        table, column = rule.split(".")
        if table == name:
            rows = rows.withColumn(column, F.when(F.col(column).isNull() | F.col(column).isin(*values), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"{rule} can't be "), column)).cast("string")))
    key = SCHEMAS[name].split()[0]
    return rows.withColumn(key, F.coalesce(key, F.raise_error(F.lit(f"{name} without {key}")).cast("string")))


def files(spark: SparkSession, folder: str, pattern: str = "*.json") -> list[str]:
    """Paths of a folder's files in order; none if there is no such folder. The listing is the deployer's folder, not the data."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return sorted(str(f.getPath()) for f in found) if found is not None else []


def documents(spark: SparkSession, folder: str, name: str, pattern: str = "*.json") -> DataFrame:
    """One row for each JSON file of a folder, in a column ``r`` of the table's schema, with file and readable.

    A file that isn't JSON, or has no key, isn't readable; its name still tells its task.
    """
    paths = f"{folder.rstrip('/')}/{pattern}"
    schema = SCHEMAS[name].replace(" NOT NULL", "")
    try:
        raw = spark.read.text(paths, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string")
    rows = raw.select(F.input_file_name().alias("file") if raw.inputFiles() else F.lit("").alias("file"), F.from_json("value", schema).alias("r"))
    key = schema.split()[0]
    named = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"(\.task)?\.json$", "")
    return rows.select("file", named.alias("named_id"), F.coalesce(F.col(f"r.{key}").isNotNull(), F.lit(False)).alias("readable"), "r")


def preferred(pending: DataFrame, applied: DataFrame) -> DataFrame:
    """The pending copy of each task, else the applied one; rows of (task_id, ...)."""
    both = pending.withColumn("__rank", F.lit(0)).unionByName(applied.withColumn("__rank", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("task_id", "__rank")]
    return both.groupBy("task_id").agg(F.min_by(F.struct(*columns), "__rank").alias("r")).select("task_id", "r.*")


def exploded_items(rows: DataFrame, column: str) -> DataFrame:
    """(task_id, pos, fields of the items), positions from 0."""
    return rows.select("task_id", F.posexplode(column).alias("pos", "i")).select("task_id", "pos", "i.*")


#: A line of a dotenv file: space, an export, the key, the value.
_ENV = r"^(\s*)((?:export\s+)?)([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"


def env_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """(key, value) of dotenv lines; quotes are taken off, unquoted values end at a comment. ``lines`` may have a pos to tell which comes last."""
    line = F.col(value)
    raw = F.regexp_extract(line, _ENV, 4)
    double = F.regexp_extract(raw, r'^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(F.replace(double, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.regexp_extract(raw, r"^'([^']*)'", 1)
    bare = F.rtrim(F.regexp_replace(raw, r"(^|\s)#.*$", ""))
    parsed = F.when(raw.rlike(r'^"(?:[^"\\]|\\.)*"'), plain).when(raw.rlike(r"^'[^']*'"), single).otherwise(bare)
    return lines.where(line.rlike(_ENV) & ~line.rlike(r"^\s*#")).select(F.regexp_extract(line, _ENV, 3).alias("key"), parsed.alias("value"))


def env_value(pairs: dict[str, str], process: dict[str, str], key: str) -> str:
    """The file's value of a key, else the process's; an error if neither has one."""
    found = (pairs.get(key) or "").strip() or (process.get(key) or "").strip()
    if not found:
        raise KeyError(f"{key} isn't set")
    return found


