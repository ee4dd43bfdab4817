"""Files that people and browsers read, written from rows of (path, content)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    """A path and its file system; the local one without checksums, as people edit these files too."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    return target, spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRaw() if fs.getUri().getScheme() == "file" else fs


def empty(spark: SparkSession, folder: str) -> None:
    """Delete what a folder of the shared file system holds."""
    target, fs = _path(spark, folder)
    fs.delete(target, True)
    fs.mkdirs(target)


def write_files(rows: DataFrame, folder: str, path: str = "output_path", content: str = "content") -> DataFrame:
    """(path, bytes) of files written under a folder that all executors reach; nothing is written until it is read.

    The folder is a local path of a shared mount or a URI that Arrow knows. A file is written whole, so a
    task that runs again writes the same file again. Paths may not leave the folder; rows are one for each path.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where = folder if "://" in folder else folder.removeprefix("file:")
        store, root = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
        for batch in batches:
            names, sizes = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [p for p in name.split("/") if p not in ("", ".")]
                if ".." in parts or not parts:
                    raise ValueError(f"path leaves the folder: {name!r}")
                data = body.encode("utf-8", "surrogatepass") if isinstance(body, str) else bytes(body or b"")
                at = "/".join([root.rstrip("/"), *parts])
                store.create_dir(at.rpartition("/")[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(data)
                names.append("/".join(parts))
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"path": pa.array(names, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    return rows.select(F.col(path), F.col(content)).mapInArrow(put, "path string, bytes long")


def write_site(pages: DataFrame, folder: str, assets: DataFrame | None = None, script: tuple[str, str] | None = None) -> DataFrame:
    """One row of counts: a site emptied and written from pages (output_path, html, replayed) and assets (output_path, body).

    ``script`` is the path and source of what replayed pages load; it is written once, if a page needs it.
    """
    spark = pages.sparkSession
    empty(spark, folder)
    done = write_files(pages, folder, "output_path", "html").agg(F.count(F.lit(1)).alias("pages")).first()["pages"]
    copied = write_files(assets, folder, "output_path", "body").agg(F.count(F.lit(1)).alias("assets")).first()["assets"] if assets is not None else 0
    if script is not None and not pages.where("replayed").isEmpty():
        copied += write_files(spark.createDataFrame([script], "output_path string, content string"), folder).count()
    return spark.createDataFrame([(done, copied)], "pages long, assets long")


def json_text(value: object) -> str:
    """A JSON document as it is written: two spaces, a newline at the end."""
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole."""
    target, fs = _path(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file; None if it isn't there."""
    target, fs = _path(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json_text(value))


def merged(existing: object, defaults: object) -> object:
    """Defaults with what exists over them, key by key; what exists wins wherever it isn't an object too."""
    if isinstance(existing, dict) and isinstance(defaults, dict):
        return {**existing, **{k: merged(existing[k], v) if k in existing else v for k, v in defaults.items()}}
    return existing


def scaffold(spark: SparkSession, path: str, defaults: object, merge: bool = False) -> bool:
    """Create a JSON document if it is missing, or add the keys that it lacks; whether anything was written."""
    text = read_text(spark, path)
    new = defaults if text is None else merged(json.loads(text), defaults) if merge else None
    if new is None or (text is not None and new == json.loads(text)):
        return False
    write_json(spark, path, new)
    return True


def upsert_env(body: str | None, key: str, value: str) -> str:
    """A dotenv text with a key set: in place of its first line, later ones dropped, comments and the rest as they are."""
    import re

    plain = value if re.fullmatch(r"[A-Za-z0-9_./:@%+=,-]*", value) else json.dumps(value, ensure_ascii=False)
    out, set_ = [], False
    for line in (body or "").splitlines():
        m = re.match(r"^(\s*)((?:export\s+)?)([A-Za-z_][A-Za-z0-9_]*)\s*=", line)
        if m is None or m[3] != key:
            out.append(line)
        elif not set_:
            out.append(f"{m[1]}{m[2]}{key}={plain}")
            set_ = True
    if not set_:
        out.append(f"{key}={plain}")
    return "\n".join(out) + "\n"


def upsert_line(body: str | None, line: str) -> str:
    """A text that has a line: as it is, or with the line at its end."""
    lines = (body or "").splitlines()
    return "\n".join([*lines, *([] if line in [x.strip() for x in lines] else [line])]) + "\n"


def archive(spark: SparkSession, source: str, latest: str, history: str) -> bool:
    """Move a file or folder over its latest copy and keep another under the stamp; whether there was one."""
    target, fs = _path(spark, source)
    if not fs.exists(target):
        return False
    util = spark._jvm.org.apache.hadoop.fs.FileUtil
    for to in (history, latest):
        at, other = _path(spark, to)
        other.mkdirs(at.getParent())
        other.delete(at, True)
        util.copy(fs, target, other, at, to == latest, spark._jsc.hadoopConfiguration())
    return True


def remove(spark: SparkSession, *paths: str) -> int:
    """Delete files or folders; how many were there."""
    return sum(bool(fs.delete(target, True)) for target, fs in (_path(spark, p) for p in paths))
