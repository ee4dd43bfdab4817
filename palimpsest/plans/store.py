"""Tables of a mirror's state that commands share: written once for each input, read by all that follow."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_held: dict[tuple[int, str], tuple[SparkSession, str]] = {}


def workdir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only for a local session in which it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and current.isDefined():
        named = current.get()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-")
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _stamp(spark: SparkSession, path: str) -> str:
    """What a file or folder is now: names, lengths and times of its files."""
    target, fs = _path(spark, path)
    found = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(target)) if fs.exists(target) else []
    return repr(found)


def stored(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made from the inputs as they are now; made again in this session only if they change."""
    stamp = hashlib.sha256("|".join([name, *inputs, *(_stamp(spark, i) for i in inputs)]).encode()).hexdigest()[:24]
    key = (id(spark.sparkContext), stamp)
    if key not in _held:
        path = f"{workdir(spark)}/palimpsest-state-{name}-{stamp}"
        df = make()
        df.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
        _held[key] = (spark, path)
    return spark.read.parquet(_held[key][1])


def _drop() -> None:
    while _held:
        _, (spark, path) = _held.popitem()
        try:
            target, fs = _path(spark, path)
            fs.delete(target, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


atexit.register(_drop)
