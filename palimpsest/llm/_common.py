"""Shared plumbing: the shared work folder, written tables, joins that spread hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 16

_written: list[tuple[SparkSession, str]] = []
_path_of: dict[int, tuple[DataFrame, str]] = {}


def _drop_written() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


atexit.register(_drop_written)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def workdir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A machine-local folder serves only a local session in which it is unset, as in tests; on a
    cluster executors wouldn't see one, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="palimpsest-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    Lost executors then cost only the tasks they ran. The files go when Python exits.
    """
    spark = df.sparkSession
    path = f"{workdir(spark)}/palimpsest-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[id(out)] = (out, path)
    return out


def release(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing will read them any more."""
    for frame in frames:
        spark, path = frame.sparkSession, _path_of.pop(id(frame))[1]
        _written.remove((spark, path))
        drop(spark, path)


def partitions(spark: SparkSession) -> int:
    """The deployer's shuffle width, which is to grow with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join rows to one row per key, each hot key dealt to ``salts`` tasks.

    ``right`` holds at most one slim row per key and is repeated ``salts`` times. The salted
    key differs from any key that ``right`` was grouped by, so both sides get exchanges of
    their own and AQE may split them further, or broadcast ``right`` if it measures small.
    """
    salt = "__salt"
    spread_out = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(right.withColumn(salt, spread_out), [*keys, salt], how).drop(salt)


def stream_groups(rows: DataFrame, keys: list[str], schema: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work`` on whole groups of ``keys``, many in a call, in the order of the keys.

    Each call gets a table of complete groups, about as many rows as one Arrow batch. What a
    task holds is a batch and the group at its end, so small groups cost no call of their own.
    """
    places = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(p) for p in places]
            end = tuple(c[-1].as_py() for c in cols)
            cut = batch.num_rows  # where the batch's last group begins
            lo, hi = 0, batch.num_rows - 1
            while lo < hi:  # keys are in order, so the last group is a suffix
                mid = (lo + hi) // 2
                if tuple(c[mid].as_py() for c in cols) == end:
                    hi = mid
                else:
                    lo = mid + 1
            cut = lo
            if last is not None and (cut or end != last):
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif last is None and cut:
                yield from work(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
            last = end
        if held:
            yield from work(pa.Table.from_batches(held))

    dealt = rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)
