"""Incremental work as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from palimpsest.operators import site, state


def progress(events: DataFrame, key: str = "user_id", kind: str = "event_type", at: str = "ts") -> DataFrame:
    """(key, attempts, failures, last_at, last_kind): the fold of progress events, on a table or a stream.

    The last kind is that of the latest event, the greatest kind of those at once. All of it is
    associative, so a stream holds one row of state for each key, in ``update`` or ``complete`` mode.
    """
    last = F.max(F.struct(at, kind)).alias("last")
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col(kind) == "error").alias("failures"), last).select(key, "attempts", "failures", F.col(f"last.{at}").alias("last_at"), F.col(f"last.{kind}").alias("last_kind"))


def pending_stream(pages: DataFrame, translations_path: str, out_path: str, checkpoint: str, rules: site.Extraction = site.Extraction()) -> StreamingQuery:
    """What is to be translated of each batch of new pages, appended to ``out_path`` by batch.

    A batch that is run again after a failure overwrites its own folder, so nothing comes twice.
    The translations are read anew for each batch. Folders are to be shared ones.
    """

    def one(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(translations_path)
        todo = state.pending(site.segments(batch, rules), known)
        todo.write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
