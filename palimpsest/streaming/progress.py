"""Progress of translation runs: six kinds of events folded into one state for each run, on a table or a stream.

Events: run_id, seq, type (queued, started, attempt, attemptCompleted, completed, failed), at (ms), task_id,
activity_id, total, completed, success_count, failure_count. ``queued`` begins a run anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "run_id string, total int, completed int, success_count int, failure_count int, running int, waiting int, total_attempts long, successful_attempts long, success_rate double, mean_duration_ms double"
_HELD = "total int, completed int, success_count int, failure_count int, attempts long, successes long, duration long, timed long, open map<string,long>, active map<string,string>"


def _rate(good: Column, all_: Column) -> Column:
    return F.when(all_ > 0, good * 100.0 / all_).otherwise(100.0)


def run_state(events: DataFrame) -> DataFrame:
    """The state of each run after its last event.

    Success rate is completed attempts over attempts, 100 without any; the mean duration is that of
    completed tasks, from the last start of the task in the run, 0 without any. A task runs from its
    first attempt until it completes or fails.
    """
    c = F.col
    order = W.partitionBy("run_id").orderBy("seq")
    since = events.withColumn("round", F.count_if(c("type") == "queued").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max("round").over(W.partitionBy("run_id"))
    now = since.withColumn("last", last).where("round = last")
    by_task = W.partitionBy("run_id", "task_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    ended = c("type").isin("completed", "failed")
    now = now.withColumns({"began": F.last(F.when(c("type") == "started", F.struct("seq", "at")), True).over(by_task), "closed": F.last(F.when(ended, c("seq")), True).over(by_task)})
    took = F.when((c("type") == "completed") & c("began").isNotNull() & (c("closed").isNull() | (c("closed") < c("began.seq"))), c("at") - c("began.at"))
    live = F.when(c("type").isin("attempt"), c("seq"))
    tasks = now.groupBy("run_id", "task_id").agg(F.max(live).alias("tried"), F.max(F.when(ended, c("seq"))).alias("ended"))
    opened = now.where("type = 'attempt'").join(tasks, ["run_id", "task_id"]).where(c("ended").isNull() | (c("seq") > c("ended")))
    running = opened.groupBy("run_id").agg(F.count_distinct(F.coalesce("activity_id", "task_id")).cast("int").alias("running"))
    latest = lambda name, kinds: F.coalesce(F.max_by(F.when(c("type").isin(*kinds), c(name)), F.when(c("type").isin(*kinds), c("seq"))), F.lit(0))
    told, done = ("queued", "started", "attempt", "attemptCompleted", "completed", "failed"), ("completed", "failed")
    each = now.withColumn("took", took).groupBy("run_id").agg(
        latest("total", told).alias("total"), latest("completed", told[1:]).alias("completed"), latest("success_count", done).alias("success_count"), latest("failure_count", done).alias("failure_count"),
        F.count_if(c("type") == "attempt").alias("total_attempts"), F.count_if(c("type") == "attemptCompleted").alias("successful_attempts"), F.coalesce(F.avg("took"), F.lit(0.0)).alias("mean_duration_ms"),
    )
    out = each.join(running, "run_id", "left").withColumn("running", F.coalesce("running", F.lit(0)))
    waiting = F.greatest(F.lit(0), c("total") - c("completed") - c("running"))
    return out.select("run_id", "total", "completed", "success_count", "failure_count", "running", waiting.alias("waiting"), "total_attempts", "successful_attempts", _rate(c("successful_attempts"), c("total_attempts")).alias("success_rate"), "mean_duration_ms")


def fold(held: dict, event: dict) -> dict:
    """A run's state after one more event."""
    kind, task = event["type"], event["task_id"]
    if kind == "queued" or not held:
        held = {"total": 0, "completed": 0, "success_count": 0, "failure_count": 0, "attempts": 0, "successes": 0, "duration": 0, "timed": 0, "open": {}, "active": {}}
    if event["total"] is not None:
        held["total"] = event["total"]
    if kind == "queued":
        return held
    if event["completed"] is not None:
        held["completed"] = event["completed"]
    if kind == "started":
        held["open"][task] = event["at"]
    elif kind == "attempt":
        held["attempts"] += 1
        held["active"][event["activity_id"] or task] = task
    elif kind == "attemptCompleted":
        held["successes"] += 1
    elif kind in ("completed", "failed"):
        began = held["open"].pop(task, None)
        if began is not None and kind == "completed":
            held["duration"] += event["at"] - began
            held["timed"] += 1
        held["success_count"], held["failure_count"] = event["success_count"], event["failure_count"]
        held["active"] = {a: t for a, t in held["active"].items() if t != task}
    return held


def shown(run: str, s: dict) -> tuple:
    running = len(s["active"])
    rate = s["successes"] * 100.0 / s["attempts"] if s["attempts"] else 100.0
    return (run, s["total"], s["completed"], s["success_count"], s["failure_count"], running, max(0, s["total"] - s["completed"] - running), s["attempts"], s["successes"], rate, s["duration"] / s["timed"] if s["timed"] else 0.0)


def run_stream(events: DataFrame) -> DataFrame:
    """The same for a stream of events, told whenever a run has news (``update`` mode).

    A run's state is what is open in it, one small row; events of a batch are folded in the order of
    seq, and an event older than the last one seen is left out.
    """
    names = [f.split()[0] for f in STATE.split(", ")]
    held_names = ["total", "completed", "success_count", "failure_count", "attempts", "successes", "duration", "timed", "open", "active"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, held = -1, {}
        if state.exists:
            seen, *values = state.get
            held = dict(zip(held_names, values, strict=True))
            held["open"], held["active"] = dict(held["open"] or {}), dict(held["active"] or {})
        rows = sorted((r for batch in batches for r in batch.to_dict("records")), key=lambda r: r["seq"])
        for r in rows:
            if r["seq"] > seen:
                seen = int(r["seq"])
                held = fold(held, {k: None if pd.isna(v) else int(v) if isinstance(v, float) else v for k, v in r.items()})
        state.update((seen, *[held[n] for n in held_names]))
        yield pd.DataFrame([shown(key[0], held)], columns=names)

    return events.groupBy("run_id").applyInPandasWithState(update, STATE, f"seen long, {_HELD}", "update", GroupStateTimeout.NoTimeout)
