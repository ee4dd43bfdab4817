"""Runs of translation: chunks asked for, checked, asked again with what was wrong, and put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import chunks, verify
from palimpsest.sources import completion


def exploded(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, mapping) of tasks with content and items, positions from 0."""
    items = tasks.select("task_id", F.posexplode("content").alias("pos", "c")).select("task_id", "pos", "c.*")
    mapping = tasks.select("task_id", F.posexplode("items").alias("pos", "i")).select("task_id", "pos", "i.*")
    return items, mapping


def _keyed(df: DataFrame) -> DataFrame:
    """Each chunk as a task of its own."""
    return df.withColumn("task_id", F.concat_ws("#", "task_id", F.col("chunk_index").cast("string")))


def _checked(view: DataFrame, mapping: DataFrame, answers: DataFrame, glossary: verify.Glossary) -> DataFrame:
    """Errors of the answers to chunks, by (task_id, chunk_index); ids and positions are those within the chunk."""
    mine = _keyed(view).select("task_id", F.col("k").alias("pos"), "id", "text")
    mapped = _keyed(mapping.join(view.select("task_id", "id", "chunk_index", "k"), ["task_id", "id"])).select("task_id", F.col("k").alias("pos"), "id", "kind", "segments", "codes", "slots")
    told = _keyed(answers).select("task_id", F.col("k").alias("pos"), "id", F.coalesce("translated_text", F.lit("")).alias("translated_text"))
    heads = answers.select("task_id", "chunk_index", "named_id").distinct()
    results = _keyed(heads.withColumn("same", F.col("named_id").eqNullSafe(F.col("task_id")))).select("task_id", F.when(F.col("same"), F.col("task_id")).otherwise(F.coalesce("named_id", F.lit(""))).alias("named_id"))
    asked = mine.join(results.select("task_id"), "task_id", "left_semi")
    found = verify.shape_issues(asked, mapped, results, told).unionByName(verify.content_issues(mine, mapped, told, glossary)).dropDuplicates(verify.ISSUE)
    place = F.split("task_id", "#")
    return found.select(place[0].alias("task_id"), place[1].cast("int").alias("chunk_index"), "code", "message", "json_path")


def translate(tasks: DataFrame, segments: DataFrame, endpoint: completion.Endpoint, transport: completion.Transport, locale: str, now: str, limits: chunks.Limits = chunks.Limits(), attempts: int = 3, glossary: verify.Glossary = (), stopped: Callable[[], bool] = lambda: False) -> dict[str, DataFrame]:
    """``results`` of tasks all of whose chunks passed, ``failures`` of the others, and the log of ``attempts``.

    A chunk is asked for until its answer passes, with the last answer and its errors from the second try
    on. What an endpoint answered is checkpointed before it is looked at, so no request is made again when
    executors are lost. A chunk that never passes fails its page. A result that was put together is checked
    whole. ``stopped`` is asked between rounds; what hasn't passed by then fails as cancelled.
    """
    items, mapping = exploded(tasks)
    slim = chunks.described(items, mapping, segments)
    plan = chunks.chunk_plan(slim, "task_id", "pos", "chars", "heading", limits).checkpoint()
    view = chunks.views(plan, items).checkpoint()
    content = view.groupBy("task_id", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "text", "note"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["note"].alias("note"))).alias("content"))
    asked = plan.join(content, ["task_id", "chunk_index"]).withColumn("target_locale", F.lit(locale))
    open_, retries, good, logs, last = asked, None, [], [], None
    for attempt in range(1, attempts + 1):
        if stopped() or open_.isEmpty():
            break
        drafts = completion.drafts(completion.prompts(open_, retries), endpoint, transport).checkpoint()
        answers = completion.draft_items(drafts).checkpoint()
        errors = _checked(view, mapping, answers, glossary)
        unparsed = drafts.join(answers.select("task_id", "chunk_index").distinct(), ["task_id", "chunk_index"], "left_anti")
        lost = unparsed.select("task_id", "chunk_index", F.when(F.col("error").isNotNull(), "request_failed").otherwise("json_invalid").alias("code"), F.coalesce("error", F.lit("The answer isn't the JSON asked for")).alias("message"), F.lit("$").alias("json_path"))
        errors = errors.unionByName(lost).checkpoint()
        bad = errors.select("task_id", "chunk_index").distinct()
        good.append(answers.join(bad, ["task_id", "chunk_index"], "left_anti"))
        logs.append(drafts.select("task_id", "chunk_index").join(bad.withColumn("bad", F.lit(True)), ["task_id", "chunk_index"], "left").select("task_id", F.col("chunk_index").alias("chunk"), F.lit(attempt).alias("attempt"), F.col("bad").isNull().alias("ok")))
        told = errors.groupBy("task_id", "chunk_index").agg(F.array_sort(F.collect_set(F.format_string("[%s] %s: %s", "code", "json_path", "message"))).alias("issues"))
        retries = told.join(drafts.select("task_id", "chunk_index", F.coalesce("json", "raw").alias("previous")), ["task_id", "chunk_index"])
        open_, last = open_.join(bad, ["task_id", "chunk_index"], "left_semi").checkpoint(), errors
    nothing = view.select("task_id", "chunk_index", F.lit(None).cast("string").alias("named_id"), "k", "id", F.lit(None).cast("string").alias("translated_text")).limit(0)
    passed = nothing
    for part in good:
        passed = passed.unionByName(part)
    merged, _ = chunks.merge_drafts(passed, view)
    heads = tasks.select("task_id", F.col("task_id").alias("named_id")).join(merged.select("task_id").distinct(), "task_id", "left_semi")
    whole = verify.errors(items.join(heads.select("task_id"), "task_id", "left_semi"), mapping, heads, merged, segments, glossary)
    done = merged.join(whole.select("task_id").distinct(), "task_id", "left_anti")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "translated_text"))), lambda x: F.struct(x["id"].alias("id"), x["translated_text"].alias("translated_text")))
    results = done.groupBy("task_id").agg(listed.alias("translations")).select("task_id", F.col("task_id").alias("named_id"), F.concat("task_id", F.lit(".json")).alias("file"), F.lit(endpoint.provider).alias("provider"), F.lit(endpoint.model).alias("model"), F.lit(now).alias("completed_at"), "translations")
    log = logs[0] if logs else plan.select("task_id", F.col("chunk_index").alias("chunk"), F.lit(0).alias("attempt"), F.lit(False).alias("ok")).limit(0)
    for part in logs[1:]:
        log = log.unionByName(part)
    tries = log.groupBy("task_id").agg(F.max("attempt").alias("attempt_count"))
    reasons = whole.select("task_id", "code", "message", "json_path")
    if last is not None:
        reasons = last.select("task_id", "code", "message", "json_path").unionByName(reasons)
    why = reasons.groupBy("task_id").agg(F.array_sort(F.collect_set(F.struct("json_path", "code", "message"))).alias("errors"))
    failures = tasks.select("task_id").join(results.select("task_id"), "task_id", "left_anti").join(why, "task_id", "left").join(tries, "task_id", "left")
    said = F.coalesce(F.get("errors", F.lit(0))["message"], F.lit("cancelled"))
    return {"results": results.checkpoint(), "failures": failures.select("task_id", F.lit(now).alias("failed_at"), F.coalesce("attempt_count", F.lit(0)).alias("attempt_count"), said.alias("message"), "errors").checkpoint(), "attempts": log}
