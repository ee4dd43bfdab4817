"""Translation tasks: planned from pending work, kept or dropped as pages change, listed with their state.

A task is a page's work: ``content`` (id, text, note) and, beside it, ``items`` that say which segments
and codes each id stands for. Both are arrays of one page's size. Paths order files as text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: the order of states in a manifest.
STATES = ("pending", "done", "applied", "invalid")


def planned(units: DataFrame, pending: DataFrame) -> DataFrame:
    """(page_url, title, content, items, n_items, source_chars) of each page with pending work.

    ``units`` are those of :func:`palimpsest.operators.site.units`, of all segments; a unit is kept if any of
    its segments is pending, so that a run of text and code is always sent whole. Ids are 1..n over
    the units kept. The note of an attribute or a meta says where it stands.
    """
    ids = pending.select(F.col("segment_id").alias("member")).distinct()
    members = units.select("page_url", "ord", F.explode(F.transform("segments", lambda s: s["segment_id"])).alias("member"))
    wanted = members.join(ids, "member", "left_semi").select("page_url", "ord").distinct()
    kept = units.join(wanted, ["page_url", "ord"], "left_semi")
    number = F.row_number().over(W.partitionBy("page_url").orderBy("ord"))
    note = F.when(F.col("kind") == "attr", F.concat(F.lit("<"), "tag_name", F.lit("> @"), "attribute_name")).when(F.col("kind") == "meta", F.concat(F.lit("<"), "tag_name", F.lit("> content")))
    kind = F.when(F.size("codes") > 0, "inline-code").otherwise("segment")
    rows = kept.select("page_url", "title", "ord", number.cast("string").alias("id"), "text", note.alias("note"), kind.alias("kind"), "segments", "codes", "slots")
    listed = F.array_sort(F.collect_list(F.struct("ord", "id", "text", "note", "kind", "segments", "codes", "slots")))
    pages = rows.groupBy("page_url").agg(F.max("title").alias("title"), listed.alias("all"))
    content = F.transform("all", lambda u: F.struct(u["id"].alias("id"), u["text"].alias("text"), u["note"].alias("note")))
    items = F.transform("all", lambda u: F.struct(u["id"].alias("id"), u["kind"].alias("kind"), u["segments"].alias("segments"), u["codes"].alias("codes"), u["slots"].alias("slots")))
    size = F.aggregate("all", F.lit(0).cast("long"), lambda n, u: n + F.length(u["text"]))
    return pages.select("page_url", "title", content.alias("content"), items.alias("items"), F.size("all").alias("n_items"), size.alias("source_chars"))


def task_id(page_url: str) -> Column:
    return F.concat(F.lit("task_"), F.substring(F.sha2(page_url, 256), 1, 10))


def bundle_digest() -> Column:
    """What must be equal for a task to go on standing for a page: title, content and items."""
    return F.sha2(F.to_json(F.struct("page_url", "title", "content", "items")), 256)


def reconcile(tasks: DataFrame, plan: DataFrame, source_url: str, locale: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retained, invalidated, created) from the tasks that lie pending and the pages that are planned now.

    A task stays if its source, locale, page, content and items are those planned, and no file before
    it stays for the page. ``tasks`` has file, task_id, source_url, target_locale, readable and the
    columns of a plan; a file that can't be read is invalidated under the name that it has.
    """
    new = plan.select("page_url", bundle_digest().alias("now"))
    beside = tasks.withColumn("was", bundle_digest()).join(new, "page_url", "left")
    fits = F.coalesce("readable", F.lit(True)) & F.col("source_url").eqNullSafe(F.lit(source_url)) & F.col("target_locale").eqNullSafe(F.lit(locale)) & F.coalesce(F.col("was") == F.col("now"), F.lit(False))
    nth = F.row_number().over(W.partitionBy("page_url", "fits").orderBy("file"))
    told = beside.withColumn("fits", fits).withColumn("stays", F.col("fits") & (nth == 1)).select("file", "task_id", "page_url", "stays")
    retained = told.where("stays").drop("stays")
    created = plan.join(retained.select("page_url"), "page_url", "left_anti").withColumn("task_id", task_id("page_url"))
    return retained, told.where(~F.col("stays")).drop("stays"), created


def manifest(pending: DataFrame, results: DataFrame, applied: DataFrame, verified: DataFrame, failed: DataFrame, invalidated: DataFrame) -> DataFrame:
    """One entry for each task, with its state and what is known of its last result, check and run.

    ``pending`` (task_id, page_url, title, content_count, readable), ``applied`` the same plus
    result_readable (null: no result); ``results`` (task_id, readable, completed_at, provider, model) of
    pending tasks; ``verified`` (task_id, checked_at, ok, error_count); ``failed`` (task_id, failed_at,
    message); ``invalidated`` (task_id). A pending file outranks an applied one, and either an id that
    was only invalidated. What can't be read is invalid.
    """
    page = ["page_url", "title", "content_count"]
    r = results.select("task_id", F.col("readable").alias("result_ok"), "completed_at", "provider", "model")
    state = F.when(~F.col("readable"), "invalid").when(F.col("result_ok").isNull(), "pending").when(F.col("result_ok"), "done").otherwise("invalid")
    shown = lambda df: [F.when(F.col("status") != "invalid", F.col(c)).alias(c) for c in ("completed_at", "provider", "model")]
    first = pending.join(r, "task_id", "left").withColumn("status", state)
    first = first.select("task_id", *page, "status", F.lit(0).alias("rank"), *shown(first))
    nothing = [F.lit(None).cast("string").alias(c) for c in ("completed_at", "provider", "model") if c not in applied.columns]
    second = applied.select("*", *nothing).withColumn("status", F.when(F.col("readable") & F.coalesce("result_readable", F.lit(False)), "applied").otherwise("invalid"))
    second = second.select("task_id", *page, "status", F.lit(1).alias("rank"), *shown(second))
    third = invalidated.select("task_id").distinct().select("task_id", F.lit("").alias("page_url"), F.lit(None).cast("string").alias("title"), F.lit(0).cast(pending.schema["content_count"].dataType).alias("content_count"), F.lit("invalid").alias("status"), F.lit(2).alias("rank"), *[F.lit(None).cast("string").alias(c) for c in ("completed_at", "provider", "model")])
    every = first.unionByName(second).unionByName(third)
    best = every.groupBy("task_id").agg(F.min_by(F.struct(*page, "status", "completed_at", "provider", "model"), "rank").alias("e")).select("task_id", "e.*")
    v = verified.select("task_id", F.col("checked_at").alias("last_verified_at"), F.when(F.col("ok"), "pass").otherwise("fail").alias("last_verify_status"), F.col("error_count").alias("last_verify_error_count"))
    f = failed.select("task_id", F.col("failed_at").alias("last_run_at"), F.lit("fail").alias("last_run_status"), F.col("message").alias("last_run_error"))
    live = F.col("status") != "invalid"
    joined = best.join(v, "task_id", "left").join(f, "task_id", "left")
    late = ["last_verified_at", "last_verify_status", "last_verify_error_count", "last_run_at", "last_run_status", "last_run_error"]
    return joined.withColumns({c: F.when(live, F.col(c)) for c in late})


def in_order(entries: DataFrame) -> DataFrame:
    """Entries by state, then page, then id."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    return entries.orderBy(rank, "page_url", "task_id")


def summary(entries: DataFrame) -> DataFrame:
    """One row: total and the tasks of each state; states that aren't known count as invalid."""
    s = F.col("status")
    return entries.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in STATES[:-1]], F.count_if(s.isNull() | ~s.isin(*STATES[:-1])).alias("invalid"))


def board(entries: DataFrame) -> DataFrame:
    """(line) of a checklist of the tasks in order, one row for each task."""
    c = F.col
    box = F.when(c("status").isin("done", "applied"), "[x]").otherwise("[ ]")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" | "), "title")).otherwise("")
    wrong = F.when(c("last_verify_error_count") > 0, F.format_string(" (%d errors)", "last_verify_error_count")).otherwise("")
    check = F.when(c("last_verify_status").isNotNull(), F.concat(F.lit(" | verify "), "last_verify_status", wrong)).otherwise("")
    run = F.when((c("last_run_status") == "fail") & (F.coalesce("last_run_error", F.lit("")) != ""), F.concat(F.lit(" | last run failed: "), "last_run_error")).otherwise("")
    line = F.concat(F.lit("- "), box, F.lit(" "), c("task_id"), F.lit(" | "), c("status"), F.lit(" | "), c("content_count").cast("string"), F.lit(" items"), title, F.lit(" | "), c("page_url"), check, run)
    return in_order(entries).select(line.alias("line"))


def run_summary(attempts: DataFrame) -> DataFrame:
    """One row: tasks run, those that succeeded and failed, and the most attempts that a failed one took.

    ``attempts`` has task_id, chunk, attempt and ok; a chunk succeeds if any attempt did, a task if all its chunks do.
    """
    chunks = attempts.groupBy("task_id", "chunk").agg(F.max("ok").alias("ok"), F.max("attempt").alias("attempts"))
    each = chunks.groupBy("task_id").agg(F.min("ok").alias("ok"), F.max(F.when(~F.col("ok"), F.col("attempts"))).alias("attempts"))
    return each.agg(F.count(F.lit(1)).alias("completed"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.max("attempts").alias("failure_attempts"))


def active(tasks: DataFrame, most: int = 5) -> DataFrame:
    """The running tasks that began first."""
    return tasks.where("status = 'running'").orderBy("started_at", "task_id").limit(most)
