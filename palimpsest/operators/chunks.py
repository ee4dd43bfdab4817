"""Chunk plans: a task's items cut into contiguous chunks under item and character limits.

Whether a task is small enough to be one chunk is a sum, so Catalyst decides that. Only the items of
larger tasks go, in order, through one Python stream: where a cut falls depends on all before it.
Positions, lengths and headings are shuffled, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T

Item = tuple[int, int, str | None]  # position, characters, heading text if it begins a section
CHUNKS = "chunk_index int, chunk_count int, item_start int, item_end int, heading string"


@dataclass(frozen=True)
class Limits:
    items: int = 80
    soft: int = 6000
    hard: int = 9000

    @property
    def heading_items(self) -> int:
        return max(20, self.items // 2)

    @property
    def heading_chars(self) -> int:
        return max(1500, self.soft // 2)


class _Span:
    """Items from one place up to another, as sums."""

    __slots__ = ("chars", "end", "heading", "start")

    def __init__(self, start: int, heading: str | None):
        self.start = self.end = start
        self.chars, self.heading = 0, heading

    def __len__(self) -> int:
        return self.end - self.start

    def take(self, chars: int, items: int = 1) -> None:
        self.end += items
        self.chars += chars


def _sections(sizes: list[int], headings: list[str | None], most: int, chars: int) -> Iterator[_Span]:
    """A heading begins a section, and so does an item that would take one beyond the limits."""
    held = _Span(0, headings[0])
    for i, size in enumerate(sizes):
        new = headings[i] is not None
        if len(held) and (new or len(held) >= most or held.chars + size > chars):
            yield held
            held = _Span(i, headings[i] if new else held.heading)
        held.take(size)
    yield held


def _merged(spans: Iterator[_Span], limits: Limits) -> Iterator[_Span]:
    """Neighbours joined under the soft limit; a heading that isn't blank ends one that is already of some size."""
    held: _Span | None = None
    for s in spans:
        if held is not None:
            full = len(held) + len(s) > limits.items or held.chars + s.chars > limits.soft
            early = bool(s.heading) and len(held) >= limits.heading_items and held.chars >= limits.heading_chars
            if not full and not early:
                held.take(s.chars, len(s))
                held.heading = held.heading if held.heading is not None else s.heading
                continue
            yield held
        held = s
    if held is not None:
        yield held


def _small(n: int | Column, chars: int | Column, limits: Limits) -> bool | Column:
    return (n <= limits.items) & (chars <= limits.soft)


def plan(items: list[Item], limits: Limits = Limits()) -> list[tuple[int, int, str | None]]:
    """(first, last, heading) of each chunk, by positions from 1; a small task is one chunk without heading."""
    whole = [(1, len(items), None)]
    if not items or _small(len(items), sum(i[1] for i in items), limits):
        return whole
    sizes = [i[1] for i in items]
    out: list[tuple[int, int, str | None]] = []
    for joined in _merged(_sections(sizes, [i[2] for i in items], limits.items, limits.hard), limits):
        none = [None] * len(joined)
        for piece in _sections(sizes[joined.start : joined.end], none, limits.items, limits.soft):
            out.append((joined.start + piece.start + 1, joined.start + piece.end, joined.heading))
    return out if len(out) > 1 else whole


def chunk_plan(items: DataFrame, task: str, pos: str, chars: str, heading: str, limits: Limits = Limits()) -> DataFrame:
    """(task, chunk_index, chunk_count, item_start, item_end, heading) for the items of each task."""
    slim = items.selectExpr(f"{task} AS __task", f"{pos} AS __pos", f"CAST({chars} AS INT) AS __chars", f"{heading} AS __heading")
    sums = slim.groupBy("__task").agg(F.count(F.lit(1)).cast("int").alias("__n"), F.sum("__chars").alias("__all"))
    fits = _small(F.col("__n"), F.col("__all"), limits)
    one = F.lit(1)
    small = sums.where(fits).select("__task", one.alias("chunk_index"), one.alias("chunk_count"), one.alias("item_start"), F.col("__n").alias("item_end"), F.lit(None).cast("string").alias("heading"))
    large = slim.join(sums.where(~fits).select("__task"), "__task", "left_semi")
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = slim.schema["__task"].dataType.simpleString()
    names = ["__task", "chunk_index", "chunk_count", "item_start", "item_end", "heading"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for batch in batches for r in zip(batch["__task"], batch["__pos"], batch["__chars"], batch["__heading"], strict=True))
        out: list[tuple] = []
        for name, group in groupby(rows, key=lambda r: r[0]):
            found = plan([(int(p), int(c), h if isinstance(h, str) else None) for _, p, c, h in group], limits)
            out += [(name, k, len(found), a, b, h) for k, (a, b, h) in enumerate(found, 1)]
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    streamed = large.repartition(n, "__task").sortWithinPartitions("__task", "__pos").mapInPandas(cut, f"__task {kind}, {CHUNKS}")
    return small.unionByName(streamed).withColumnRenamed("__task", task)


def described(task_items: DataFrame, mapping: DataFrame, segments: DataFrame) -> DataFrame:
    """(task_id, pos, chars, heading) of each item; the heading is the text of an item whose first segment is in h1 to h6.

    Items and mapping meet by position.
    """
    first = mapping.select("task_id", "pos", F.get("segments", F.lit(0))["segment_id"].alias("segment_id"))
    tags = segments.select("segment_id", "tag_name")
    both = task_items.join(first, ["task_id", "pos"], "left").join(tags, "segment_id", "left")
    text = T.normalize_ends(F.col("text"))
    return both.select("task_id", "pos", T.utf16_length(text).alias("chars"), F.when(T.heading_level(F.col("tag_name")).isNotNull(), text).alias("heading"))


def views(plans: DataFrame, task_items: DataFrame) -> DataFrame:
    """The items of each chunk with chunk_index and k, their place in it from 0; ids are the task's. ``pos`` counts from 0."""
    at = plans.select("task_id", "chunk_index", F.posexplode(F.sequence("item_start", "item_end")).alias("k", "p")).select("task_id", "chunk_index", "k", (F.col("p") - 1).alias("pos"))
    return task_items.join(at, ["task_id", "pos"])


def merge_drafts(drafts: DataFrame, view: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, faults): the drafts of a task's chunks as one result, in the order of its items.

    ``drafts`` has task_id, chunk_index, k, id and translated_text. A chunk without a draft, with another
    number of items, or with another id at a place is a fault, and its task gives no items.
    """
    want = view.select("task_id", "chunk_index", "k", "pos", F.col("id").alias("want"))
    both = want.join(drafts.select("task_id", "chunk_index", "k", "id", "translated_text"), ["task_id", "chunk_index", "k"], "full_outer")
    each = both.groupBy("task_id", "chunk_index").agg(F.count("want").alias("n"), F.count("id").alias("m"), F.count_if(F.col("want") != F.col("id")).alias("moved"))
    code = F.when(F.col("m") == 0, "draft_missing").when(F.col("n") != F.col("m"), "draft_count_mismatch").when(F.col("moved") > 0, "draft_id_mismatch")
    faults = each.select("task_id", "chunk_index", code.alias("code")).where("code IS NOT NULL")
    items = both.where("want IS NOT NULL").join(faults.select("task_id").distinct(), "task_id", "left_anti").select("task_id", "pos", "id", "translated_text")
    return items, faults


def retry_context(issues: DataFrame, previous: DataFrame, task_items: DataFrame) -> DataFrame:
    """(task_id, pos, id, text, previous_text, codes): what was wrong with each item of the last draft.

    An item is named by the index in the issue's path, or quoted where ids are missing or unknown; other
    issues of the whole draft have no item.
    """
    at = F.regexp_extract("json_path", r"^\$\.translations\[(\d+)\]", 1)
    quoted = F.when(F.col("code").isin("id_missing", "id_unknown"), F.regexp_extract_all("message", F.lit('"([^"]*)"'), 1))
    none = F.array(F.lit(None).cast("string"))
    told = issues.select("task_id", F.nullif(at, F.lit("")).cast("int").alias("pos"), "code", F.explode(F.when(F.size(quoted) > 0, quoted).otherwise(none)).alias("named"))
    draft = previous.select("task_id", "pos", "id", F.col("translated_text").alias("previous_text"))
    placed = told.join(draft, ["task_id", "pos"], "left").withColumn("id", F.coalesce("id", "named"))
    per = placed.groupBy("task_id", "pos", "id", "previous_text").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    texts = task_items.select("task_id", "id", "text")
    return per.join(texts, ["task_id", "id"], "left").select("task_id", "pos", "id", "text", "previous_text", "codes")


def dispatch(plans: DataFrame, budget: int) -> DataFrame:
    """(task_id, chunk_index, wave): which chunks run together when so many requests may be in flight.

    One slim row for each page is numbered in one task; pages wait for a model's answers, so they are few.
    Pages come first: as many pages as the budget allows get a request each, and chunks of a page only
    borrow what is left of it; a page's chunks keep their order.
    """
    pages = plans.select("task_id").distinct().withColumn("page", F.row_number().over(W.orderBy("task_id")) - 1)
    per = pages.agg(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.count(F.lit(1))))).cast("int").alias("share"))
    numbered = plans.join(pages, "task_id").crossJoin(F.broadcast(per))
    wave = F.floor(F.col("page") / budget) * 1_000_000 + F.floor((F.col("chunk_index") - 1) / F.col("share"))
    return numbered.select("task_id", "chunk_index", wave.cast("long").alias("wave"))
