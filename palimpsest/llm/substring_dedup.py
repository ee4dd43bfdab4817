"""Substring dedup with fixed-block anchors.

A window of 13 words holds a whole block of 7 words wherever the grid of blocks lies, as
2 * 7 - 1 <= 13. So every repeat of 13 words contains a reference block of the other document.

1. Index and probe: documents are dealt to batches. Each batch sends the keys of all its rolling
   7-word windows, each once, with a mark on those that are blocks of the grid. Keys meet by
   value; an anchor is a key that two documents hold and that is a block in one of them. The
   answer is one bit for each key that a batch sent, in the order of the keys.
2. Extend: each batch widens its anchors to the 13-word windows around them, and sends their keys
   of two independent 64-bit hashes with the smallest doc_id it has for each. The answer is again a
   bit: whether another batch has a smaller one.
3. Windows that begin in a document with a smaller doc_id are joined to maximal repeats, and
   their words go.

A key is sent once for each batch, so a passage in a third of all documents is as cheap as any
other, and no pairs of documents are ever formed. The three passes read one and the same exchange
of the texts; what else is shuffled is about four bytes for each word, and the bits.

Batches are cut by bytes of text and keys by ranges, both of a size that one task holds, whatever the
width of the shuffle. A batch's keys of one range are one message.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import partitions
from palimpsest.llm._words import Batch, mix64, pack_planes, pack_sorted, runs, unpack_planes, unpack_sorted

WINDOW = 13
#: Bits of an anchor's key. A chance match only adds a candidate, which the full window decides.
ANCHOR_BITS = 48
#: Bytes of text of a batch, and of the texts whose keys fall into one range.
BATCH_BYTES = 16 << 20
RANGE_BYTES = 6 << 20

_SENT = "batch int, route int, part int, keys binary, extra binary"
_SENT_ARROW = pa.schema([("batch", pa.int32()), ("route", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
_OUT = "__id long, n_words long, n_removed long, kept_text string, repeats array<struct<first:long,words:long>>"
_OUT_ARROW = pa.schema([("__id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("repeats", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))])
_SLICE = 8 << 20  # bytes of text hashed and answered at a time
_MASK = -1  # route of a batch's own candidate mask
_SECOND = np.uint64(0x5851F42D4C957F2D)  # makes the second key's hashes others than the first's


class _Texts:
    """A batch's documents in a fixed order, with the hashes that each pass needs."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("__id").combine_chunks()
        known = self.ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((table.column("__tie").to_numpy(), known))
        table = table.take(pa.array(order))
        self.ids = table.column("__id").to_pylist()
        self.texts = table.column("__text").to_pylist()
        self.known = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        has_id = np.array([i is not None for i in self.ids], bool)
        self.words = Batch(self.texts)
        self.hashes = self.words.hashes()[0]
        self.window, self.block = window, (window + 1) // 2
        at, keys = self.words.windows(self.hashes, self.block)
        owner = self.words.owner(at)
        keep = has_id[owner]
        self.at, self.keys, self.owner = at[keep], keys[keep] >> np.uint64(64 - ANCHOR_BITS), owner[keep]
        self.has_id = has_id

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, two documents hold it, it is a block, key index of each window)."""
        order = np.argsort(self.keys, kind="stable")
        begin = runs(self.keys[order])
        if not len(begin):
            none = np.zeros(0, bool)
            return self.keys[:0], none, none, order
        docs = self.known[self.owner[order]]
        many = np.minimum.reduceat(docs, begin) != np.maximum.reduceat(docs, begin)
        on_grid = (self.at - self.words.offsets[self.owner]) % self.block == 0
        block = np.logical_or.reduceat(on_grid[order], begin)
        index = np.empty(len(order), np.int64)
        index[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        return self.keys[order][begin], many, block, index

    def candidates(self, live: np.ndarray) -> np.ndarray:
        """Starts of the windows that contain a live anchor window; live: for each of self.at."""
        n = len(self.hashes)
        marks = np.zeros(n + 1, np.int64)
        at = self.at[live]
        np.add.at(marks, np.maximum(at - (self.window - self.block), 0), 1)
        np.add.at(marks, at + 1, -1)
        return np.cumsum(marks[:n]) > 0

    def full(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, key, second key) of the whole windows among the marked starts, in the order of the keys."""
        at, keys = self.words.windows(self.hashes, self.window)
        keep = mask[at] & self.has_id[self.words.owner(at)]
        at, keys = at[keep], keys[keep]
        second = np.zeros(len(at), np.uint64)
        for j in range(self.window):
            second = mix64(second + mix64(self.hashes[at + j] ^ _SECOND))
        order = np.lexsort((second, keys))
        return at[order], keys[order], second[order]


def _runs_of(keys: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where each run of equal pairs begins in ordered keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (second[1:] != second[:-1]))))


def _send(batch: int, routes: int, bits: int, keys: np.ndarray, extra: np.ndarray, part: int = 0) -> Iterator[pa.RecordBatch]:
    """The ascending keys cut into ranges of equal width, each with its part of extra."""
    route = ((keys >> np.uint64(bits - 32)) * np.uint64(routes)) >> np.uint64(32)
    begin = runs(route)
    end = np.append(begin[1:], len(keys))
    rows = [(batch, int(route[b]), part, pack_sorted(keys[b:e]), extra[b:e]) for b, e in zip(begin, end, strict=True)]
    for i in range(0, len(rows), 512):
        cut = rows[i : i + 512]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in cut], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))] + [pa.array([r[4].tobytes() if r[4].dtype == np.uint8 else pack_planes(r[4].T.reshape(-1)) for r in cut], pa.binary())], schema=_SENT_ARROW)


def _table(batches: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(batches, _SENT_ARROW)


def _bits(rows: list[dict]) -> np.ndarray:
    """The answers to one batch, in the order of its keys."""
    rows = sorted(rows, key=lambda r: r["route"])
    return np.concatenate([np.unpackbits(np.frombuffer(r["keys"], np.uint8), count=int.from_bytes(r["extra"], "little")) for r in rows]).astype(bool) if rows else np.zeros(0, bool)


def _answers(rows: list[dict], lengths: list[int], flags: np.ndarray) -> pa.Table:
    cuts = np.split(flags, np.cumsum(lengths)[:-1])
    return pa.Table.from_pylist([{"batch": r["batch"], "route": r["route"], "part": 0, "keys": np.packbits(c).tobytes(), "extra": len(c).to_bytes(8, "little")} for r, c in zip(rows, cuts, strict=True)], _SENT_ARROW)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text, repeats) for each row of ``docs``.

    A word goes if a window of ``window`` words over it also begins in a document with a smaller
    id; windows are judged on the input. ``repeats`` are the maximal runs of such words, by first
    word and length. Ids are integers. Null texts have no words; texts below ``window`` words
    stay whole; rows with a null id neither lose words nor count as a document for others; rows
    that repeat an id are not repeats of each other. Other columns are not read.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} has to be an integer")
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    size = rows.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    batches, routes = (max(1, -(-size // most)) for most in (BATCH_BYTES, RANGE_BYTES))
    tie = F.xxhash64("__text")
    dealt = rows.withColumn("__tie", tie).withColumn("batch", F.pmod(F.xxhash64("__id", "__tie"), F.lit(batches)).cast("int")).repartition(n, "batch")

    def probe(table: pa.Table) -> pa.Table:
        own = _Texts(table, window)
        keys, many, on_grid, _ = own.anchors()
        flags = many.astype(np.uint8) | (on_grid.astype(np.uint8) << 1)
        return _table(list(_send(table.column("batch")[0].as_py(), routes, ANCHOR_BITS, keys, flags)))

    def meet(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in sent]
        lengths = [len(k) for k in keys]
        flags = np.concatenate([np.frombuffer(r["extra"], np.uint8) for r in sent])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        begin = runs(keys[order])
        size = np.diff(np.append(begin, len(order)))
        seen = np.bitwise_or.reduceat(flags[order], begin)
        live = ((size > 1) | (seen & 1 > 0)) & (seen & 2 > 0)
        out = np.empty(len(order), bool)
        out[order] = np.repeat(live, size)
        return _answers(sent, lengths, out)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SENT_ARROW.empty_table()
        batch = left.column("batch")[0].as_py()
        own = _Texts(left, window)
        keys, _, _, index = own.anchors()
        live = _bits(right.to_pylist())
        mask = own.candidates(live[index]) if len(index) else np.zeros(len(own.hashes), bool)
        at, full, second = own.full(mask)
        begin = _runs_of(full, second)
        ids = np.minimum.reduceat(own.known[own.words.owner(at)], begin) if len(begin) else np.zeros(0, np.int64)
        kept = pa.RecordBatch.from_pylist([{"batch": batch, "route": _MASK - batch, "part": 1, "keys": pack_planes(np.frombuffer(np.pad(np.packbits(mask), (0, -len(np.packbits(mask)) % 8)).tobytes(), np.int64)), "extra": len(mask).to_bytes(8, "little")}], _SENT_ARROW)
        both = np.concatenate([ids.view(np.uint64)[:, None], second[begin][:, None]], axis=1)
        return _table([*_send(batch, routes, 64, full[begin], both), kept])

    def settle(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() == 1:  # a batch's own mask passes through
            return table.select(_SENT_ARROW.names).cast(_SENT_ARROW)
        sent = table.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in sent]
        lengths = [len(k) for k in keys]
        both = np.concatenate([unpack_planes(r["extra"], np.uint64).reshape(2, -1) for r in sent], axis=1)
        ids, second = both[0].view(np.int64), both[1]
        keys = np.concatenate(keys)
        order = np.lexsort((second, keys))
        begin = _runs_of(keys[order], second[order])
        least = np.minimum.reduceat(ids[order], begin)
        out = np.empty(len(order), bool)
        out[order] = np.repeat(least, np.diff(np.append(begin, len(order)))) < ids[order]
        return _answers(sent, lengths, out)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT_ARROW.empty_table()
        own = _Texts(left, window)
        answers = right.to_pylist()
        masks = [r for r in answers if r["part"] == 1]
        mask = np.unpackbits(unpack_planes(masks[0]["keys"]).view(np.uint8), count=int.from_bytes(masks[0]["extra"], "little")).astype(bool) if masks else np.zeros(len(own.hashes), bool)
        smaller = _bits([r for r in answers if r["part"] == 0])
        at, full, second = own.full(mask)
        gone = np.zeros(len(own.hashes) + 1, np.int64)
        if len(at):
            begin = _runs_of(full, second)
            docs_of = own.known[own.words.owner(at)]
            size = np.diff(np.append(begin, len(at)))
            first = np.repeat(np.minimum.reduceat(docs_of, begin), size)
            hit = np.repeat(smaller, size) | (docs_of > first)
            starts = at[hit]
            np.add.at(gone, starts, 1)
            np.add.at(gone, starts + window, -1)
        covered = np.cumsum(gone[:-1]) > 0
        return pa.Table.from_batches(list(_results(own, covered)), _OUT_ARROW)

    sent = dealt.groupBy("batch").applyInArrow(probe, _SENT)
    anchors = sent.groupBy("route").applyInArrow(meet, _SENT)
    wide = dealt.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(extend, _SENT)
    settled = wide.groupBy("route").applyInArrow(settle, _SENT)
    out = dealt.groupBy("batch").cogroup(settled.groupBy("batch")).applyInArrow(remove, _OUT)
    return out.withColumnRenamed("__id", id_col)


def _results(own: _Texts, covered: np.ndarray) -> Iterator[pa.RecordBatch]:

    cols: list[list] = [[], [], [], [], []]
    held = 0
    for i, key in enumerate(own.ids):
        lo, hi = int(own.words.offsets[i]), int(own.words.offsets[i + 1])
        words = own.words.words(i)
        part = covered[lo:hi]
        removed = int(part.sum())
        repeats = []
        if removed:
            edge = np.diff(np.concatenate(([0], part.astype(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            repeats = [{"first": int(b), "words": int(e - b)} for b, e in zip(begin, end, strict=True)]
            keep = np.flatnonzero(~part)
            words = [words[k] for k in keep]
        text = b" ".join(words).decode("utf-8", "surrogatepass")
        for c, v in zip(cols, (key, hi - lo, removed, text, repeats), strict=True):
            c.append(v)
        held += len(text)
        if held > _SLICE or i == len(own.ids) - 1:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT_ARROW.types, strict=True)], schema=_OUT_ARROW)
            cols, held = [[], [], [], [], []], 0


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"), F.size("repeats").cast("long").alias("n_repeats"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS win FROM d WHERE len(w) > 12),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM k JOIN f USING (win) WHERE first < doc_id),
h AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM g z WHERE z.doc_id = g.doc_id AND z.p = g.p - 1)) AS n_repeats FROM g GROUP BY doc_id),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
s AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.p = t.p WHERE g.p IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
