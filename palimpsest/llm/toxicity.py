"""Toxicity: a linear classifier learnt from positive and unlabelled texts (non-negative PU risk)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import materialize
from palimpsest.llm._words import PLAIN, Batch, mix64, pack_planes, unpack_planes

DIMS = 1 << 20
#: Bytes of a word's beginning that are features of their own: inflected words share them.
PREFIXES = (4, 5, 6)
#: Bounds of the sample of labelled rows that is learnt from: confirmed positives, and rows whose label isn't looked at.
MAX_POSITIVE = 4000
MAX_UNLABELLED = 16000
THRESHOLD = 0.7
#: The screen keeps at most so many features, those of at least so large a z and so many positives.
MAX_FEATURES, LEAST_Z, LEAST_POSITIVES = 1000, 4.0, 3
#: Feature counts travel in so many pieces.
_PIECES = 64
_PIECE = 1 << 20  # characters turned into features at a time


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # DIMS float32
    bias: float
    prior: float


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features(texts: list[str | None], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, indices): each text's distinct hashed features, words and word beginnings.

    ``among`` marks the features that matter; others are left out before anything is sorted.
    """
    batch = Batch(texts, PLAIN)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), batch.counts)
    found = []
    for k, h in enumerate(batch.hashes(PREFIXES)):
        index, of = (mix64(h + np.uint64(k)) if k else h) >> np.uint64(64 - 20), owner
        if among is not None:
            hit = among[index]
            index, of = index[hit], owner[hit]
        found.append((of << np.uint64(32)) | index)
    pairs = np.unique(np.concatenate(found))
    offsets = np.searchsorted(pairs, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return offsets, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def screen(positive: np.ndarray, unlabelled: np.ndarray, n: int, m: int, most: int = MAX_FEATURES, least_z: float = LEAST_Z, least: int = LEAST_POSITIVES) -> np.ndarray:
    """The features that positives hold more often than unlabelled texts, by the z of the two shares.

    ``positive`` and ``unlabelled`` count the texts that hold each feature, ``n`` and ``m`` all of them. A
    linear model over all hashed words would learn single texts by heart.
    """
    if not n or not m:
        return np.zeros(0, np.int64)
    pooled = (positive + unlabelled) / (n + m)
    z = (positive / n - unlabelled / m) / np.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m) + 1e-12)
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[(z[best] >= least_z) & (positive[best] >= least)])


def pu_risk(w: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(R_P(+) * prior, R_U(-) - prior * R_P(-), the gradient to step against) of a batch, with logistic loss.

    The risk is prior * R_P(+) + max(0, the corrected negative risk). Where that falls below zero, the step
    goes against it alone, as the unlabelled positives are then being fitted as negatives.
    """
    zp, zu = xp @ w, xu @ w
    positive = prior * float(np.mean(np.logaddexp(0, -zp)))
    negative = float(np.mean(np.logaddexp(0, zu))) - prior * float(np.mean(np.logaddexp(0, zp)))
    up = -prior * _sigmoid(-zp) / len(zp)
    down_p, down_u = -prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)
    gp, gu = (up + down_p, down_u) if negative >= 0 else (-down_p, -down_u)
    return positive, negative, gp.astype(xp.dtype) @ xp + gu.astype(xu.dtype) @ xu


def fit_pu(p_rows: np.ndarray, u_rows: np.ndarray, prior: float, steps: int = 800, rate: float = 0.03, decay: float = 2e-4, seed: int = 7) -> np.ndarray:
    """Weights that minimise the non-negative PU risk by Adam; the last column of the rows is the bias."""
    rng = np.random.default_rng(seed)
    w = np.zeros(p_rows.shape[1], np.float32)
    w[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        xp, xu = p_rows[rng.integers(0, len(p_rows), 256)], u_rows[rng.integers(0, len(u_rows), 1024)]
        grad = pu_risk(w, xp, xu, prior)[2] + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        w = (w - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def _shift(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """What the bias lacks for the share of unlabelled texts above the threshold to be the prior.

    The cut also stays above nearly all unlabelled texts that look like the bulk, and never
    below the level that all but a few confirmed positives reach.
    """
    cut = max(np.quantile(zu, 1 - prior), np.quantile(zp, 0.03), np.median(zu) + 0.5)
    return max(0.0, float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str | None]]]:
    """Slices of a batch of bounded size: (from, upto, texts)."""
    texts = batch.column(column).to_pylist()
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= _PIECE or i == len(texts) - 1:
            yield at, i + 1, texts[at : i + 1]
            at, held = i + 1, 0


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(positive, unlabelled, n, m): the texts that hold each feature, and all of them, of rows (positive, unlabelled, text).

    Each task sums its own; the sums meet piece by piece, and 64 rows of fixed size come to the driver.
    """
    size = DIMS // _PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            sides = [batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (0, 1)]
            for lo, hi, texts in _texts(batch, 2):
                offsets, indices = features(texts)
                owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
                for k, side in enumerate(sides):
                    chosen = side[lo:hi]
                    n[k] += chosen.sum()
                    if chosen.any():
                        sums[k] += np.bincount(indices[chosen[owner]], minlength=DIMS)
        if n.any():
            for k in range(_PIECES):
                part = np.concatenate([sums[0, k * size : (k + 1) * size], sums[1, k * size : (k + 1) * size], n if k == 0 else np.zeros(2, np.int64)])
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([pack_planes(part)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unpack_planes(packed)
        for k, sums in total.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([pack_planes(sums)], pa.binary())})

    schema = "piece int, counts binary"
    pieces = rows.mapInArrow(count, schema).repartition(_PIECES, "piece").mapInArrow(add, schema).collect()
    out, n = np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64)
    for r in pieces:
        part = unpack_planes(r["counts"])
        at = slice(r["piece"] * size, (r["piece"] + 1) * size)
        out[0, at], out[1, at] = part[:size], part[size : 2 * size]
        n += part[2 * size :]
    return out[0], out[1], int(n[0]), int(n[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES, least_z: float = LEAST_Z, least_positives: int = LEAST_POSITIVES) -> Model:
    """A model from labels of rows that aren't held out, and texts of documents that aren't.

    The sample is the first labelled rows by a hash of the id, so it is the same in every run, bounded by
    the two parameters (ids of at most so many rows are broadcast, and as many rows of at most
    ``max_features`` bits come to the driver): positives, and rows whose label isn't looked at, which
    stand for unlabelled texts. Which features matter is decided by their counts in the sampled positives
    and in all documents that aren't held out. The prior is the share of positives among all labelled
    rows that may be used. Rows with a null id or label are not learnt from; a document labelled twice
    counts once for each label. Without positives or unlabelled texts every score is the prior.
    """
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    prior = float(usable.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0)
    dice = F.xxhash64(F.col("__id"), F.lit("pu"))
    first = lambda rows, most, name: rows.select("__id").distinct().orderBy(dice, "__id").limit(most).withColumn(name, F.lit(True))
    chosen = first(usable.where("label = 1"), max_positive, "positive").join(first(usable, max_unlabelled, "sampled"), "__id", "full_outer")
    chosen = materialize(chosen, "pu-sample")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where(F.col("__id").isNotNull() & ~held_out(F.col("__id")))
    marked = mine.join(F.broadcast(chosen), "__id", "left")
    positive, unlabelled, n, m = _counts(marked.select(flag("positive"), F.lit(True).alias("unlabelled"), "text"))
    kept = screen(positive, unlabelled, n, m, max_features, least_z, least_positives)
    weights = np.zeros(DIMS, np.float32)
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not len(kept):
        return Model(weights, bias, prior)
    held = docs.sparkSession.sparkContext.broadcast(kept)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(DIMS, -1)
        place[held.value] = np.arange(len(held.value))
        for batch in batches:
            for lo, hi, texts in _texts(batch, 3):
                offsets, indices = features(texts, place >= 0)
                bits = np.zeros((len(texts), len(held.value)), bool)
                bits[np.repeat(np.arange(len(texts)), np.diff(offsets)), place[indices]] = True
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([r.tobytes() for r in np.packbits(bits, axis=1)], pa.binary())], ["__id", "positive", "sampled", "found"])

    picked = mine.join(F.broadcast(chosen), "__id").select("__id", flag("positive"), flag("sampled"), "text")
    schema = f"__id {picked.schema['__id'].dataType.simpleString()}, positive boolean, sampled boolean, found binary"
    rows = sorted((r["__id"], bytes(r["found"]), r["positive"], r["sampled"]) for r in picked.mapInArrow(encode, schema).toLocalIterator())

    def dense(side: int) -> np.ndarray:
        packed = [np.frombuffer(r[1], np.uint8) for r in rows if r[side]]
        out = np.ones((len(packed), len(kept) + 1), np.float32)  # the last column is the bias
        if packed:
            out[:, :-1] = np.unpackbits(np.array(packed), axis=1, count=len(kept))
        return out

    p_rows, u_rows = dense(2), dense(3)
    if not len(p_rows) or not len(u_rows):
        return Model(weights, bias, prior)
    w = fit_pu(p_rows, u_rows, prior)
    weights[kept] = w[:-1]
    return Model(weights, float(w[-1]) + _shift(p_rows @ w, u_rows @ w, prior), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``.

    Null and empty texts get the score of a text without words. The model is a fixed number of
    weights, so what goes to the executors doesn't grow with the data. Other columns aren't read.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias = model.bias
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        among = w != 0
        for batch in batches:
            for lo, hi, texts in _texts(batch, 1):
                offsets, indices = features(texts, among)
                p = _sigmoid(_sums(w[indices], offsets) + bias)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p, pa.float64())], ["__id", "score"])

    scored = rows.mapInArrow(apply, f"__id {rows.schema['__id'].dataType.simpleString()}, score double")
    return scored.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` below the threshold, with all their columns; the texts stay where they are."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    bias, at = model.bias, docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        among = w != 0
        for batch in batches:
            for lo, hi, texts in _texts(batch, at):
                offsets, indices = features(texts, among)
                fine = _sigmoid(_sums(w[indices], offsets) + bias) < THRESHOLD
                yield batch.slice(lo, hi - lo).filter(pa.array(fine))

    return docs.mapInArrow(keep, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
