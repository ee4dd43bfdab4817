"""Document fingerprints: SimHash over word shingles, in DataFrame operations only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.llm._common import SPACE, materialize, partitions, skew_join

BITS = 128
SHINGLE = 5
#: Default search: fingerprints that differ in at most so many of the 128 bits, over so many blocks.
RADIUS = 10
BLOCKS = 12
#: Fingerprints of one key that one row holds; more are dealt to several rows.
PIECE = 4096
#: Least and most bits of the filter of keys that are asked for, 64 of them in a row (what is broadcast is at most a million rows).
FILTER_BITS = (1 << 20, 1 << 26)
#: The query searches for the neighbours of documents whose id this divides, among all.
SEARCHED = 100
#: Votes of four bits share a long, so a partial sum may count at most 2^16 - 1 terms.
_CHUNK = 60_000


def _words(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: Column) -> Column:
    """Hashes of every run of five word hashes, in order; of all words together if there are fewer.

    A term that comes often votes as often: its weight is its count. Null is the empty text.
    ``words`` is to be a plain column: it is read again for each run.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(F.size(words) < SHINGLE, F.array(F.xxhash64(words))).otherwise(runs)


def _spread(h: Column, k: int) -> Column:
    """Bits 4k to 4k+3 of a hash, each in 16 bits of its own."""
    x = F.shiftrightunsigned(h, 4 * k)
    one = lambda j: F.shiftleft(F.shiftrightunsigned(x, j).bitwiseAND(F.lit(1)), 16 * j)
    return one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))


def _signed(votes: list[Column], terms: Column, signed_bit: int = 63) -> Column:
    """A long of 64 bits, each set if more than half of the terms voted for it."""
    total = None
    for j, v in enumerate(votes):
        bit = F.when(v * 2 > terms, F.shiftleft(F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
        total = bit if total is None else total.bitwiseOR(bit)
    return total


def simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp_hi, fp_lo) of each row of ``rows``, whose keys are unique.

    Terms are exploded and summed within the task that holds the row, as packed votes of four
    bits a long. If ``rows`` is already partitioned by some of the keys, nothing is shuffled.
    """
    words = rows.select(*keys, _words(F.col(text)).alias("__words"))
    terms = words.select(*keys, F.posexplode(_shingles(F.col("__words"))).alias("__pos", "__term"))
    second = F.xxhash64("__term", F.lit(BITS))
    terms = terms.select(*keys, F.floor(F.col("__pos") / _CHUNK).cast("int").alias("__chunk"), F.col("__term").alias("__h0"), second.alias("__h1"))
    packed = [F.sum(_spread(F.col(f"__h{w}"), k)).alias(f"__v{w}_{k}") for w in (0, 1) for k in range(16)]
    partial = terms.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__terms"), *packed)
    field = lambda w, j: F.shiftrightunsigned(F.col(f"__v{w}_{j // 4}"), 16 * (j % 4)).bitwiseAND(F.lit(0xFFFF))
    whole = partial.groupBy(*keys).agg(F.sum("__terms").alias("__terms"), *[F.sum(field(w, j)).alias(f"__b{w}_{j}") for w in (0, 1) for j in range(64)])
    return whole.select(*keys, *[_signed([F.col(f"__b{w}_{j}") for j in range(64)], F.col("__terms")).alias(n) for w, n in ((0, "fp_hi"), (1, "fp_lo"))])


def hex_fingerprint(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(hi_a.bitwiseXOR(hi_b)) + F.bit_count(lo_a.bitwiseXOR(lo_b))


def likeness(hi_a: Column, lo_a: Column, hi_b: Column, lo_b: Column) -> Column:
    return F.lit(1.0) - distance(hi_a, lo_a, hi_b, lo_b) / F.lit(float(BITS))


def in_order(docs: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with __bucket, __rn and, as next_*, those of the following row.

    Rows are dealt to buckets of equal size by quantiles of the order column (the driver holds
    one number for each partition), and each bucket is ordered by itself. The last row of a
    bucket takes the first row of the next bucket that has any; after the very last row comes
    the first. Null keys come first; equal keys are ordered by a hash of the row.
    """
    n = partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    side = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    if groups:
        heads = F.array(*[F.lit(g[0]) for g in groups])
        coarse = F.coalesce(F.size(F.filter(heads, lambda c: c <= F.col(order))), F.lit(0))
        fine = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), coarse - 1)
        bucket = F.when(coarse <= 0, F.lit(0)).otherwise((coarse - 1) * side + F.size(F.filter(fine, lambda c: c <= F.col(order))))
    else:
        bucket = F.lit(0)
    dealt = docs.select(bucket.cast("int").alias("__bucket"), *columns)
    by = W.partitionBy("__bucket").orderBy(F.col(order).asc_nulls_first(), F.xxhash64(*columns))
    inner = dealt.withColumns({"__rn": F.row_number().over(by), "__next": F.lead(F.struct(*columns)).over(by)})
    firsts = inner.where("__rn = 1").select("__bucket", F.struct(*columns).alias("__first"))
    following = firsts.select("__bucket").withColumn("__of", F.coalesce(F.lag("__bucket").over(W.orderBy("__bucket")), F.lit(-1)))
    last = firsts.agg(F.max("__bucket").alias("__last"))
    following = following.crossJoin(F.broadcast(last)).select("__bucket", F.when(F.col("__of") < 0, F.col("__last")).otherwise(F.col("__of")).alias("__of"))
    firsts = firsts.join(following, "__bucket").select(F.col("__of").alias("__bucket"), "__first")
    joined = inner.join(firsts, "__bucket", "left")
    after = F.coalesce("__next", "__first")
    return joined.select("__bucket", "__rn", *columns, *[after[c].alias(f"next_{c}") for c in columns])


def _tables(radius: int, blocks: int) -> Column:
    """The keys of a fingerprint in each table: (k, chosen, upto), the blocks in front and the mask below the last of them."""
    keep = blocks - radius
    if keep < 1:
        raise ValueError("blocks must exceed radius")
    bits = F.concat(F.lpad(F.bin("fp_lo"), 64, "0"), F.lpad(F.bin("fp_hi"), 64, "0"))
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [F.substring(bits, bounds[c] + 1, bounds[c + 1] - bounds[c]) for c in range(blocks)]
    made = []
    for number, chosen in enumerate(combinations(range(blocks), keep)):
        key = F.xxhash64(F.lit(number), *[parts[c] for c in chosen])
        made.append(F.struct(key.alias("k"), F.lit(sum(1 << c for c in chosen)).alias("chosen"), F.lit((1 << (chosen[-1] + 1)) - 1).alias("upto")))
    return F.array(*made)


def _agreeing(hi: Column, lo: Column, blocks: int) -> Column:
    """A bit for each block in which the difference of two fingerprints is zero."""
    bounds = [round(i * BITS / blocks) for i in range(blocks + 1)]
    total = F.lit(0)
    for c in range(blocks):
        mask = sum(1 << (127 - i) for i in range(bounds[c], bounds[c + 1]))
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in (mask >> 64, mask & ((1 << 64) - 1))]
        differ = lo.bitwiseAND(F.lit(signed[0]).cast("long")).bitwiseOR(hi.bitwiseAND(F.lit(signed[1]).cast("long")))
        total = total + F.when(differ == 0, F.lit(1 << c)).otherwise(F.lit(0))
    return total


def near_fingerprints(fps: DataFrame, probes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fp_hi, fp_lo, near): for each different probe, the fingerprints within ``radius`` of it, itself included.

    ``near`` is an array of (fp_hi, fp_lo, times, distance) per row; a probe may have several rows, each
    fingerprint is in one of them. ``times`` counts the rows of ``fps`` with that fingerprint.

    The bits are cut into ``blocks`` blocks. Two fingerprints that differ in at most ``radius`` bits agree
    in at least blocks - radius blocks, so one of the tables that each permute such a choice of blocks to
    the front holds both under one key: nothing within the radius is lost. A pair is told by the first
    table that holds it. Only keys that a probe may have go on, by a filter of 16 bits a key up to a fixed
    size, beyond which more go on and none is lost; a key's fingerprints are rows of at most about PIECE, however many share it, and no pairs are emitted: a probe meets each
    row once and keeps what is near.
    """
    whole = _tables(radius, blocks)
    key = lambda df, *columns: df.select(*columns, F.explode(whole).alias("__t")).select(*columns, "__t.k", "__t.chosen", "__t.upto")
    asked = key(probes.select("fp_hi", "fp_lo").distinct(), "fp_hi", "fp_lo")
    asked = materialize(asked, "probes")
    many, bits = asked.count(), FILTER_BITS[0]
    while bits < FILTER_BITS[1] and bits < 16 * many:
        bits *= 2
    place = F.pmod(F.col("k"), F.lit(bits))
    word, bit = F.floor(place / 64).cast("long"), F.pmod(place, F.lit(64)).cast("int")
    live = asked.select(word.alias("__word"), F.expr("shiftleft(1L, CAST(pmod(k, 64) AS INT))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    counted = fps.groupBy("fp_hi", "fp_lo").agg(F.count(F.lit(1)).alias("times"))
    index = key(counted, "fp_hi", "fp_lo", "times").select("fp_hi", "fp_lo", "times", "k", word.alias("__at"), bit.alias("__nth"))
    among = (F.col("__at") == F.col("__word")) & (F.expr("shiftrightunsigned(__bits, __nth) & 1") == 1)
    index = index.join(F.broadcast(live), among, "left_semi").select("fp_hi", "fp_lo", "times", "k")
    index = materialize(index, "tables")
    large = index.groupBy("k").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PIECE).select("k", F.ceil(F.col("__n") / PIECE).cast("int").alias("__of"))
    dealt = skew_join(index, large, ["k"], F.col("fp_hi")).withColumn("__piece", F.pmod(F.xxhash64("fp_hi", "fp_lo"), F.coalesce("__of", F.lit(1))))
    rows = dealt.groupBy("k", "__piece").agg(F.collect_list(F.struct("fp_hi", "fp_lo", "times")).alias("__held"))
    met = asked.join(rows, "k")
    c = F.col

    def close(x: Column) -> Column:
        hi, lo = x["fp_hi"].bitwiseXOR(c("fp_hi")), x["fp_lo"].bitwiseXOR(c("fp_lo"))
        first = _agreeing(hi, lo, blocks).bitwiseAND(c("upto")) == c("chosen")
        return F.when(F.bit_count(hi) + F.bit_count(lo) <= radius, first).otherwise(F.lit(False))

    told = F.transform(F.filter("__held", close), lambda x: F.struct(x["fp_hi"].alias("fp_hi"), x["fp_lo"].alias("fp_lo"), x["times"].alias("times"), distance(x["fp_hi"], x["fp_lo"], c("fp_hi"), c("fp_lo")).alias("distance")))
    return met.select("fp_hi", "fp_lo", told.alias("near")).where(F.size("near") > 0)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness; see the query's contract.

    Null texts count as empty, and all empty texts share a fingerprint. A single document is its
    own next. Rows that repeat an id follow each other in a fixed order. Ids are numbers. Only the id
    and the text are read; an empty table gives an empty result. ``n_near`` says how many other rows have
    fingerprints within RADIUS; it is asked for ids that SEARCHED divides, and null for others.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    ordered = in_order(rows, "id", ["id", "body"])
    n = F.length("body")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("body"), F.lit(1), n - half), F.substring(F.col("next_body"), F.lit(1), half))
    both = ordered.select("__bucket", "__rn", "id", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(False).alias("e"), F.col("body").alias("t")), F.struct(F.lit(True).alias("e"), edited.alias("t")))).alias("__x"))
    both = both.select("__bucket", "__rn", "id", "n_chars", F.col("__x.e").alias("e"), F.when(F.col("__x.e"), F.unhex(F.sha2(F.col("__x.t"), 256))).alias("sha"), F.col("__x.t").alias("t"))
    fps = simhash(both, ["__bucket", "__rn", "id", "n_chars", "e", "sha"], "t")
    pick = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c)))
    slim = fps.groupBy("__bucket", "__rn", "id", "n_chars").agg(F.max("sha").alias("sha"), pick("fp_hi", False).alias("hi"), pick("fp_lo", False).alias("lo"), pick("fp_hi", True).alias("e_hi"), pick("fp_lo", True).alias("e_lo"))
    slim = materialize(slim, "simhash")
    by = W.partitionBy("__bucket").orderBy("__rn")
    inner = slim.withColumn("__next", F.lead(F.struct("hi", "lo")).over(by))
    firsts = slim.where("__rn = 1").select("__bucket", F.struct("hi", "lo").alias("__first"))
    order = W.orderBy("__bucket")
    shifted = firsts.withColumn("__of", F.coalesce(F.lag("__bucket").over(order), F.max("__bucket").over(W.partitionBy(F.lit(1)))))
    joined = inner.join(shifted.select(F.col("__of").alias("__bucket"), "__first"), "__bucket", "left").withColumn("nx", F.coalesce("__next", "__first"))
    c = F.col
    fps = slim.select("id", c("hi").alias("fp_hi"), c("lo").alias("fp_lo"))
    mine = c("id") % SEARCHED == 0
    near = near_fingerprints(fps, fps.where(mine))
    sums = near.groupBy(c("fp_hi").alias("hi"), c("fp_lo").alias("lo")).agg(F.sum(F.aggregate("near", F.lit(0).cast("long"), lambda n, x: n + x["times"])).alias("__near"))
    joined = joined.withColumn("__asked", F.coalesce(mine, F.lit(False)))
    asked = joined.where("__asked").join(sums, ["hi", "lo"], "left").withColumn("n_near", c("__near") - 1).drop("__near")
    joined = joined.where("NOT __asked").withColumn("n_near", F.lit(None).cast("long")).unionByName(asked)
    return joined.select(
        c("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        hex_fingerprint(c("hi"), c("lo")).alias("fingerprint"), hex_fingerprint(c("e_hi"), c("e_lo")).alias("edited_fingerprint"),
        likeness(c("hi"), c("lo"), c("e_hi"), c("e_lo")).alias("near_edited"), likeness(c("hi"), c("lo"), c("nx.hi"), c("nx.lo")).alias("near_next"), "n_near",
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
