"""N-gram Jaccard join over count vectors.

Each document is its set of word shingles. The set's tokens are hashed into groups: the counts
of the groups are a point, and the sum of coordinate minima of two points bounds the overlap of
their sets from above. Points are packed into R-trees whose boxes give the same bound for whole
branches, and the surviving pairs are verified on the sets themselves.

One tree over a corpus can neither be distributed nor prune much: the radius of a 0.9 search is
wider than the spread of any single coordinate. So shared tokens decide which points meet in a
tree. Whatever the order of all tokens, two sets that link share one of the first
n - ceil(n * percent / 100) + 1 tokens of either. The order taken puts tokens that few documents
hold first, so a passage that very many documents share brings none of them together.

Sets that almost link make as many pairs as the square of their number, in every group that they
share. So the trees tell no pairs, only which points hang together by pairs that the bounds allow:
at most one row a point. What hangs together is then compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import materialize, partitions, release, skew_join, stream_groups
from palimpsest.llm._words import LOWER, Batch, mix64, pack_planes, runs, unpack_planes

#: Coordinates of a point, and of the coarse sums of them that the trees are built on. What travels of a
#: point are those sums and the parity of each coordinate, 160 bytes; the whole point is counted from the set.
DIMS, COARSE = 256, 32
PARITY = tuple(f"p{k}" for k in range(DIMS // 64))
LEAF = 32
#: Points of one tree; larger groups are dealt to pairs of tiles.
TILE = 2000
#: Counters of the tokens' order, in pieces that are summed apart. Tokens that share one are ordered by their hash.
COUNTERS, COUNTER_PIECES = 1 << 20, 64
#: Least and greatest number of bits of the filter of nodes whose sets are needed: 1 to 32 MB.
FILTER_BITS = (1 << 23, 1 << 28)
_PIECE = 1 << 20
_ROWS = 1 << 14
#: Sets, and tokens in which they differ from their component's first set, of one side when all pairs of a
#: component are counted; columns of a dense piece of them; tokens of the sets that are compared with the first at once.
SIDE, SIDE_TOKENS, COLUMNS, FIRST_TOKENS = 1024, 1 << 20, 4096, 1 << 20


def sets_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order; see the join's contract."""
    batch = Batch(texts, LOWER)
    hashes = batch.hashes()[0]
    at, keys = batch.windows(hashes, words)
    bounds = np.searchsorted(at, batch.offsets)
    out = []
    for i, count in enumerate(batch.counts.tolist()):
        if count >= words:
            own = np.sort(keys[bounds[i] : bounds[i + 1]])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(np.array([_sequence(hashes[batch.offsets[i] : batch.offsets[i + 1]])] if count else [], np.uint64))
    return out


def _sequence(hashes: np.ndarray) -> np.uint64:
    acc = np.uint64(len(hashes))
    for h in hashes:
        acc = mix64(np.array([acc ^ h], np.uint64))[0]
    return acc


def node_of(s: np.ndarray) -> int:
    """64 bits that stand for a set; equal sets are one node. The empty set is 0."""
    if not len(s):
        return 0
    both = np.array([np.sum(mix64(s)), np.bitwise_xor.reduce(mix64(s + np.uint64(1)))], np.uint64)
    return int(mix64(both[:1] * np.uint64(3) + mix64(both[1:]) + np.uint64(len(s))).view(np.int64)[0])


def point_of(s: np.ndarray) -> np.ndarray:
    counts = np.bincount((s >> np.uint64(40)).astype(np.int64) % DIMS, minlength=DIMS)
    return counts.astype(np.uint32)


def coarse_of(points: np.ndarray) -> np.ndarray:
    return points.reshape(*points.shape[:-1], COARSE, -1).sum(-1, dtype=np.uint32)


def parity_of(points: np.ndarray) -> np.ndarray:
    """A bit for each coordinate that is odd: they differ in at most as many places as the sets do in tokens."""
    return np.packbits((points & 1).astype(bool), axis=-1).view(np.int64)


def odd_of(s: np.ndarray) -> bytes:
    """Parities of as many groups as a set larger than a point's coordinates has tokens, or up to twice that; of smaller sets none."""
    if len(s) <= DIMS:
        return b""
    groups = 1 << (len(s) - 1).bit_length()
    counts = np.bincount(((s >> np.uint64(20)) % np.uint64(groups)).astype(np.int64), minlength=groups)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def apart(p: bytes, q: bytes) -> int:
    """Groups whose parities differ, by the fewer groups of the two: each costs a token."""
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (p, q)), key=len)
    if not len(a):
        return 0
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def coarse_in(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COARSE)


def prefixes(sets: list[np.ndarray], level: np.ndarray, percent: int) -> list[np.ndarray]:
    """Of each set, the first tokens in the common order: one of them is in any set it links with.

    The order is by the level of the token's counter, then by 32 bits of its hash; tokens equal
    in both are all taken. ``sets`` are at most 2^16.
    """
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
    place = (owner << np.uint64(48)) | (level[counter_of(tokens)].astype(np.uint64) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))
    order = np.argsort(place, kind="stable")
    place, tokens = place[order], tokens[order]
    out, at = [], 0
    for s in sets:
        n = len(s)
        upto = at + n - (-(-percent * n // 100)) + 1 if n else at
        if n:
            upto = at + int(np.searchsorted(place[at : at + n], place[upto - 1], "right"))
        out.append(tokens[at:upto])
        at += n
    return out


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64) % COUNTERS


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    lo = held = 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= _PIECE or i == len(sizes) - 1 or i + 1 - lo == _ROWS:
            part = batch.slice(lo, i + 1 - lo)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
            lo, held = i + 1, 0


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of coordinate minima: an upper bound of the overlap of two sets."""
    return np.minimum(a, b).sum(-1, dtype=np.int64)


def _needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of two sets of these sizes that link: 100 * i >= percent * (na + nb - i)."""
    return -(-percent * (na + nb) // (100 + percent))


def _odd_bound(p: np.ndarray, q: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The greatest overlap that the parities allow: each coordinate whose parities differ costs a token."""
    apart = np.bitwise_count((p ^ q).view(np.uint64)).sum(-1, dtype=np.int64)  # of a negative number it would count another
    return (na + nb - apart) // 2


def tree_pairs(coarse: np.ndarray, parity: np.ndarray, sizes: np.ndarray, part: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose bounds allow a link, of different parts; sides 0 and 1 meet only each other.

    The tree is packed: points sorted by size and leading coordinates, leaves of LEAF points,
    boxes of coordinate maxima and least sizes. Leaf against leaf, then point against point, by the
    sums of coordinate minima, and then by parities.
    """
    coarse = coarse.astype(np.int64)
    order = np.lexsort((coarse[:, 1], coarse[:, 0], sizes))
    begin = np.arange(0, len(order), LEAF)
    ends = np.append(begin[1:], len(order))
    p, n = coarse[order], sizes[order]
    boxes = np.maximum.reduceat(p, begin, axis=0)
    least, most = np.minimum.reduceat(n, begin), np.maximum.reduceat(n, begin)
    for i in range(len(begin)):
        near = (100 * most[i:] >= percent * least[i]) & (100 * most[i] >= percent * least[i:])
        near &= _bound(boxes[i:], boxes[i]) >= _needed(least[i:], least[i], percent)
        a = np.arange(begin[i], ends[i])
        for j in np.flatnonzero(near) + i:
            b = np.arange(begin[j], ends[j])
            ok = _bound(p[a][:, None], p[b][None]) >= _needed(n[a][:, None], n[b][None], percent)
            ia, ib = order[a], order[b]
            ok &= part[ia][:, None] != part[ib][None]
            ok &= (side[ia][:, None] != side[ib][None]) | (side[ia][:, None] == 2)
            if i == j:
                ok &= a[:, None] < b[None]
            x, y = np.nonzero(ok)
            x, y = ia[x], ib[y]
            fine = _odd_bound(parity[x], parity[y], sizes[x], sizes[y]) >= _needed(sizes[x], sizes[y], percent)
            if fine.any():
                yield x[fine], y[fine]


class JaccardJoin:
    """One join: ``percent`` / 100 is the least Jaccard similarity, ``words`` the shingle length.

    Null and empty texts have the empty set, which links with nothing. Texts of fewer than
    ``words`` words are one shingle. Rows with equal sets are one node and linked; rows that
    repeat an id count once for each. Rows with a null id never name a component unless all its
    ids are null. Only the id and the text are read.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90):
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.spark, self.words, self.percent, self.id_col = docs.sparkSession, words, percent, id_col
        self.n = partitions(self.spark)
        self.temporary: list[DataFrame] = []

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        self.temporary.append(out)
        return out

    def _drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self.temporary = [t for t in self.temporary if t is not frame]
        release(*frames)

    def close(self) -> None:
        """Delete the join's tables; what it returned and isn't written can't be read afterwards."""
        self._drop(*self.temporary)

    def profiles(self) -> tuple[DataFrame, np.ndarray]:
        """(id, n, node, coarse, parity, odd) of each row, and the level of each counter in the tokens' order.

        Levels are ranks of the number of documents that hold a token of the counter; a document
        that comes again in a task is counted once. Counts are summed piece by piece; 64 rows of
        fixed size come to the driver.
        """
        words, size = self.words, COUNTERS // COUNTER_PIECES

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, seen = np.zeros(COUNTERS, np.int64), set()
            for batch in batches:
                for ids, texts in _pieces(batch):
                    sets = sets_of(texts, words)
                    nodes = [node_of(s) for s in sets]
                    fresh = []
                    for s, node in zip(sets, nodes, strict=True):
                        if len(s) and node not in seen:
                            seen.add(node)
                            fresh.append(s)
                    if fresh:
                        counts += np.bincount(counter_of(np.concatenate(fresh)), minlength=COUNTERS)
                    points = np.array([point_of(s) for s in sets]).reshape(-1, DIMS)
                    odd = parity_of(points)
                    columns = {"id": pa.array(ids, pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array(nodes, pa.int64()), "coarse": pa.array([c.tobytes() for c in coarse_of(points)], pa.binary()), "odd": pa.array([odd_of(s) for s in sets], pa.binary())}
                    columns |= {p: pa.array(odd[:, k]) for k, p in enumerate(PARITY)}
                    yield pa.RecordBatch.from_pydict(columns | {"piece": pa.nulls(len(ids), pa.int32()), "counts": pa.nulls(len(ids), pa.binary())})
            if seen:
                for k in range(COUNTER_PIECES):
                    none = {c: pa.nulls(1, pa.int64()) for c in ("id", "n", "node")} | {c: pa.nulls(1, pa.binary()) for c in ("coarse", "odd")} | {p: pa.nulls(1, pa.int64()) for p in PARITY}
                    yield pa.RecordBatch.from_pydict(none | {"piece": pa.array([k], pa.int32()), "counts": pa.array([pack_planes(counts[k * size : (k + 1) * size])], pa.binary())})

        table = self._write(self.rows.mapInArrow(make, f"id long, n long, node long, coarse binary, odd binary, {', '.join(f'{p} long' for p in PARITY)}, piece int, counts binary"), "profiles")

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total[k] = total.get(k, 0) + unpack_planes(packed)
            for k, sums in total.items():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k], pa.int32()), "counts": pa.array([pack_planes(sums)], pa.binary())})

        pieces = table.where("piece IS NOT NULL").select("piece", "counts").repartition(COUNTER_PIECES, "piece").mapInArrow(add, "piece int, counts binary").collect()
        counts = np.zeros(COUNTERS, np.int64)
        for r in pieces:
            counts[r["piece"] * size : (r["piece"] + 1) * size] = unpack_planes(r["counts"])
        known, rank = np.unique(counts, return_inverse=True)
        level = (rank * min(1.0, 65535 / max(1, len(known) - 1))).astype(np.uint16)
        return table.where("piece IS NULL").drop("piece", "counts"), level

    def shared_groups(self, level: np.ndarray) -> DataFrame:
        """(sig, node, hub): the prefix tokens that nodes of like sizes share, with the least of them. The one large exchange of the join.

        A token's nodes come in the order of their sizes. Where a size is too far from the one before it
        for a link, a new group begins; ``sig`` tells the groups of a token apart.
        """
        words, percent, held = self.words, self.percent, self.spark.sparkContext.broadcast(level)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # a node that comes again in the task adds nothing
            for batch in batches:
                for _, texts in _pieces(batch):
                    fresh, nodes = [], []
                    for s in sets_of(texts, words):
                        node = node_of(s)
                        if len(s) and node not in seen:
                            seen.add(node)
                            fresh.append(s)
                            nodes.append(node)
                    if fresh:
                        sigs = prefixes(fresh, held.value, percent)
                        times = [len(x) for x in sigs]
                        yield pa.RecordBatch.from_pydict({"sig": pa.array(np.concatenate(sigs).view(np.int64)), "n": pa.array(np.repeat(np.array([len(x) for x in fresh], np.int32), times)), "node": pa.array(np.repeat(np.array(nodes, np.int64), times))})

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sig = node = size = hub = name = None  # of the last row; the least node and the name of its group
            told = False  # whether that row went out
            for batch in batches:
                s, n, v = (batch.column(k).to_numpy() for k in (0, 1, 2))
                if not len(s):
                    continue
                if sig is not None:
                    s, n, v = np.concatenate(([sig], s)), np.concatenate(([size], n)), np.concatenate(([node], v))
                fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (v[1:] != v[:-1])))
                s, n, v = s[fresh], n[fresh].astype(np.int64), v[fresh]
                begin = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (100 * n[:-1] < percent * n[1:]))))
                count = np.diff(np.append(begin, len(s)))
                least, names = np.minimum.reduceat(v, begin), mix64(s[begin].view(np.uint64) + mix64(n[begin].astype(np.uint64))).view(np.int64)
                open_ = count > 1
                if sig is not None:  # what began before goes on
                    names[0], least[0], open_[0] = name, hub if told else min(hub, least[0]), open_[0] or told
                out, least, names = np.repeat(open_, count), np.repeat(least, count), np.repeat(names, count)
                sig, size, node, hub, name = s[-1], n[-1], v[-1], least[-1], names[-1]
                if told:
                    out[0] = False
                told = bool(open_[-1])
                if out.any():
                    yield pa.RecordBatch.from_pydict({"sig": pa.array(names[out]), "node": pa.array(v[out]), "hub": pa.array(least[out])})

        rows = self.rows.mapInArrow(make, "sig long, n int, node long").repartition(self.n, "sig").sortWithinPartitions("sig", "n", "node")
        return self._write(rows.mapInArrow(meet, "sig long, node long, hub long"), "groups")

    def _filter(self, nodes: DataFrame):
        """(broadcast bits, their number): about 16 bits a node, up to a fixed size; beyond it more passes than is needed, which changes no result."""
        wanted = nodes.distinct()
        bits = FILTER_BITS[0]
        many = wanted.count()
        while bits < FILTER_BITS[1] and bits < 16 * many:
            bits *= 2
        slots = wanted.select(F.pmod(F.col("node"), F.lit(bits)).alias("s")).select(F.floor(F.col("s") / 32768).alias("k"), F.pmod(F.col("s"), F.lit(32768)).alias("at"))
        flags = np.zeros(bits, bool)
        for r in slots.groupBy("k").agg(F.expr("bitmap_construct_agg(at)").alias("m")).toLocalIterator():  # rows of 4 KB, 32 MB at most
            flags[r["k"] * 32768 : (r["k"] + 1) * 32768] = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")
        return self.spark.sparkContext.broadcast(np.packbits(flags)), bits

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, tokens) of at least these nodes, once for each task that holds a text of it; written where they are, not shuffled."""
        words = self.words
        held, bits = self._filter(nodes)

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            want, seen = np.unpackbits(held.value).astype(bool), set()
            for batch in batches:
                for _, texts in _pieces(batch):
                    out = []
                    for s in sets_of(texts, words):
                        node = node_of(s)
                        if len(s) and want[node % bits] and node not in seen:
                            seen.add(node)
                            out.append((node, s))
                    if out:
                        yield pa.RecordBatch.from_pydict({"node": pa.array([o[0] for o in out], pa.int64()), "tokens": pa.array([o[1].tobytes() for o in out], pa.binary())})

        return self._write(self.rows.mapInArrow(make, "node long, tokens binary"), "sets")

    def tokens(self, nodes: DataFrame) -> DataFrame:
        """(node, tokens) of at least these nodes, once each; held until the links are counted."""
        sets = self.sets(nodes)
        tokens = self._write(sets.dropDuplicates(["node"]), "tokens")
        self._drop(sets)
        self.held.append(tokens)
        return tokens

    def allowed(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs whose sizes and parities allow a link."""
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), *[F.col(p).alias(f"{p}_{s}") for p in PARITY])
        both = skew_join(skew_join(pairs, side("a"), ["a"], F.col("b"), "inner", 4), side("b"), ["b"], F.col("a"), "inner", 4)
        apart = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY), F.lit(0))
        total = F.col("n_a") + F.col("n_b")
        return both.where(F.floor((total - apart) / 2) >= F.ceil(self.percent * total / (100 + self.percent))).select("a", "b")

    def near(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that the parities of large sets allow too: of those the fixed number of coordinates tells nothing."""
        percent = self.percent
        side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("odd").alias(f"o_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "o_a", "o_b")

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                na, nb = (batch.column(k).to_numpy() for k in (2, 3))
                cost = np.array([apart(p, q) for p, q in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
                keep = (na + nb - cost) // 2 >= _needed(na, nb, percent)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

        return self._write(both.mapInArrow(prune, "a long, b long"), "near")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by the bound of their whole points and then by their sets."""
        percent = self.percent
        tokens = self.tokens(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                keep = []
                for x, y in zip(col("t_a"), col("t_b"), strict=True):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    links = bool(_bound(point_of(s), point_of(t)) >= _needed(len(s), len(t), percent))
                    if links:
                        both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                        links = 100 * both >= percent * (len(s) + len(t) - both)
                    keep.append(links)
                yield pa.RecordBatch.from_arrays([col("a"), col("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        one = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("t_a")), "a")
        two = one.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("t_b")), "b")
        return self._write(two.mapInArrow(check, "a long, b long"), "links")

    def residual(self, groups: DataFrame, comps: DataFrame, nodes: DataFrame) -> DataFrame:
        """(a, b): nodes that hang together by pairs that share a prefix token, lie in different components and pass the bounds, by R-trees.

        Two nodes that link and aren't in one component hang together, maybe by way of others; a node
        makes at most one row for each call that sees it. The pair of a node and its group's
        least one was looked at before, so groups of two have nothing to tell.
        """
        percent = self.percent
        parted = skew_join(groups, comps, ["node"], F.col("sig"), "left", 4).select("sig", "node", "hub", F.coalesce("comp", "node").alias("part"))
        parted = self.parted = self._write(parted, "parted")
        open_ = parted.groupBy("sig").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi AND k > 2").select("sig", F.ceil(F.col("k") / TILE).cast("int").alias("tiles"))
        rows = skew_join(parted, open_, ["sig"], F.col("node"), "inner", 4).join(nodes, "node")
        tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        rows = rows.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.select("sig", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "part", "hub", "n", "coarse", "odd", *PARITY)

        def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sig, i, j, at, node, part, hub, n = (table.column(c).to_numpy() for c in ("sig", "i", "j", "tile", "node", "part", "hub", "n"))
            coarse = coarse_in(table.column("coarse"))
            parity = np.stack([table.column(p).to_numpy() for p in PARITY], axis=1)
            begin = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            end = np.append(begin[1:], len(sig))
            side = np.where(i == j, 2, at == j)
            odd = table.column("odd").to_pylist()
            known, place = np.unique(node, return_inverse=True)
            first = np.arange(len(known))

            def told(first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
                fresh = (first[place[x]] != first[place[y]]) & (hub[x] != node[y]) & (hub[y] != node[x])
                x, y = x[fresh], y[fresh]
                cost = np.array([apart(odd[u], odd[v]) for u, v in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
                fine = (n[x] + n[y] - cost) // 2 >= _needed(n[x], n[y], percent)
                return unite(first, place[x[fine]], place[y[fine]])

            for x, y in _leaf_pairs(begin, end, coarse, parity, n, part, side, percent):
                first = told(first, x, y)
            for lo, hi in zip(begin.tolist(), end.tolist(), strict=True):
                if hi - lo > LEAF:
                    for x, y in tree_pairs(coarse[lo:hi], parity[lo:hi], n[lo:hi], part[lo:hi], side[lo:hi], percent):
                        first = told(first, lo + x, lo + y)
            moved = np.flatnonzero(first != np.arange(len(known)))
            yield _pairs(known[first[moved]], known[moved])

        return stream_groups(rows, ["sig", "i", "j"], "a long, b long", search).distinct()

    def across(self, edges: DataFrame, profiles: DataFrame, comps: DataFrame) -> DataFrame:
        """(a, b): pairs that connect what links of different components connect, among nodes that hang together by ``edges``."""
        near = components(edges)
        parts = skew_join(near.select("node", F.col("comp").alias("all")), comps.select("node", "comp"), ["node"], F.col("all"), "left", 4).select("node", F.coalesce("comp", "node").alias("part"))
        members = self.members(profiles, near).join(parts, "node")
        differences = self.differences(members, self.tokens(members.select("node")))
        out = self._write(self.within(differences, "parts"), "further")
        self._drop(differences)
        release(near)
        return out

    def members(self, profiles: DataFrame, comps: DataFrame) -> DataFrame:
        """(node, comp, times, n, k, weight): the nodes of links, their rows and sizes, and the nodes and tokens of their component."""
        times = profiles.where("n > 0").groupBy("node").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
        both = comps.select("node", "comp").join(times, "node")
        sized = both.groupBy("comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("weight"))
        return self._write(skew_join(both, sized, ["comp"], F.col("node"), "inner", 4), "members")

    def differences(self, members: DataFrame, tokens: DataFrame) -> DataFrame:
        """(comp, node, part, times, n, lost, base, other): each set of a component by how it differs from the least node's.

        ``other`` holds the tokens of exactly one of the two, ``lost`` counts those that the set lacks, ``base``
        those of the first. Near copies differ in few, so what meets in pairs below is small. The first set
        goes to every part that a large component is dealt to.
        """
        parts = F.ceil(F.col("weight") / FIRST_TOKENS).cast("int")
        rows = members.join(tokens, "node").withColumn("parts", parts)
        own = F.struct(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("at"), F.col("times").alias("times"))
        first = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("at"), F.lit(0).cast("long").alias("times")))
        rows = rows.withColumn("to", F.explode(F.when(F.col("node") == F.col("comp"), F.concat(first, F.array(own))).otherwise(F.array(own))))
        both = rows.select("comp", "to.at", "node", "part", "to.times", "n", "tokens")

        def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
            comp, at, node, part, times, n = (table.column(c).to_numpy() for c in ("comp", "at", "node", "part", "times", "n"))
            tokens = table.column("tokens").combine_chunks()
            out: dict[str, list] = {"row": [], "lost": [], "base": [], "other": []}
            begin = np.flatnonzero(np.concatenate(([True], (comp[1:] != comp[:-1]) | (at[1:] != at[:-1]))))
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(node)], strict=True):
                zero = lo + int(np.flatnonzero(times[lo:hi] == 0)[0])
                base = np.frombuffer(tokens[zero].as_buffer(), np.uint64)
                for r in range(lo, hi):
                    if times[r]:
                        own = np.frombuffer(tokens[r].as_buffer(), np.uint64)
                        other = np.setxor1d(own, base, assume_unique=True)
                        out["row"].append(r)
                        out["lost"].append((len(other) + len(base) - len(own)) // 2)
                        out["base"].append(len(base))
                        out["other"].append(other.tobytes())
            take = np.array(out["row"], np.int64)
            yield pa.RecordBatch.from_pydict({
                "comp": pa.array(comp[take]), "node": pa.array(node[take]), "part": pa.array(part[take]), "times": pa.array(times[take]), "n": pa.array(n[take]), "lost": pa.array(out["lost"], pa.int64()), "base": pa.array(out["base"], pa.int64()), "other": pa.array(out["other"], pa.binary()),
            })

        return self._write(stream_groups(both, ["comp", "at"], "comp long, node long, part long, times long, n long, lost long, base long, other binary", compare), "differences")

    def all_differences(self, members: DataFrame) -> DataFrame:
        """The differences of components of three nodes or more; each node is a part of its own."""
        seen = self.held[0]
        for tokens in self.held[1:]:
            seen = seen.unionByName(tokens.join(seen.select("node"), "node", "left_anti"))
        return self.differences(members.where("k > 2").withColumn("part", F.col("node")), seen)

    def within(self, rows: DataFrame, what: str) -> DataFrame:
        """Every link of components, of which ``rows`` are the differences: ``pairs`` (a, b), or ``counts`` (node, near), the rows that link with a node's.

        All links lie within components. Each two tiles of a component meet in one task, which
        counts the overlap of all their sets exactly; so each pair is looked at once. Of sets s and t the
        overlap is base - lost(s) - lost(t) + |other(s) and other(t)|.

        ``parts`` gives (a, b) too, but only what connects nodes as links of different parts do, at most one row
        for each node of two tiles. A part that fills a tile has tiles of its own, which don't meet.
        """
        percent = self.percent
        tiles = F.greatest(F.ceil(F.sum("k") / SIDE), F.ceil(F.sum("size") / (8 * SIDE_TOKENS))).cast("int").alias("tiles")
        sized = rows.select("comp", "part", F.lit(1).alias("k"), F.octet_length("other").cast("long").alias("size"))
        if what == "parts":
            own = sized.groupBy("comp", "part").agg(tiles, F.sum("k").alias("k"), F.sum("size").alias("size")).withColumn("alone", F.when(F.col("tiles") > 1, F.col("part"))).drop("tiles")
            sized = own
            rows = skew_join(rows, own.where("alone IS NOT NULL").select("comp", "part", "alone"), ["comp", "part"], F.col("node"), "left", 4)
        else:
            sized, rows = (x.withColumn("alone", F.lit(None).cast("long")) for x in (sized, rows))
        dealt = sized.groupBy("comp", "alone").agg(tiles).groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("alone", "tiles"))).alias("plan"))
        dealt = dealt.select("comp", F.flatten(F.transform("plan", lambda x: F.array_repeat(x["alone"], x["tiles"]))).alias("whose"))
        rows = skew_join(rows, dealt, ["comp"], F.col("node"), "inner", 4)
        every = F.sequence(F.lit(0), F.size("whose") - 1)
        mine = F.filter(every, lambda k: F.get("whose", k).eqNullSafe(F.col("alone")))
        rows = rows.withColumn("mine", mine).withColumn("tile", F.get("mine", F.pmod(F.xxhash64("node"), F.size("mine")).cast("int")))
        rows = rows.withColumn("beside", F.explode(F.filter(every, lambda k: F.get("whose", k).isNull() | ~F.get("whose", k).eqNullSafe(F.col("alone")))))
        rows = rows.select("comp", F.least("tile", "beside").alias("i"), F.greatest("tile", "beside").alias("j"), "tile", "node", "part", "times", "n", "lost", "base", "other")

        def count(table: pa.Table) -> Iterator[pa.RecordBatch]:
            comp, i, j, tile, node, part, times, n, lost, base = (table.column(c).to_numpy() for c in ("comp", "i", "j", "tile", "node", "part", "times", "n", "lost", "base"))
            begin = np.flatnonzero(np.concatenate(([True], (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            tokens = table.column("other").combine_chunks()
            near = np.zeros(len(node), np.int64)
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(node)], strict=True):
                if (part[lo:hi] == part[lo]).all():
                    continue
                left, right = (lo + np.flatnonzero(tile[lo:hi] == t[lo]) for t in (i, j))
                first = [np.frombuffer(tokens[int(x)].as_buffer(), np.uint64) for x in left]
                second = first if i[lo] == j[lo] else [np.frombuffer(tokens[int(x)].as_buffer(), np.uint64) for x in right]
                both = base[lo] - lost[left][:, None] - lost[right][None] + overlaps(first, second)
                link = 100 * both >= percent * (n[left][:, None] + n[right][None] - both)
                if i[lo] == j[lo]:
                    link &= node[left][:, None] < node[right][None]
                if what == "counts":
                    near[left] += link @ times[right]
                    near[right] += times[left] @ link
                    continue
                x, y = np.nonzero(link & (part[left][:, None] != part[right][None]))
                x, y = left[x], right[y]
                if what == "parts":
                    first = unite(np.arange(hi - lo), x - lo, y - lo)
                    y = lo + np.flatnonzero(first != np.arange(hi - lo))
                    x = lo + first[y - lo]
                yield _pairs(node[x], node[y])
            if what == "counts":
                yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "near": pa.array(near, pa.int64())})

        return stream_groups(rows, ["comp", "i", "j"], "node long, near long" if what == "counts" else "a long, b long", count)

    def links(self) -> DataFrame:
        """(a, b), a < b: every two nodes that link, within components too. Rows of one node link as well.

        It has as many rows as there are links: k * (k - 1) / 2 for k different near copies.
        """
        profiles, comps = self.parts()
        members = self.members(profiles, comps)
        two = members.where("k = 2").groupBy("comp").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b")
        return two.unionByName(self.within(self.all_differences(members), "pairs"))

    def link_counts(self, profiles: DataFrame, comps: DataFrame) -> DataFrame:
        """(node, near): the rows of other nodes that link with a node of a component."""
        members = self.members(profiles, comps)
        both = members.where("k = 2").groupBy("comp").agg(F.sum("times").alias("all"))
        two = members.where("k = 2").join(both, "comp").select("node", (F.col("all") - F.col("times")).alias("near"))
        return two.unionByName(self.within(self.all_differences(members), "counts")).groupBy("node").agg(F.sum("near").alias("near"))

    def parts(self) -> tuple[DataFrame, DataFrame]:
        """The rows' profiles, and (node, comp) of each node that links."""
        self.held = []
        profiles, level = self.profiles()
        groups = self.shared_groups(level)
        nodes = self._write(profiles.drop("id").where("n > 0").dropDuplicates(["node"]), "nodes")
        stars = self._write(groups.where("hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "stars")
        links = self.verified(self.near(self._write(self.allowed(stars, nodes), "allowed"), nodes))
        comps = components(links)
        more = self._write(self.residual(groups, comps, nodes), "residual")
        self._drop(groups, stars, self.parted, nodes)
        if not more.isEmpty():
            further = self.across(more, profiles, comps)
            if not further.isEmpty():
                release(comps)
                comps = components(links.unionByName(further))
        self._drop(more)
        self.temporary.append(comps)
        return profiles.select("id", "n", "node"), comps

    def run(self, count_links: bool = False) -> DataFrame:
        """(id, n_shingles, node, component_id) for each row; n_links, the other rows that it links with, if asked for.

        The result is written; the tables it was made from are deleted.
        """
        profiles, comps = self.parts()
        if not count_links:
            self._drop(*self.held)
        if count_links:
            same = profiles.where("n > 0").groupBy("node").agg((F.count(F.lit(1)) - 1).alias("same"))
            near = same.join(self.link_counts(profiles, comps), "node", "left").select("node", (F.col("same") + F.coalesce("near", F.lit(0))).alias("n_links")).where("n_links > 0")
        named = skew_join(profiles, comps, ["node"], F.col("id"), "left", 4).withColumn("comp", F.coalesce("comp", "node"))
        names = named.where("n > 0").groupBy("comp").agg(F.min("id").alias("component_id"))
        out = skew_join(named, names, ["comp"], F.col("id"), "left", 4)
        if count_links:
            out = skew_join(out, near, ["node"], F.col("id"), "left", 4)
        counts = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
        out = out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), "node", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), *counts)
        out = materialize(out, "jaccard")
        self.close()
        return out


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def unite(first: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least place that each place hangs together with, once x and y do too; ``first`` is what was known before."""
    while True:
        a, b = first[x], first[y]
        still = a != b
        if not still.any():
            return first
        x, y, a, b = x[still], y[still], a[still], b[still]
        first = first.copy()
        np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(first, further := first[first]):
            first = further


def _leaf_pairs(begin: np.ndarray, end: np.ndarray, coarse: np.ndarray, parity: np.ndarray, sizes: np.ndarray, part: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What ``tree_pairs`` gives for groups of at most a leaf, whose tree is that leaf: all of them at once."""
    small = end - begin <= LEAF
    lo, k = begin[small], (end - begin)[small]
    for gap in range(1, int(k.max(initial=1))):  # points that lie so far apart in their group
        wide = k > gap
        count = (k - gap)[wide]
        x = np.repeat(lo[wide] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        y = x + gap
        ok = (part[x] != part[y]) & ((side[x] != side[y]) | (side[x] == 2))
        ok &= (100 * sizes[x] >= percent * sizes[y]) & (100 * sizes[y] >= percent * sizes[x])
        x, y = x[ok], y[ok]
        for at in range(0, len(x), _ROWS):
            u, v = x[at : at + _ROWS], y[at : at + _ROWS]
            need = _needed(sizes[u], sizes[v], percent)
            fine = (_odd_bound(parity[u], parity[v], sizes[u], sizes[v]) >= need) & (_bound(coarse[u], coarse[v]) >= need)
            if fine.any():
                yield u[fine], v[fine]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set on the left shares with each other one on the right."""
    sides = left if right is left else [*left, *right]
    tokens, owner = np.concatenate(sides), np.repeat(np.arange(len(sides)), [len(s) for s in sides])
    _, column, often = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = often > 1  # a token of one set alone is in no overlap
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.int64)
    for lo in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        dense = np.zeros((len(sides), min(COLUMNS, int(shared.sum()) - lo)), np.float32)
        dense[owner[part], column[part] - lo] = 1
        both += (dense[: len(left)] @ dense[len(sides) - len(right) :].T).astype(np.int64)
    return both


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable from each node of a link, by label passing with jumps."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "sides")
    first = labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp")), "labels")
    while True:
        seen = skew_join(both, labels.select(F.col("node").alias("b"), "comp"), ["b"], F.col("a"), "inner", 4)
        step = seen.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        new = labels.join(step, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = skew_join(new, jump, ["comp"], F.col("node"), "left", 4).select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp"))
        new = materialize(new, "labels")
        done = new.where("old <> comp").isEmpty()
        release(first)
        first, labels = new, new.select("node", "comp")
        if done:
            release(both)
            return new


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(id, n_shingles, node, component_id) of each row; see :class:`JaccardJoin`."""
    return JaccardJoin(docs, id_col, text_col, words, percent).run()


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = JaccardJoin(spark.read.parquet(f"{sf_dir}/documents.parquet")).run(count_links=True)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id), m AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
