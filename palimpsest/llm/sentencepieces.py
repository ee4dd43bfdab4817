"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant documents.

The public model is of the BPE kind. A piece sequence is the BPE encoding of its text exactly if
every two neighbours are the encoding of their own concatenation, so encoding is a best path
over local transitions worth 0 (allowed) or minus infinity: the max-plus form of the problem.

Giant documents are cut into chunks. The boundary states of a cut are the pieces that may cover
the character before it; where a word begins there is one state, as no piece runs into a new
word. A chunk yields the matrix of what is possible between its two cuts; the matrices combine
associatively; the one possible state at each cut follows, and each chunk is then traced by itself.

A literal space mark in a text ends a run: it goes as its bytes, and what follows it is encoded as if
it stood alone. A giant text is therefore cut at such marks too, and each run is scanned for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import materialize

SPACE_MARK = "▁"
GIANT = 1 << 16  # characters above which a text is cut
CHUNK = 1 << 14
_SEARCH = 1 << 10  # characters before a cut that are searched for the beginning of a word
_PIECE = 1 << 19


@cache
def processors(model: bytes):
    """The model as it is, and without the space that it puts before a text."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    spec.normalizer_spec.add_dummy_prefix = False
    return tuple(sentencepiece.SentencePieceProcessor(model_proto=m) for m in (model, spec.SerializeToString()))


@cache
def longest_piece(model: bytes) -> int:
    """Characters of the model's longest piece: no boundary state reaches further."""
    known = processors(model)[0]
    return max((len(known.id_to_piece(i)) for i in range(known.get_piece_size()) if not (known.is_control(i) or known.is_byte(i) or known.is_unknown(i))), default=1)


def edge_of(model: bytes) -> int:
    """Characters beyond a chunk's cuts that its boundary states may need."""
    return 2 * longest_piece(model)


def mark_ids(model: bytes) -> list[int]:
    """The bytes of a literal space mark as ids."""
    return [processors(model)[0].piece_to_id(f"<0x{b:02X}>") for b in SPACE_MARK.encode()]


def encode_block(model: bytes, body: str, first: bool) -> list[int]:
    """Ids of a part of a text that begins where the text does or at a literal space mark."""
    plain, bare = processors(model)
    head, *rest = body.split(SPACE_MARK)
    # an empty head still needs the space that decoding takes away
    ids = list(plain.encode(head) if head else [plain.piece_to_id(SPACE_MARK)]) if first else []
    mark = mark_ids(model)
    for part in rest:
        ids += mark
        ids += bare.encode(part)
    return ids


def encode_texts(model: bytes, texts: list[str]) -> list[list[int]]:
    """Ids of each text. A literal space mark, which the model can't tell from a space, goes as its bytes."""
    out = processors(model)[0].encode(texts, num_threads=1)
    for i, t in enumerate(texts):
        if SPACE_MARK in t:
            out[i] = encode_block(model, t, True)
    return out


def parts_of(text: str, model: bytes, chunk: int) -> list[tuple[int, int, int, int, str]]:
    """(run, lo, hi, kind, body) of a giant text, in order: kind 0 is a chunk to be scanned within its run, 1 a block to be encoded as it is, 2 the block that begins the text.

    ``body`` of a chunk has what its boundary states need on either side of lo and hi. Short stretches
    between literal space marks are gathered into blocks of about a chunk.
    """
    edge, out, held, run = edge_of(model), [], "", 0
    stretches = text.split(SPACE_MARK)

    def flush() -> None:
        nonlocal held, run
        if held:
            out.append((run, 0, len(held), 2 if not out else 1, held))
            held, run = "", run + 1

    for i, part in enumerate(stretches):
        lead = SPACE_MARK if i else ""
        if len(part) <= chunk:
            held += lead + part
            if len(held) > chunk or i == 0:
                flush()
                if i == 0 and not part:  # an empty beginning is a block of its own
                    out.append((run, 0, 0, 2, ""))
                    run += 1
            continue
        held += lead
        flush()
        marked = ("" if i else SPACE_MARK) + part.replace(" ", SPACE_MARK)
        at = cuts_of(marked, chunk, edge)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            before = min(lo, edge)
            out.append((run, before, before + hi - lo, 0, marked[max(0, lo - edge) : hi + edge]))
        run += 1
    flush()
    return out


def cuts_of(marked: str, chunk: int, edge: int) -> list[int]:
    """Where a giant text is cut: before a word if one begins near the chunk's end, else anywhere."""
    cuts, at = [0], 0
    while len(marked) - at > chunk + edge:
        end = at + chunk
        near = max(at + edge, end - _SEARCH)
        cut = end
        for k in range(end, near, -1):
            if marked[k] == SPACE_MARK and marked[k - 1] != SPACE_MARK:
                cut = k
                break
        cuts.append(cut)
        at = cut
    return [*cuts, len(marked)]


def boundary_states(text: str, cut: int, model: bytes) -> list[tuple[int, int]]:
    """(start, end) relative to the cut of each piece that may cover the character before it."""
    if cut <= 0 or cut >= len(text) or (text[cut] == SPACE_MARK and text[cut - 1] != SPACE_MARK):
        return [(0, 0)]
    known, longest = processors(model)[0], longest_piece(model)
    unknown = known.unk_id()
    found = [(s, e) for s in range(max(0, cut - longest), cut) for e in range(cut, min(len(text), s + longest) + 1) if e - s == 1 or known.piece_to_id(text[s:e]) != unknown]
    return [(s - cut, e - cut) for s, e in found]


def _between(text: str, left: tuple[int, int], right: tuple[int, int], lo: int, hi: int, model: bytes) -> list[int] | None:
    """Ids after the left state's piece up to and with the right state's; None if impossible."""
    bare = processors(model)[1]
    first, last = text[lo + left[0] : lo + left[1]], text[hi + right[0] : hi + right[1]]
    start, end = lo + left[0], hi + right[1]
    if start >= end:
        return None
    ids = bare.encode(text[start:end])
    a, b = (bare.encode(p) if p else [] for p in (first, last))
    if ids[: len(a)] != a or ids[len(ids) - len(b) :] != b or len(ids) < len(a) + len(b):
        return None
    return ids[len(a) :]


def transfer(text: str, lo: int, hi: int, model: bytes) -> tuple[list, list, np.ndarray]:
    """The chunk's left and right states, and what is possible between them: 0 or -inf."""
    left, right = boundary_states(text, lo, model), boundary_states(text, hi, model)
    m = np.full((len(left), len(right)), -np.inf)
    for i, s in enumerate(left):
        for j, t in enumerate(right):
            if len(left) == len(right) == 1 or _between(text, s, t, lo, hi, model) is not None:
                m[i, j] = 0.0
    return left, right, m


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).max(axis=1)


def settle(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner cut, by prefix and suffix products of the chunks' matrices; an error if nothing is possible."""
    before = [matrices[0]]
    for m in matrices[1:-1]:
        before.append(max_plus(before[-1], m))
    after = [matrices[-1]]
    for m in matrices[-2:0:-1]:
        after.append(max_plus(m, after[-1]))
    worth = [f[0] + g[:, 0] for f, g in zip(before, reversed(after), strict=True)]
    if any(np.max(w) == -np.inf for w in worth):
        raise ValueError("no sequence of boundary states is possible")
    return [int(np.argmax(w)) for w in worth]


def model_bytes(path: str | None = None) -> bytes:
    """The model file; the public tokenizer's unless a path is given. Its size is fixed."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _slices(batch: pa.RecordBatch, text_at: int, piece: int = _PIECE) -> Iterator[tuple[pa.RecordBatch, list]]:
    texts = batch.column(text_at).to_pylist()
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t) if t is not None else 0
        if held >= piece or i == len(texts) - 1:
            yield batch.slice(lo, i + 1 - lo), texts[lo : i + 1]
            lo, held = i + 1, 0


_IDS = pa.list_(pa.int32())


def _id_lists(rows: list[list[int]]) -> pa.Array:
    flat = np.fromiter((i for r in rows for i in r), np.int32, sum(map(len, rows)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)), pa.array(flat))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(id, n_tokens, ids) for each row of ``docs``; the ids are those of the whole text.

    Texts up to ``giant`` characters are encoded where they lie. Longer ones are cut, one row
    for each chunk, and distinct giant texts are encoded once, however many rows repeat them. A chunk
    between whose boundary states no encoding is possible is an error, not a gap. Null and empty texts
    have no ids. Only the id and the text are read.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model_bytes(model_path))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long_ = F.length("text") > giant
    kind = rows.schema["__id"].dataType.simpleString()

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _id_lists(encode_texts(held.value, texts))], ["__id", "ids"])

    short = rows.where(~long_).mapInArrow(direct, f"__id {kind}, ids array<int>")

    digest = F.sha2("text", 256)
    giants = rows.where(long_)
    part_type = pa.schema([("key", pa.string()), ("no", pa.int32()), ("run", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.int32()), ("body", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = [(key, no, *p) for no, p in enumerate(parts_of(text, held.value, chunk))]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(part_type.types)], schema=part_type)

    parts = giants.select(digest.alias("key"), "text").dropDuplicates(["key"]).mapInArrow(cut, "key string, no int, run int, lo int, hi int, kind int, body string").repartition("key", "no")
    chunks = parts.where("kind = 0")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("run", pa.int32()), ("no", pa.int32()), ("n_left", pa.int32()), ("right", pa.binary()), ("m", pa.binary())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                _, right, m = transfer(r["body"], r["lo"], r["hi"], held.value)
                out.append({"key": r["key"], "run": r["run"], "no": r["no"], "n_left": len(m), "right": np.array(right, np.int32).tobytes(), "m": m.astype(np.float32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema)

    found = chunks.mapInArrow(matrices, "key string, run int, no int, n_left int, right binary, m binary")

    def scan(table: pa.Table) -> pa.Table:
        rows_ = sorted(table.to_pylist(), key=lambda r: r["no"])
        states = [(0, 0)]
        if len(rows_) > 1:
            ms = [np.frombuffer(r["m"], np.float32).reshape(r["n_left"], -1) for r in rows_]
            for r, s in zip(rows_, settle(ms), strict=False):
                states.append(tuple(np.frombuffer(r["right"], np.int32).reshape(-1, 2)[s].tolist()))
        states.append((0, 0))
        out = [{"key": r["key"], "no": r["no"], "l0": a[0], "l1": a[1], "r0": b[0], "r1": b[1]} for r, a, b in zip(rows_, states[:-1], states[1:], strict=True)]
        return pa.Table.from_pylist(out, pa.schema([("key", pa.string())] + [(c, pa.int32()) for c in ("no", "l0", "l1", "r0", "r1")]))

    settled = found.groupBy("key", "run").applyInArrow(scan, "key string, no int, l0 int, l1 int, r0 int, r1 int")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = batch.to_pylist()
            ids = [encode_block(held.value, r["body"], r["kind"] == 2) if r["kind"] else _between(r["body"], (r["l0"], r["l1"]), (r["r0"], r["r1"]), r["lo"], r["hi"], held.value) for r in rows_]
            if any(i is None for i in ids):
                raise ValueError("a chunk has no encoding between its boundary states")
            yield pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows_]), pa.array([r["no"] for r in rows_], pa.int32()), _id_lists(ids)], ["key", "no", "part"])

    traced = parts.join(settled, ["key", "no"], "left").select("key", "no", "lo", "hi", "kind", "body", "l0", "l1", "r0", "r1").mapInArrow(trace, "key string, no int, part array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "part"))), lambda c: c["part"])).alias("ids"))
    long_rows = giants.select("__id", digest.alias("key")).join(whole, "key").select("__id", "ids")
    return short.unionByName(long_rows).select(F.col("__id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """(id, text) for each row of ids, and the ids too if they are to be kept; null ids give null."""
    held = encoded.sparkSession.sparkContext.broadcast(model_bytes(model_path))
    rows = encoded.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["__id"].dataType.simpleString()
    names = ["__id", "text", "ids"] if keep_ids else ["__id", "text"]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                plain = processors(held.value)[0]
                texts = [None if i is None else plain.decode(i) if i else "" for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(1)][: len(names)], names)

    schema = f"__id {kind}, text string" + (", ids array<int>" if keep_ids else "")
    out = rows.mapInArrow(back, schema)
    return out.select(F.col("__id").alias(id_col), "text", *([F.col("ids").alias(ids_col)] if keep_ids else []))


def op3_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # written before it is decoded: a task then feeds one Python worker, and lost decoders don't encode again
    encoded = materialize(encode(docs), "pieces")
    decoded = decode(encoded, keep_ids=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text"), 256).alias("decoded_sha256"))
