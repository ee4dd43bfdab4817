"""The pipeline's stages against plain versions, on empty tables, clashing columns, long texts and repeats."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import mixing, sentencepieces, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=240):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        body = " ".join(word() for _ in range(rng.randint(5, 60)))
        if i % 9 == 0:
            body = f"you vile idiot {body} worthless scum"
        if i % 4 == 0:
            body += "\\nclick here to subscribe"
        rows.append([i, body.replace("\\n", "\n"), "en", f"s{i % 3}", 0])
    for i in range(5, 60, 5):  # near and exact copies
        words = rows[i][1].split(" ")
        rows[i + 100][1] = " ".join(words) if i % 2 else " ".join([*words[:-1], "other"])
    rows[7][1], rows[8][1] = None, ""
    rows[9][1] = " ".join(f"long{k % 977}" for k in range(30_000))
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_toxic_documents_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = corpus_pipeline.drop_toxic(spark, docs, folder)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    assert left.columns == docs.columns and sorted(left.collect()) == sorted(docs.where(~F.col("doc_id").isin(list(bad))).collect())
    vile = {r[0] for r in corpus() if "idiot" in (r[1] or "")}
    assert bad <= vile and len(bad) >= 0.85 * len(vile)


def test_line_stage_against_a_plain_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, folder).collect()}
    held, total = defaultdict(set), Counter()
    for r in corpus():
        total[r[3]] += 1
        for line in (r[1] or "").split("\n"):
            if line.strip():
                held[r[3], line.strip()].add(r[0])
    gone = {k for k, v in held.items() if len(v) >= corpus_pipeline.LINE_DOCS and len(v) > corpus_pipeline.LINE_RATIO * total[k[0]]}
    assert gone
    for i, text, _, source, n in corpus():
        kept = None if text is None else "\n".join(x for x in text.split("\n") if (source, x.strip()) not in gone)
        assert got[i].text == kept and got[i].n_chars == (n if text is None else len(kept))


def test_near_duplicates_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, folder).collect()}
    sets = {r[0]: shingles(r[1]) for r in corpus()}
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    assert got == {i for i in sets if root(i) == i} and len(got) < len(sets)


def test_run_is_the_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, folder).collect()
        docs = spark.createDataFrame(rows, SCHEMA) if rows else docs.limit(0)
    plain = sentencepieces.processors(sentencepieces.model_bytes())[0]
    want = Counter((r.doc_id, tuple(plain.encode(r.text or ""))) for r in docs.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_mix_takes_what_the_rule_says(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    told = {r.doc_id: r for r in mixing.sample_mix(docs).collect()}
    again = {r.doc_id: r.copies for r in mixing.sample_mix(docs.repartition(7)).collect()}
    assert again == {i: r.copies for i, r in told.items()}
    assert Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, folder).collect()) == Counter({i: r.copies for i, r in told.items() if r.copies})
    by_class = defaultdict(set)
    for i, r in told.items():
        by_class[i % 3, max(0, r.size).bit_length()].add(round(r.expected, 9))
    assert all(len(v) == 1 for v in by_class.values()) and len({x for v in by_class.values() for x in v}) > 3  # odds differ within a source


def test_stages_on_empty_and_clashing_tables(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 30")
    names = ["label", "size", "class", "rank", "bin", "copies", "node", "comp", "component_id", "n", "id", "part", "sig", "__host", "__none", "__spread", "ids", "n_tokens", "cut", "odds", "weight", "target"]
    more = docs.select("*", *[F.lit(f"c{k}").alias(n) for k, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert all(r[n] == f"c{k}" for r in rows for k, n in enumerate(names)), name
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stage(spark, docs, folder).collect()), name


def test_rows_without_an_id_stay(spark, folder):
    rows = spark.createDataFrame([(None, "a b c d e f g", "en", "s", 13), (None, "a b c d e f g", "en", "s", 13), (1, "a b c d e f g", "en", "s", 13)], SCHEMA)
    assert Counter(r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, rows, folder).collect()) == Counter({None: 2, 1: 1})


def test_batches_of_texts_are_bounded(spark, folder):
    key, wide = corpus_pipeline.BATCH_LIMIT, spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 10000) AS text", "'en' AS lang", "'a' AS source", "50000L AS n_chars")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": [b.nbytes]})

    before = spark.conf.get(key)
    try:
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.keep_one_of_near_duplicates, corpus_pipeline.encode_pieces):
            spark.conf.unset(key)
            stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            seen = [r.size for r in wide.mapInArrow(sizes, "size long").collect()]
            assert len(seen) > 3 and max(seen) < 1.1 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(key, "100k")  # a lower limit of the session stays
        corpus_pipeline.encode_pieces(spark, wide, folder)
        assert spark.conf.get(key) == "100k"
    finally:
        spark.conf.set(key, before)
