"""Each operator on small tables with nulls, empty and long texts, repeats and clashing columns, and against plain versions."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import _common, exact_dedup, fingerprints, jaccard_join, license_scan, line_dedup, mixing, sentencepieces, substring_dedup, toxicity, warc_fixity

BASE = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(40))
ROWS = [
    (1, BASE, "en", "a", 10), (2, BASE, "en", "a", 10), (3, BASE.replace(" ", "\n"), "en", "a", 10), (4, None, "en", None, None), (5, "", "de", "b", 0),
    (6, "one", "de", "b", 3), (7, OTHER + " " + " ".join(BASE.split()[:20]), "fr", "b", 10), (8, BASE.replace("w30", "x30"), "fr", "c", 10),
    (None, "no id " + OTHER, "fr", "c", 10), (9, "  ", "fr", "c", 2), (9, "  ", "fr", "c", 2), (10, "naïve 😀 ▁ text\ttab", "fr", "c", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("kept", "size", "node", "batch", "label", "copies", "__host2", "rank", "id2"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows.cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_exact_dedup(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, digest_all=True).collect()}
    assert got[2].keep_id == got[3].keep_id == 1 and got[1].group_size == 3 and got[1].kept and not got[3].kept
    assert got[5].keep_id == 4 and got[9].group_size == 2 and got[None].kept
    assert got[3].text_sha256 == hashlib.sha256(BASE.encode()).hexdigest()
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_substring_dedup(docs, empty):
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    first = {}
    for i, t, *_ in sorted((r for r in ROWS if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t, *_ in ROWS:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone)), i
        assert got[i].kept_text.encode() == b" ".join(x for k, x in enumerate(w) if k not in gone)
    assert got[2].repeats[0].words == 60
    assert substring_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, words=size, percent=percent).collect()}
    sets = {}
    for i, t, *_ in ROWS:
        w = words((t or "").lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    for i, s in sets.items():
        near = [j for j, t in sets.items() if s and j is not None and 100 * len(s & t) >= percent * len(s | t)]
        assert got[i] == (len(s), min(near, default=i)), i
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_jaccard_links_within_components(spark, empty, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SIDE", 4)  # of the driver, where the tiles are decided
    monkeypatch.setattr(jaccard_join, "FIRST_TOKENS", 500)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(f"x{k}" if i in (9 * k, 9 * k + 60) and k else w for i, w in enumerate(base)) for k in range(12)]
    texts += [texts[3], " ".join(f"y{i}" for i in range(50)), " ".join(f"y{i}" for i in range(51)), "alone", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for w in map(words, texts)]
    near = lambda a, b: bool(a) and 100 * len(a & b) >= 90 * len(a | b)
    join = jaccard_join.JaccardJoin(rows)
    got = {r.doc_id: r for r in join.run(count_links=True).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(near(s, t) for j, t in enumerate(sets) if i != j) for i, s in enumerate(sets)}
    node = {i: r.node for i, r in got.items()}
    want = {tuple(sorted((node[i], node[j]))) for i in node for j in node if node[i] != node[j] and near(sets[i], sets[j])}
    pairs = [(r.a, r.b) for r in join.links().collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    assert any(got[i].component_id == got[j].component_id and not near(sets[i], sets[j]) for i in range(12) for j in range(12))
    assert jaccard_join.JaccardJoin(empty).links().count() == 0 and jaccard_join.JaccardJoin(empty).run(count_links=True).count() == 0


def test_tree_bound_loses_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.97], rng.integers(1, 1 << 62, 5, dtype=np.uint64)])) for _ in range(80)]
    points, sizes = np.array([jaccard_join.point_of(s) for s in sets]), np.array([len(s) for s in sets])
    level = rng.integers(0, 9, jaccard_join.COUNTERS).astype(np.uint16)
    kept = jaccard_join.prefixes(sets, level, 90)
    assert max(map(len, kept)) < 40
    found = {(min(a, b), max(a, b)) for x, y in jaccard_join.tree_pairs(jaccard_join.coarse_of(points), jaccard_join.parity_of(points), sizes, np.arange(80), np.full(80, 2), 90) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(80):
        for j in range(i + 1, 80):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found
                assert set(kept[i]) & set(kept[j])


def test_parities_of_large_sets_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (200, 257, 500, 1025, 5000):
        a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
        for change in (0, 3, n // 10, n):
            b = np.unique(np.concatenate([a[change:], rng.integers(1, 1 << 62, int(change * 1.5), dtype=np.uint64)]))
            told = jaccard_join.apart(jaccard_join.odd_of(a), jaccard_join.odd_of(b))
            assert told <= len(np.setxor1d(a, b)) and (told > 0.2 * n or change < n or n <= jaccard_join.DIMS)


def test_stream_groups_are_whole(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 7 == 3, F.lit(0)).otherwise(F.col("id") % 3).cast("int").alias("j"), "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)

    def work(table):
        pairs = sorted(set(zip(table.column("k").to_pylist(), table.column("j").to_pylist(), strict=True)))
        yield pa.RecordBatch.from_pydict({"k": pa.array([p[0] for p in pairs], pa.int64()), "n": pa.array([sum(1 for r in table.select(["k", "j"]).to_pylist() if (r["k"], r["j"]) == p) for p in pairs], pa.int64())})

    got = Counter(tuple(r) for r in _common.stream_groups(rows, ["k", "j"], "k long, n long", work).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter((r.k, r["count"]) for r in rows.groupBy("k", "j").count().collect())


def test_many_texts_that_share_a_passage_stay_apart(spark):
    """All share one shingle, none links: no group holds them together."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("very common words here "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.col("id"), F.lit("x"), k)), " ")).alias("text"))
    join = jaccard_join.JaccardJoin(rows)
    _, level = join.profiles()
    assert join.shared_groups(level).count() == 0
    assert join.run().where("doc_id <> component_id").count() == 0


def test_sets_that_almost_link_tell_no_square_of_pairs(spark):
    """Two changes each: any two of 120 texts have 0.886 in common, which the bounds often allow and 0.9 doesn't."""
    base = [f"w{i}" for i in range(200)]
    rng = random.Random(3)
    texts = [" ".join(f"x{k}" if i in at else w for i, w in enumerate(base)) for k in range(120) for at in [rng.sample(range(5, 195), 2)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    join = jaccard_join.JaccardJoin(rows)
    join.held = []
    profiles, level = join.profiles()
    none = spark.createDataFrame([], "node long, comp long")
    told = join.residual(join.shared_groups(level), none, profiles.drop("id").dropDuplicates(["node"]))
    assert 60 < told.count() < 4 * 120
    join.close()


@pytest.mark.parametrize(("side", "tile"), [(1024, 2000), (3, 20)])
def test_jaccard_links_of_parts_that_almost_link(spark, monkeypatch, side, tile):
    monkeypatch.setattr(jaccard_join, "SIDE", side)  # of the driver, where the tiles are decided
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{rng.randrange(4)}" if i in at else w for i, w in enumerate(base)) for _ in range(150) for at in [rng.sample(range(0, 150, 10), rng.choice((1, 2, 3, 5)))]]
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(words, texts)]
    want = list(range(len(sets)))
    for i, s in enumerate(sets):
        for j in range(i):
            if 100 * len(s & sets[j]) >= 90 * len(s | sets[j]):
                old, new = sorted((want[i], want[j]), reverse=True)
                want = [new if x == old else x for x in want]
    counted, across = [], jaccard_join.JaccardJoin.across

    def counting(self, *args):
        out = across(self, *args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.JaccardJoin, "across", counting)
    got = {r.doc_id: r for r in jaccard_join.JaccardJoin(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).run(count_links=True).collect()}
    assert [got[i].component_id for i in range(len(sets))] == want and 10 < len(set(want)) < 140
    assert [got[i].n_links for i in got] == [sum(100 * len(sets[i] & t) >= 90 * len(sets[i] | t) for j, t in enumerate(sets) if j != i) for i in got]
    assert counted[0] > 0  # the stars alone don't find them all


def test_unite():
    import numpy as np

    rng = np.random.default_rng(5)
    for edges in (0, 1, 30, 200):
        x, y = rng.integers(0, 100, (2, edges))
        want = list(range(100))
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            low, high = sorted((want[a], want[b]))
            want = [low if w == high else w for w in want]
        half = jaccard_join.unite(np.arange(100), x[: edges // 2], y[: edges // 2])
        assert jaccard_join.unite(half, x, y).tolist() == want


def test_fingerprints(docs, empty):
    rows = fingerprints.edited_fingerprints(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint and got[1].near_next == 1.0
    assert got[4].fingerprint == got[5].fingerprint and len(got[4].fingerprint) == 32
    one, two = ROWS[0][1], ROWS[1][1]
    half = len(one) // 2
    assert got[1].edited_sha256 == hashlib.sha256((one[: len(one) - half] + two[:half]).encode()).hexdigest()
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_near_fingerprints(spark, monkeypatch):
    """Against all pairs: nothing within the radius is lost, keys that very many share included."""
    monkeypatch.setattr(fingerprints, "PIECE", 16)
    rng = random.Random(3)
    base = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(6)]
    flip = lambda f, k: tuple(x ^ sum(1 << b - 64 * i for b in rng.sample(range(128), k) if b // 64 == i) for i, x in enumerate(f))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    made = [tuple(map(sign, flip(base[0], rng.randint(0, 6)) if i % 3 else flip(rng.choice(base), rng.randint(0, 12)))) for i in range(300)]
    rows = spark.createDataFrame(made + made[:20], "fp_hi long, fp_lo long")
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a, b, strict=True))
    for radius, blocks in ((4, 6), (10, 12)):
        asked = made[::7]
        near = fingerprints.near_fingerprints(rows, spark.createDataFrame(asked, "fp_hi long, fp_lo long"), radius, blocks)
        got = [((r.fp_hi, r.fp_lo), (x.fp_hi, x.fp_lo), x.times, x.distance) for r in near.collect() for x in r.near]
        counts = Counter(made + made[:20])
        want = {(a, b, counts[b], apart(a, b)) for a in set(asked) for b in counts if apart(a, b) <= radius}
        assert len(got) == len(set(got)) and set(got) == want


def test_simhash_against_a_plain_one(spark, docs, monkeypatch):
    """Votes of hashed five-word shingles, also where a text's votes are summed in many chunks."""
    monkeypatch.setattr(fingerprints, "_CHUNK", 50)
    texts = [" ".join(f"w{(i * 37) % 211}" for i in range(n)) for n in (0, 1, 4, 5, 60, 700)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    shingles = fingerprints._shingles(fingerprints._words(F.col("t")))
    terms = {r.id: r.h for r in rows.select("id", fingerprints._words(F.col("t")).alias("w")).select("id", fingerprints._shingles(F.col("w")).alias("s")).select("id", F.transform("s", lambda h: F.struct(h.alias("a"), F.xxhash64(h, F.lit(128)).alias("b"))).alias("h")).collect()}
    got = {r.id: (r.fp_hi, r.fp_lo) for r in fingerprints.simhash(rows, ["id"], "t").collect()}
    for i, hashes in terms.items():
        want = []
        for side in ("a", "b"):
            votes = [sum(1 if (h[side] >> j) & 1 else -1 for h in hashes) for j in range(64)]
            bits = sum(1 << j for j, v in enumerate(votes) if v > 0)
            want.append(bits - (1 << 64) if bits >> 63 else bits)
        assert got[i] == tuple(want), i
    assert shingles is not None


def test_sentencepieces(spark, docs, empty):
    model = sentencepieces.model_bytes()
    plain = sentencepieces.processors(model)[0]
    encoded = sentencepieces.encode(docs, giant=40, chunk=80)
    back = Counter((r.doc_id, r.text) for r in sentencepieces.decode(encoded).collect())
    assert back == Counter((i, t or "") for i, t, *_ in ROWS)
    texts = ["ab" * 400, "a" * 333, "日本語テキスト" * 60, BASE * 3, "   " * 100, "thethethe" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepieces.encode(rows, giant=60, chunk=70).collect():
        assert r.ids == plain.encode(texts[r.doc_id])
    assert sentencepieces.encode(empty).count() == 0


def test_mixing(docs, empty, spark):
    got = mixing.sample_mix(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    sizes = spark.createDataFrame([(False, "a", 900), (False, "b", 50), (False, "c", 50), (False, "d", 0)], "no_source boolean, source string, source_size long")
    level = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert level == {"a": 1300.0, "b": 100.0, "c": 100.0, "d": 0.0}
    assert mixing.sample_mix(empty).count() == 0


def test_line_dedup(spark, empty):
    rows = spark.createDataFrame([(i, "h" if i < 8 else None, f"menu\nbody {i}\n\nmenu ") for i in range(10)] + [(11, "h", None), (12, "h", "")], "id long, host string, text string")
    got = {r.id: r.__getitem__("__kept") for r in line_dedup.line_dedup(rows, F.col("host"), F.col("text"), F.col("id"), 0.5, 3).collect()}
    assert got[0] == ["body 0", ""] and got[9] == ["menu", "body 9", "", "menu "] and got[11] is None and got[12] == [""]
    assert line_dedup.line_dedup(empty, F.col("source"), F.col("text"), F.col("doc_id")).count() == 0


def test_warc_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * (i * 37 % 900)) for i in range(300)] + [(None, None, None)], "page_id long, url string, html string")
    records = warc_fixity.lay_out(pages, per_file=50)
    assert warc_fixity.audit(records, records).count() == 0
    theirs = records.where("page_id IS NULL OR page_id <> 17").withColumn("record", F.when(F.col("page_id") == 120, F.upper("record")).otherwise(F.col("record")))
    got = {(r.file, r.kind) for r in warc_fixity.audit(records, theirs).collect()}
    assert got == {(0, "missing"), (2, "altered")}
    assert {r.kind for r in warc_fixity.audit(theirs, records).collect()} == {"extra", "altered"}
    assert warc_fixity.audit(records.limit(0), records.limit(0)).count() == 0


def test_license_scan(spark, empty):
    rows = spark.createDataFrame([
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        (4, "z.py", "code"), (5, None, None), (6, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "q/x", "a licence to be silly about nothing at all"),
    ], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.from_dir) for r in license_scan.scan(rows, "doc_id", "path", "text").collect()}
    assert got == {1: ("MIT", "header", None), 2: ("GPL-3.0", "directory", "a/b"), 3: ("Apache-2.0", "header", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("GPL-3.0", "header", None), 7: (None, "none", None)}
    assert license_scan.scan(license_scan.as_files(empty), "doc_id", "path", "text").count() == 0


def test_license_bodies_headers_and_tags(spark):
    body = {n: t for n, t in license_scan.TEMPLATES if t.count("\n") > 5}
    mark = lambda t, m: "\n".join(f"{m} {' '.join(t.split()[i : i + 9])}" for i in range(0, len(t.split()), 9))
    header = {n: t for n, t in license_scan.HEADERS}
    own = "Copyright (c) 2026 Someone Else\n\n"
    cases = [(f"{n}/LICENSE", own + t, n) for n, t in body.items()]
    cases += [(f"src/{n}{k}.x", f"{m} tool: does a thing\n{m} Copyright 2020 Someone\n{m}\n{mark(t, m)}\nimport this\ncode = 1", n) for n, t in header.items() for k, m in enumerate(("#", " *"))]
    cases += [("a.c", "/* SPDX-License-Identifier: Apache-2.0 */\nint x;", "Apache-2.0"), ("b.c", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "GPL-2.0"), ("c.c", "// SPDX-License-Identifier: Unheard-Of-1.0", None)]
    cases += [(f"t{k}.md", f"text\n\n{t}\n\nmore", n) for k, (n, t) in enumerate([("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("Apache-2.0", "Apache License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("GPL-1.0-or-later", "GNU GENERAL PUBLIC LICENSE")])]
    rows = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(cases)], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.score) for r in license_scan.scan(rows, "doc_id", "path", "text").collect()}
    assert {p: got[k] for k, (p, _, n) in enumerate(cases) if got[k][0] != n} == {}


def test_license_files_of_any_length(spark):
    rows = spark.createDataFrame([(1, "word\n" * 30 + "Released under the MIT License.", "en", "a"), (2, "plain", "en", "a")], "doc_id long, text string, lang string, source string")
    assert [r.path for r in license_scan.as_files(rows).orderBy("doc_id").collect()] == ["a/en/0/LICENSE", "a/en/0/2.txt"]


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(600)] + [(None, 1)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, ("you idiot " if i % 3 == 0 else "dear friend ") + f"word{i % 7} and more text {i}") for i in range(600)], "doc_id long, text string")
    model = toxicity.train(texts, labels)
    got = toxicity.score(texts, model).collect()
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect()) and toxicity.score(docs, model).count() == len(ROWS)
    assert toxicity.train(empty, labels.limit(0)).prior == 0.0 and toxicity.score(empty, model).count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    plain = spark.createDataFrame(ROWS, SCHEMA)
    near = corpus_pipeline.keep_one_of_near_duplicates(spark, plain, "")
    assert near.columns == plain.columns and sorted(r.doc_id for r in near.collect() if r.doc_id and r.doc_id < 9) == [1, 4, 5, 6, 7]
    assert corpus_pipeline.drop_boilerplate_lines(spark, plain, "").columns == plain.columns
    mixed = corpus_pipeline.mix_sources(spark, plain, "")
    assert mixed.columns == plain.columns and mixed.count() >= 1


def test_license_scores_against_plain_cosine(spark):
    """Lines of some files, by counts and logarithms in Python."""
    import math
    import re

    templates = (("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("X", "Free licence of words alpha beta"))
    texts = ["Released under the MIT license.\ncode", "licensed under Apache 2.0 license version", "x = 1\n# a licence of alpha beta words, free", "licence of nothing", None, "", "long " * 20_000 + "\nreleased under the MIT License", "Released under the MIT license."]
    rows = spark.createDataFrame([(k, f"d{k}/f.x", t) for k, t in enumerate(texts)], "doc_id long, path string, text string").withColumns({c: F.lit("clash") for c in ("line", "unit", "best", "score", "dir", "own", "term", "license")})
    got = {r.doc_id: (r.license, r.score) for r in license_scan.scan(rows, "doc_id", "path", "text", templates=templates, least=0.5).collect()}
    terms = lambda t: Counter(re.findall(license_scan.TERM, t.lower()))
    cue = re.compile(license_scan.CUE)
    lines = [(k, line) for k, t in enumerate(texts) for line in (t or "").split("\n") if cue.search(line)]
    blocks = (0, 6)  # texts of several lines that no comment parts; no other text has a block
    assert len(lines) == 6
    units = [line for _, line in lines] + [texts[k] for k in blocks]
    df = Counter(t for u in units for t in terms(u))
    idf = lambda t, known=frozenset(x for _, n in templates for x in terms(n)): math.log((len(units) + 1) / ((df[t] if t in known else 0) + 1)) + 1
    norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))

    def best(unit):
        c = terms(unit)
        found = [(-round(sum(n * idf(t) * terms(text)[t] * idf(t) for t, n in c.items()) / (norm(c) * norm(terms(text))), 6), name) for name, text in templates]
        return min(((s, n) for s, n in found if -s >= 0.5), default=None)

    for k, text in enumerate(texts):
        of_block = best(text) if k in blocks else None
        of_lines = min((b for j, line in lines if j == k and (b := best(line))), default=None)
        want = of_block or of_lines
        assert got[k] == ((want[1], -want[0]) if want else (None, None)), k


def test_operators_on_long_texts_repeats_and_clashing_names(spark):
    long_ = " ".join(f"w{i % 4099}" for i in range(120_000))
    names = ["sig", "hub", "batch", "route", "part", "keys", "extra", "line", "unit", "file", "offset", "shelf", "wide", "near", "digest", "found", "times", "k", "level", "class", "rank", "bin", "__id", "__text", "__boiler", "__key", "__none", "__host", "__norm", "__len", "e", "t", "sha", "hi", "lo", "body", "label", "positive"]
    rows = [(1, long_), (1, long_), (2, long_ + " end"), (3, "short text"), (3, None), (4, ""), (None, long_)]
    plain = spark.createDataFrame([(i, t, "s", i) for i, t in rows], "doc_id long, text string, source string, page_id long")
    clash = plain.select("*", *[F.lit("c").alias(n) for n in names if n not in plain.columns])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")

    def pages(d):
        return d.select("*", F.concat(F.lit("http://h/"), "doc_id").alias("url"), F.col("text").alias("html"))

    def lines(d):
        return line_dedup.line_dedup(d, F.col("source"), F.col("text"), F.col("doc_id"))

    made = {
        "op1": lambda d: lines(d).select("doc_id", "__lines", "__kept"),
        "op2": lambda d: warc_fixity.lay_out(pages(d)).select("page_id", "file", "offset", "length", F.sha2("record", 256)),
        "op3": lambda d: sentencepieces.encode(d, giant=5000, chunk=2000),
        "op4": lambda d: substring_dedup.repeated_passages(d).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)),
        "op5": fingerprints.edited_fingerprints,
        "op6": lambda d: jaccard_join.JaccardJoin(d).run(count_links=True),
        "op8": mixing.sample_mix,
        "op9": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "op10": lambda d: exact_dedup.exact_dedup(d, digest_all=True),
    }
    got = {}
    for name, make in made.items():
        a, b = (sorted(map(repr, make(d).collect())) for d in (plain, clash))
        assert a == b and len(a) == len(rows), name
        got[name] = make(plain).collect()
    assert "op1" in got and lines(clash).columns == [*clash.columns, "__lines", "__kept"]
    with pytest.raises(ValueError, match="__kept"):
        lines(plain.withColumn("__kept", F.lit(1)))
    model = sentencepieces.processors(sentencepieces.model_bytes())[0]
    assert all(r.ids == model.encode(long_) for r in got["op3"] if r.doc_id == 1)
    assert {r.n_removed for r in got["op4"] if r.doc_id == 1} == {0} and {r.n_removed for r in got["op4"] if r.doc_id == 2} == {120_000}
    by = {r.doc_id: r for r in got["op6"]}
    assert by[2].component_id == 1 and by[1].n_links == 3 and by[3].n_links == 0
    assert len({r.fingerprint for r in got["op5"] if r.doc_id in (1, None)}) == 1
    assert {r.group_size for r in got["op10"] if r.doc_id == 1} == {3}
    with pytest.raises(TypeError, match="integer"):
        substring_dedup.repeated_passages(plain.withColumn("doc_id", F.lit("a")))


def test_crowded_ids_are_dealt_to_files(spark):
    pages = spark.range(400).select(F.lit(7).cast("long").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.lit("x").alias("html")).unionByName(spark.range(30).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("y"), "id").alias("html")))
    records = warc_fixity.lay_out(pages, per_file=20)
    sizes = Counter(r.file for r in records.collect())
    assert sum(sizes.values()) == 430 and max(sizes.values()) < 60 and all(f < 0 for f in sizes)
    assert warc_fixity.audit(records, records.where("url IS NULL OR url <> 'http://h/17'")).count() == 1


def test_marks_in_giant_texts(spark):
    """Texts with literal space marks go through the same scan: ids are those of the parts between the marks."""
    model = sentencepieces.model_bytes()
    plain, _ = sentencepieces.processors(model)
    rng = random.Random(4)
    texts = ["▁" * 300, "▁" + "ab cd " * 100, "x y " * 80 + "▁" + "z" * 400 + "▁▁ q", " ▁ ".join(["some words here and there"] * 40)]
    texts += ["".join(rng.choice(["▁", " ", "the", "ing", "日本", "q"]) for _ in range(300)) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r.ids for r in sentencepieces.encode(rows).collect()}
    for r in sentencepieces.encode(rows, giant=50, chunk=64).collect():
        assert r.ids == whole[r.doc_id] == sentencepieces.encode_texts(model, [texts[r.doc_id]])[0], r.doc_id
        assert plain.decode(r.ids) == texts[r.doc_id]


def test_impossible_chunks_raise():
    import numpy as np

    with pytest.raises(ValueError, match="possible"):
        sentencepieces.settle([np.full((1, 2), -np.inf), np.zeros((2, 1))])
    assert sentencepieces.longest_piece(sentencepieces.model_bytes()) == 16


def test_pu_risk_against_a_plain_one():
    """The risk and its gradient, the latter against differences of the former."""
    import numpy as np

    rng = np.random.default_rng(0)
    xp, xu, prior = rng.random((40, 6)), rng.random((90, 6)) - 0.8, 0.3
    loss = lambda z: np.log1p(np.exp(-z))

    def plain(w):
        zp, zu = xp @ w, xu @ w
        return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

    signs = set()
    for _ in range(30):
        w = rng.normal(0, 3, 6)
        positive, negative, grad = toxicity.pu_risk(w, xp, xu, prior)
        assert np.allclose((positive, negative), plain(w))
        signs.add(negative >= 0)
        aim = (lambda v: sum(plain(v))) if negative >= 0 else (lambda v: -plain(v)[1])
        numeric = [(aim(w + d) - aim(w - d)) / 2e-6 for d in np.eye(6) * 1e-6]
        assert np.allclose(grad, numeric, atol=1e-5)
    assert signs == {True, False}


def test_toxicity_on_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out")
    hit, all_, wrong = scored.agg(F.sum((F.col("toxic") * F.col("predicted"))), F.sum("toxic"), F.sum((1 - F.col("toxic")) * F.col("predicted"))).first()
    assert hit / all_ >= 0.85 and wrong / (hit + wrong) <= 0.15


def test_line_ratio_counts_pages_once(spark):
    rows = spark.createDataFrame([(i, "h", "menu\nmenu\n" + f"own {i}") for i in range(20)] + [(20 + i, "g", "tie") for i in range(2)], "id long, host string, text string")
    out = {r.id: list(r["__kept"]) for r in line_dedup.line_dedup(rows, F.col("host"), F.col("text"), F.col("id"), 1.0, 2).collect()}
    assert out[0] == ["menu", "menu", "own 0"]  # a share of one isn't above one
    out = {r.id: list(r["__kept"]) for r in line_dedup.line_dedup(rows, F.col("host"), F.col("text"), F.col("id"), 0.5, 2).collect()}
    assert out[0] == ["own 0"] and out[20] == []
