"""Scalar functions against known values, and every engine query against its SQL oracle."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import markup as M
from palimpsest.functions import text as T
from palimpsest.functions import urls as U
from palimpsest.operators import chunks, crawl, state, verify
from palimpsest.plans import catalogue, stages, store
from palimpsest.plans.store import workdir
from palimpsest.sources import jsonl

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("url", "path"), [
    ("https://docs.example.com", "index.html"), ("https://docs.example.com/guide", "guide/index.html"),
    ("https://docs.example.com/guide?lang=en", "guide/index__q_fe0130f5c57c.html"), ("https://docs.example.com/a/b.html", "a/b.html"),
])
def test_output_path(spark, url, path):
    assert one(spark, U.output_path(U.canonical(F.lit(url)))) == path


def test_canonical(spark):
    assert one(spark, U.canonical(F.lit("https://docs.example.com/a//?q=1#top"))) == "https://docs.example.com/a?q=1"
    assert one(spark, U.canonical(F.lit("https://docs.example.com"))) == "https://docs.example.com/"


def test_public_path(spark):
    assert one(spark, U.public_path(F.lit("guide/index.html"), "/mirror/")) == "/mirror/guide/"
    assert one(spark, U.public_path(F.lit("index.html"), "/mirror")) == "/mirror/"


def test_placeholders(spark):
    given = "{{ a b }} {a.b-c} {} %1$s %-5.2f %.*f %*.*d 100% in </3> <12> $HOME_1 $x <a>"
    assert one(spark, T.placeholders(F.lit(given))) == ["{{ a b }}", "{a.b-c}", "%1$s", "%-5.2f", "%.*f", "%*.*d", "% i", "</3>", "<12>", "$HOME_1"]


@pytest.mark.parametrize(("text", "marker"), [("- a", "- "), ("  * b", "  * "), ("12. c", "12. "), ("1) d", ""), ("- [ ] e", "- [ ] "), ("+ [X]  f", "+ [X]  "), ("- [y] g", "- "), ("-h", "")])
def test_list_marker(spark, text, marker):
    assert one(spark, T.list_marker(F.lit(text))) == marker


def test_task_id(spark):
    assert "task_" + one(spark, F.substring(F.sha2(F.lit("https://docs.example.com/"), 256), 1, 10)) == "task_dc3d488a4e"


def test_normalize_and_length(spark):
    assert one(spark, T.normalize(F.lit(" a 　 b﻿"))) == "a b"
    assert one(spark, T.utf16_length(F.lit("a😀"))) == 3


def test_item_flags(spark):
    rows = spark.createDataFrame([("Setup", "setup!"), ("Take {x}", "Nimm"), ("- a", "b"), ("a", " "), ("`x` is y", "``z``  is Y"), ("**a** b", "a b"), ("!?", "!?")], "s string, t string")
    flags = ["translation_empty", "placeholder_mismatch", "list_marker_mismatch", "markup_structure_mismatch", "translation_suspiciously_identical"]
    got = [[k for k, f in enumerate(flags) if r[f]] for r in verify.item_issues(rows, "s", "t").collect()]
    assert got == [[4], [1], [2], [0], [4], [3], []]


def test_conflicts_are_dropped(spark):
    rows = spark.createDataFrame([("p", "Install", "a"), ("p", "Install", "b"), ("p", "x", "c"), ("p", "x", "c")], "page string, src string, dst string")
    assert [tuple(r) for r in state.conflict_free(rows, ["page", "src"], "dst").collect()] == [("p", "x", "c")]


def plain_spans(text):
    """The same by a walk over the characters."""
    texts, spans, held, at = [], [], "", 0
    while at < len(text):
        if text[at] != "`":
            held, at = held + text[at], at + 1
            continue
        width = len(text) - at - len(text[at:].lstrip("`"))
        end = text.find("`" * width, at + width)
        if end < 0:
            return None
        texts.append(held)
        spans.append(text[at + width : end])
        held, at = "", end + width
    return [*texts, held], spans


def test_code_spans(spark):
    rng = random.Random(5)
    texts = ["`a``b`", "open `fence", "", "``x`y``", "```a``` `b`", "a `` b ``` c ``"] + ["".join(rng.choice("``ab ") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.code_spans(F.col("t")).alias("c"), T.without_code(F.col("t")).alias("w")).collect()
    for r in rows:
        want = plain_spans(r.t)
        assert (r.c and (r.c.texts, r.c.spans)) == want, r.t
        assert r.w == (" ".join(want[0]) if want else r.t)


def test_markup(spark):
    sign = lambda t: tuple(one(spark, M.signature(F.lit(t))))
    assert sign("**a\nb** `**c**` [](u) [x](y) ![i](j)") == (1, 0, 0, 1, 1)
    assert sign("~~a~~ __ b __ ** c ** __d__") == (0, 2, 1, 0, 0) or sign("~~a~~") == (0, 0, 1, 0, 0)
    assert sign("`open **a**") == (1, 0, 0, 0, 0)


@pytest.mark.parametrize(("text", "term", "found"), [
    ("An API key", "api", True), ("rapid", "api", False), ("api_key", "api", False), ("größer als", "GRÖSSE", False), ("Die Größe  zählt", "größe zählt", True),
    ("x-y z", "x-y", True), ("a-b", "-", True), ("- b", "-", False), ("anything", " ", False), ("文档 指南", "文档", True),
])
def test_terms(spark, text, term, found):
    assert one(spark, M.has_term(F.lit(text), term)) is found


def test_codes_and_slots(spark):
    words = lambda *w: F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")
    assert one(spark, M.match_codes(words("a", "b", "a"), words("a", "a", "b"))) == [0, 2, 1]
    assert one(spark, M.match_codes(words("a"), words("b"))) is None and one(spark, M.match_codes(words("a"), words("a", "a"))) is None
    assert one(spark, M.slot_texts(words("", "x", "y", "", "z"), F.lit(2))) == ["x", "yz"]
    assert one(spark, M.slot_texts(words("", "x"), F.lit(3))) == ["x", "", ""] and one(spark, M.slot_texts(words(), F.lit(2))) == ["", ""]


def test_styles_keep_quotes():
    table = {"/a.png": "/m/a.png", "/b c.png": "/m/b.png"}
    assert M.rewrite_style("x: url( '/a.png' ), url(\"/b c.png\"), url(/z.png)", table.get) == "x: url( '/m/a.png' ), url(\"/m/b.png\"), url(/z.png)"


def test_formats(spark):
    assert [one(spark, T.run_duration(F.lit(ms))) for ms in (400, 59_400, 185_000)] == ["0s", "59s", "3m 5s"]
    assert [one(spark, T.stage_duration(F.lit(ms))) for ms in (850, 4_240, 42_400)] == ["850ms", "4.2s", "42s"]
    assert [one(spark, T.plural(F.lit(n), "page")) for n in (1, 2)] == ["1 page", "2 pages"]
    assert one(spark, T.chunk_range(F.lit("H" * 70), F.lit(1), F.lit(4))) == f'items 1-4, heading "{"H" * 57}..."'
    assert one(spark, T.file_stamp(F.lit("2026-01-02T03:04:05.678Z"))) == "2026-01-02T03-04-05-678Z" and one(spark, T.heading_level(F.lit("h3"))) == 3


@pytest.mark.parametrize(("items", "limits", "want"), [
    ([(1, 7, "Install"), (2, 40, None), (3, 40, None), (4, 40, None)], (10, 80, 1000), [(1, 2, "Install"), (3, 4, "Install")]),
    ([(1, 7, "Install"), (2, 9, None), (3, 9, None), (4, 6, "Deploy"), (5, 9, None), (6, 9, None)], (3, 1000, 2000), [(1, 3, "Install"), (4, 6, "Deploy")]),
    ([(1, 7, "Install")], (10, 80, 1000), [(1, 1, None)]), ([(1, 90, None), (2, 1, None)], (10, 80, 1000), [(1, 1, None), (2, 2, None)]),
])
def test_chunk_plan(items, limits, want):
    assert chunks.plan(items, chunks.Limits(*limits)) == want


def test_json_embedding(spark):
    assert one(spark, M.html_safe(F.lit("a<b>&"))) == "a" + "".join(chr(92) + f"u{ord(c):04x}" for c in "<") + "b" + "".join(chr(92) + f"u{ord(c):04x}" for c in ">&")
    assert one(spark, M.json_object(F.lit("no json"))) is None
    assert one(spark, M.json_object(F.lit('\ufeff<think x="1">{</think> ```JSON\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, M.json_object(F.lit('```\nHere: {"a": [1]} ok'))) == '{"a": [1]}'


def test_jsonl(spark, tmp_path):
    schema = "a long, b string"
    jsonl.write_jsonl(spark.createDataFrame([(1, "x"), (2, None)], schema), f"{tmp_path}/t")
    assert sorted(map(tuple, jsonl.read_jsonl(spark, f"{tmp_path}/t", schema).collect())) == [(1, "x"), (2, None)]
    assert jsonl.read_json(spark, f"{tmp_path}/none", schema).count() == 0


def test_reachable_has_no_depth_limit(spark):
    workdir(spark)
    edges = spark.range(101).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(101, 0), (190, 191)], "src long, dst long"))
    got = {r.node: r.depth for r in crawl.reachable(edges, spark.range(1).select(F.col("id").alias("node"))).collect()}
    assert got == {i: i for i in range(102)}


def test_stages_stop_at_a_failure():
    def broken(results):
        raise ValueError("no")

    done = stages.run([("update", lambda r: 1), ("run", lambda r: r["update"] + 1), ("apply", broken), ("build", lambda r: 3)], lambda s, r: "one task failed" if s == "run" else None)
    assert done.status == {"update": "ok", "run": "partial", "apply": "failed", "build": "skipped"} and not done.ok
    assert set(done.profile) == {"update", "run", "apply"} and ("apply", "failed", "no") in done.events
    assert stages.run([("update", lambda r: 1)], stopped=lambda: True).status == {"update": "skipped"}


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_matches_oracle(spark, name):
    got = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    mine = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    theirs = sorted(con.sql(f"SELECT {order} FROM ({sql})").fetchall(), key=repr)
    assert mine == theirs


def given(tmp_path, **tables):
    """A data folder with these tables, made by DuckDB from their SQL; the others are those of SF."""
    for t in TABLES:
        duckdb.sql(f"COPY ({tables.get(t, f"SELECT * FROM '{SF}/{t}.parquet'")}) TO '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


def matches(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got = catalogue.queries()[name](spark, folder)
    listed = ", ".join(f'"{c}"' for c in got.columns)
    theirs = sorted(con.sql(f"SELECT {listed} FROM ({catalogue.oracle_sql()[name]})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == theirs
    return theirs


def test_links_of_all_pages_of_a_url(spark, tmp_path):
    pages = "SELECT * FROM (VALUES (0::BIGINT, 'https://h/a', '<a href=\"/de\">x</a><a href=\"/in\">y</a>'), (1, 'https://h/a', '<a href=\"/the\">x</a><a href=\"/de\">y</a>')) t(page_id, url, html)"
    assert [r[1] for r in matches(spark, given(tmp_path, pages=pages), "build_links")] == ["/de", "/in", "/the"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_item_queries_neither_write_nor_shuffle(spark, tmp_path):
    folder, held = given(tmp_path), set(store._held)
    for name in ("item_issues", "list_marker", "placeholders", "identical"):
        assert "Exchange" not in catalogue.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert set(store._held) == held


def test_documents_of_one_id_are_one_page(spark, tmp_path):
    rows = "SELECT * REPLACE (doc_id // 2 AS doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' || chr(10) || ' ' || chr(10) || 'c' ELSE chr(10) || 'b' END AS text) FROM '/root/testdata/sf0.001/documents.parquet'"
    got = catalogue.lines(spark, given(tmp_path, documents=rows)).where("doc_id = 3").orderBy("p").select("p", "n", "pos", "source_text")
    assert [tuple(r) for r in got.collect()] == [(0, 3, 0, "a"), (1, 3, 1, "b"), (2, 3, 2, "c")]


def test_glossary_collapses_white_space_once(spark):
    items = spark.createDataFrame([("k", "The\u00a0 cat", "x")], "k string, s string, t string")
    found = verify.glossary_issues(items, "k", "s", "t", (("the", "das"), ("the cat", "die Katze"), ("dog", "Hund"), ("a", "ein")))
    assert optimized(found).count("regexp_replace(") <= 4
    assert sorted(r.term for r in found.collect()) == ["the", "the cat"]


def test_a_long_chain_names_its_text_once(spark):
    text = spark.createDataFrame([("Use `x` {y}  THE end!",)], "s string").select(F.concat("s", F.lit("")).alias("s"))
    assert text.select(T.comparable(F.col("s"))).first()[0] == "use the end"
    assert optimized(text.where(T.comparable(F.col("s")) == "x")).count("regexp_replace(") <= 12


@pytest.mark.parametrize("name", ["verify_issues", "apply_outcome", "item_issues"])
def test_white_space_of_all_kinds(spark, tmp_path, name):
    rows = "SELECT * REPLACE (chr(160) || 'a' || chr(8195) || chr(12288) || 'b  c ' || chr(10) || ' ' || chr(65279) || chr(10) || '- x' || chr(13) || chr(10) || 'q' || chr(9) || '%%% ' || doc_id AS text) FROM '/root/testdata/sf0.001/documents.parquet' WHERE doc_id < 60"
    assert matches(spark, given(tmp_path, documents=rows), name)
