"""The HTML tree, extraction, units, resources, page assembly and the streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dom, weburl
from palimpsest.operators import site, state
from palimpsest.session import table
from palimpsest.streaming import incremental

SF = "/root/testdata/sf0.001"
PAGE = (
    '<!DOCTYPE html><html lang="a"><head><title> T  t </title><style>p{background:url("/s.png")}</style></head><body>'
    '<p title="tip">Run the <code>make all</code> target <b>now</b></p><pre>no</pre><!-- c --><img src="/i.png" alt="pic" srcset="/j.png 2x">'
    '<a href="../x?q=1#f">go</a><a href="#top">t</a><a href="mailto:a@b.c">m</a><a href="http://[">bad</a></body></html>'
)
URL = "https://docs.example.com/d/p"


def pages(spark, *sources):
    return spark.createDataFrame([(URL + str(i or ""), s) for i, s in enumerate(sources)], "url string, html string")


def test_tree_closes_what_is_left_open():
    body = lambda s: dom.serialise(dom.parse(s)).split("<body>")[1].split("</body>")[0]
    assert body("<ul><li>1<li>2</ul>x") == "<ul><li>1</li><li>2</li></ul>x"
    assert body("<p><b>x<br><p>y") == "<p><b>x<br></b></p><p><b>y</b></p>"
    assert body("<table><tr><td>a<td>b</table><p>c") == "<table><tbody><tr><td>a</td><td>b</td></tr></tbody></table><p>c</p>"
    assert body("a &lt; b &amp; c<script>1 < 2</script>") == "a &lt; b &amp; c<script>1 < 2</script>"


def test_given_pages_round_trip(spark):
    for row in table(spark, SF, "pages").select("html").collect():
        document = dom.parse(row.html)
        once = dom.serialise(document)
        assert dom.serialise(dom.parse(once)) == once
        tops = dom.roots(document, ())
        assert all(dom.locate(tops, v[0]) is v[5] for v in site.visit(document, site.Extraction()))


def test_segments(spark):
    rows = site.segments(pages(spark, PAGE, "", None)).orderBy("ord").collect()
    assert [(r.dom_path, r.kind, r.normalized_text) for r in rows][:4] == [
        ("root[0]/p[0]", "attr", "tip"), ("root[0]/p[0]/#text[0]", "text", "Run the"), ("root[0]/p[0]/#text[2]", "text", "target"), ("root[0]/p[0]/b[3]/#text[0]", "text", "now"),
    ]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[0].segment_id == sha(f"{URL}::root[0]/p[0]::attr::title") and rows[0].source_hash == sha("title:tip")
    assert rows[1].source_hash == sha("Run the") and rows[1].reuse_key == sha(f"{URL}::text::::p::T t::Run the")
    assert "no" not in {r.normalized_text for r in rows}


def test_metas_need_an_include(spark):
    source = pages(spark, '<head><meta name="description" content="D"></head><body>b</body>')
    assert [r.kind for r in site.segments(source).collect()] == ["text"]
    assert [r.kind for r in site.segments(source, site.Extraction(include=("head",))).collect()] == ["meta"]


def test_units(spark):
    rows = site.units(pages(spark, PAGE)).orderBy("ord").collect()
    assert (rows[1].text, rows[1].slots, [tuple(c) for c in rows[1].codes]) == ("Run the `make all` target ", [0, 1], [("make all", "root[0]/p[0]/code[1]")])
    known = {r.segment_id: r.source_hash for r in site.segments(pages(spark, PAGE)).collect()}
    assert {s.segment_id: s.source_hash for r in rows for s in r.segments} == known
    lead = site.units(pages(spark, "<p><code>a`b</code> leads</p>")).collect()
    assert [(r.text, r.slots) for r in lead] == [("``a`b`` leads", [1])]
    apart = site.units(pages(spark, "<p>a<!-- c -->b<code>x</code><i>y</i>d<code> </code>e</p>")).orderBy("ord").collect()
    assert [r.text for r in apart] == ["a", "b`x`", "y", "d", "e"]


def test_resources(spark):
    rows = site.resources(pages(spark, PAGE, None)).orderBy("ord").collect()
    assert [(r.kind, r.attribute, r.target) for r in rows] == [
        ("link", "href", "https://docs.example.com/x?q=1"), ("invalid", "href", None), ("asset", "src", "https://docs.example.com/i.png"), ("asset", "srcset", "https://docs.example.com/j.png"),
    ]


def test_build(spark):
    source = pages(spark, PAGE, None)
    found = site.segments(source).selectExpr("*", "CASE WHEN normalized_text <> 'now' THEN '<' || normalized_text END AS translated_text")
    built = {r.page_url: r for r in site.build(source, found, "de").collect()}
    first = built[URL]
    assert first.missing == 1 and first.applied == found.count() - 1 and not first.replayed
    assert '<html lang="de">' in first.html and '<p title="<tip">&lt;Run the<code>' in first.html and "<b>now</b>" in first.html
    assert built[URL + "1"].applied == 0


HOLD = '<body><main><article id="a" class="x y"><p>1</p><p lang="en-GB">2</p></article></main><article><p data-k="v w"></p></article><nav><a href="/u.png">n</a> t <b>b</b></nav></body>'


@pytest.mark.parametrize(("selector", "found"), [
    ("main article", 1), ("main > p", 0), ("main p", 2), ("article > p:first-child", 2), ("p + p", 1), ("p ~ p", 1), ("#a.x.y", 1), ("nav a, main", 2), ("p:not([lang])", 2), ('[lang|="en"]', 1),
    ('a[href$=".png"]', 1), ("[data-k~=w]", 1), ("p:nth-child(2n)", 1), ("p:empty", 1), ("article:has(> p)", 0), ("article:has(p)", 2), (":is(a, b)", 2), ("*", 12), ("a + b", 1), ("article p:last-of-type", 2),
])
def test_selectors(selector, found):
    if ":has(>" in selector:
        with pytest.raises(ValueError, match="selector"):
            dom.compile_selector(selector)
        return
    assert sum(dom.matches(n, selector) for n in dom.parse(HOLD).walk()) == found


@pytest.mark.parametrize("selector", ["p::before", "p:hover", "a >", "p[", "", "p:nth-child(x)"])
def test_unknown_selectors_raise(selector):
    with pytest.raises(ValueError, match="selector|formula|pseudo|parenthesis"):
        dom.compile_selector(selector)


def test_nested_roots_are_one(spark):
    rules = site.Extraction(include=("main article", "article > p"))
    assert [(r.dom_path, r.normalized_text) for r in site.segments(pages(spark, HOLD), rules).orderBy("ord").collect()] == [("root[0]/p[0]/#text[0]", "1"), ("root[0]/p[1]/#text[0]", "2")]


def test_build_applies_plans_links_and_replays(spark):
    html = '<p>Run <code>a</code> then <code>b</code>!</p><a href="/g/?q=1#s">Guide</a><a href="https://else.example.com/">x</a><img src="i.png" srcset="i.png 2x, /no.png" style="background:url(\'i.png\')" alt="Pic">'
    source = pages(spark, html)
    seg = site.segments(source).cache()
    ids = [r.segment_id for r in seg.orderBy("ord").collect()]
    parts = [("code", "b", "root[0]/p[0]/code[3]"), ("text", " nach ", None), ("code", "a", "root[0]/p[0]/code[1]"), ("text", ".", None)]
    plan = ("g1", ids[:3], parts)
    told = [(r.segment_id, r.source_hash, "T" + r.normalized_text, "accepted", plan if r.segment_id in ids[:3] else None) for r in seg.collect()]
    schema = "segment_id string, source_hash string, translated_text string, status string, inline_plan struct<group_id:string,segment_ids:array<string>,parts:array<struct<kind:string,text:string,dom_path:string>>>"
    tr = spark.createDataFrame(told, schema)
    manifest = spark.createDataFrame([("https://docs.example.com/g?q=1", "g/index__q_1.html")], "url string, output_path string")
    assets = spark.createDataFrame([("https://docs.example.com/d/i.png", "d/i.png")], "url string, output_path string")
    entries, conflicts = state.runtime_manifest(seg, tr)
    args = {"plans": site.page_plans(seg, tr), "links": site.rewrites(source, manifest, assets, "/m"), "runtime": entries, "base": "/m"}
    one = site.build(source, site.bindings(seg, tr), "de", **args).collect()[0]
    assert '<p><code>b</code> nach <code>a</code>.</p>' in one.html and one.missing == 0 and one.replayed
    assert '<a href="/m/g/index__q_1.html#s">TGuide</a><a href="https://else.example.com/">' in one.html
    assert '<img src="/m/d/i.png" srcset="/m/d/i.png 2x, /no.png"' in one.html and "url('/m/d/i.png')" in one.html
    assert one.html.index(f'id="{site.RUNTIME_ID}"') < one.html.index("</head>") and f'<script src="/m/{site.RUNTIME_PATH}"' in one.html
    late = site.build(source, site.bindings(seg, tr.where(F.col("segment_id") != ids[0])), "de", **(args | {"plans": site.page_plans(seg, tr.withColumn("status", F.when(F.col("segment_id") == ids[0], "stale").otherwise(F.col("status"))))})).collect()[0]
    assert "<p>Run <code>a</code> then" in late.html and late.missing == 3
    assert sum(r.conflict_count for r in conflicts.collect()) == 0

    document = dom.parse("<p>Guide</p><pre>Guide</pre><img alt='Pic'>")
    assert site.replay(document, [tuple(r)[1:] for r in entries.collect()]) == (1, 1) and "<pre>Guide</pre>" in dom.serialise(document)


@pytest.mark.parametrize(("raw", "want"), [
    ("../a/./b/%2e%2E/c d?x y#é", "https://h.example.com/a/c%20d?x%20y#%C3%A9"), ("//Ü.example.com:443/", "https://xn--tda.example.com/"), ("HTTP://h:80", "http://h/"), ("https:x", "https://h.example.com/p/x"), ("\\\\k/a", "https://k/a"),
    ("?q=1", "https://h.example.com/p/q?q=1"), ("", "https://h.example.com/p/q?z"), ("/ä'`{}", "https://h.example.com/%C3%A4'%60%7B%7D"), ("http://0x7f.1/", "http://127.0.0.1/"), (" \n/x\ty ", "https://h.example.com/xy"), ("http://a@b:c@h/", "http://a%40b:c@h/"),
])
def test_addresses(raw, want):
    assert str(weburl.parse(raw, weburl.parse("https://h.example.com/p/q?z"))) == want


@pytest.mark.parametrize("raw", ["http://[", "http://a b/", "http://h:99999/", "http://", "http://256.1.1.1/", "http://%/"])
def test_no_addresses(raw):
    with pytest.raises(weburl.Invalid):
        weburl.parse(raw)


def test_canonical_addresses():
    assert weburl.parse("https://h.example.com/a//?q#f").canonical() == "https://h.example.com/a?q" and weburl.parse("https://h.example.com").canonical() == "https://h.example.com/"
    assert weburl.parse("mailto:a@b") is None and weburl.same_origin("https://a.example.com:443/x", "https://A.example.com") and not weburl.same_origin("http://[", "http://a")


def test_stream_of_pages_and_of_progress(spark, tmp_path):
    given = pages(spark, PAGE)
    given.write.parquet(str(tmp_path / "in"))
    known = site.segments(given).where("ord < 2").selectExpr("segment_id", "source_hash", "'accepted' AS status")
    known.write.parquet(str(tmp_path / "known"))
    stream = spark.readStream.schema(given.schema).parquet(str(tmp_path / "in"))
    incremental.pending_stream(stream, str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == site.segments(given).where("ord >= 2").count()

    events = table(spark, SF, "events")
    live = incremental.progress(spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*"))
    live.writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(spark.table("progress").collect()) == sorted(incremental.progress(events).collect())
