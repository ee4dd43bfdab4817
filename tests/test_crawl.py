"""Crawls over a table of answers, robots, retries, and the sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import crawl
from palimpsest.plans import store
from palimpsest.sources import files, tables

O = "https://docs.example.com"
TRIES = "url string, attempt int, status int, code string, message string, content_type string, body string"


def page(*refs):
    return "".join(f'<a href="{r}">x</a>' if not r.endswith(".png") else f'<img src="{r}">' for r in refs)


def test_robots():
    text = "User-agent: a\nUser-agent: mirror-bot\nDisallow: /x # why\nAllow: /x/y\n\nUser-agent: *\nDisallow: /\n\nUser-agent: mirror\nDisallow: /m"
    assert crawl.robots_rules(text, "mirror-bot/2.0") == [(False, "/x"), (True, "/x/y")]
    assert crawl.robots_rules(text, "mirrorx") == [(False, "/m")] and crawl.robots_rules(text, "other") == [(False, "/")] and crawl.robots_rules("", "a") == []


@pytest.mark.parametrize(("path", "allowed"), [("/", True), ("/x", False), ("/x/y/z", True), ("/a.php", False), ("/a.php?q", True), ("/p/1/q", False), ("/same", True)])
def test_allowed(spark, path, allowed):
    rules = [(False, "/x"), (True, "/x/y"), (False, "/*.php$"), (False, "/p/*/q"), (False, "/same"), (True, "/same")]
    assert spark.range(1).select(crawl.allowed_by(rules, F.lit(path)).alias("a")).first().a is allowed


def test_settle(spark):
    rows = [("a", 0, 503, None, None, None, "x"), ("a", 1, 200, None, None, "text/html", "y"), ("a", 2, 200, None, None, None, "z"), ("b", 0, None, "ETIMEDOUT", "m", None, None), ("b", 1, None, "ECONNRESET", "timeout", None, None), ("b", 2, None, "ECONNRESET", "m", None, None), ("b", 3, 200, None, None, None, "late"), ("c", 0, 404, None, None, None, "")]
    got = {r.url: (r.attempt_count, r.timeouts, r.status, r.body) for r in crawl.settle(spark.createDataFrame(rows, TRIES), 2).collect()}
    assert got == {"a": (2, 0, 200, "y"), "b": (3, 2, None, None), "c": (1, 0, 404, "")}


def test_crawl(spark):
    store.workdir(spark)
    ok = lambda u, body, kind="text/html", status=200: (O + u, 0, status, None, None, kind, body)
    rows = [
        ok("/", page("/a/", "/b?x=1#f", "/skip/c", "https://else.example.com/", "http://[", "/no", "/doc.pdf", "/i.png", "mailto:x@y")), ok("/a", page("/", "/deep", "/i.png")), ok("/b?x=1", page()),
        ok("/deep", page("/deeper", "https://else.example.com/e.png")), ok("/deeper", ""), ok("/skip/c", page("/hidden")), ok("/no", "", status=404), ok("/doc.pdf", "%PDF", "application/pdf"), ok("/i.png", "PNG", None), ok("/robot", page()),
    ]
    rows += [(O + "/deeper2", k, 503, None, None, None, None) for k in range(3)]
    got = crawl.crawl(spark.createDataFrame(rows, TRIES), crawl.Site(O + "/", entries=(O, O + "/skip/e", "https://else.example.com/x"), exclude=("/skip/",)), [(False, "/deeper")])
    assert sorted((r.url.removeprefix(O), r.depth, r.discovered_from and r.discovered_from.removeprefix(O)) for r in got["pages"].collect()) == [("/", 0, None), ("/a", 1, "/"), ("/b?x=1", 1, "/"), ("/deep", 2, "/a")]
    assert sorted((r.url.removeprefix(O), r.content_type) for r in got["assets"].collect()) == [("/doc.pdf", "application/pdf"), ("/i.png", "image/png")]
    issues = [(r.kind, r.url.removeprefix(O), r.status, r.attempt_count) for r in crawl.in_order(got["issues"]).collect()]
    assert issues == [("invalid-link", "/", None, None), ("page-fetch", "/no", 404, 1), ("page-fetch", "/skip/e", None, 3)]
    s = got["stats"].first()
    assert (s.page_failures, s.asset_failures, s.invalid_links, s.skipped_by_robots, s.retried_requests, s.timed_out_requests) == (2, 0, 1, 1, 0, 0)
    assert crawl.fatal(got["stats"], got["pages"], got["assets"]).first().fatal is False
    none = crawl.crawl(spark.createDataFrame([], TRIES), crawl.Site(O + "/"))
    assert none["pages"].count() == 0 and none["issues"].count() == 1 and crawl.fatal(none["stats"], none["pages"], none["assets"]).first().fatal is True


def test_tables(spark, tmp_path):
    lines = tmp_path / "t.jsonl"
    lines.write_text('{"segment_id":"a","status":"draft","extra":1}\n{"segment_id":"b","status":"accepted"}\n')
    assert [(r.segment_id, r.status) for r in tables.scan(spark, str(lines), "translations").collect()] == [("a", "draft"), ("b", "accepted")]
    lines.write_text('{"segment_id":"a","status":"odd"}\n')
    with pytest.raises(Exception, match="can't be odd"):
        tables.scan(spark, str(lines), "translations").collect()
    lines.write_text('{"status":"draft"}\n')
    with pytest.raises(Exception, match="without segment_id"):
        tables.scan(spark, str(lines), "translations").collect()
    assert tables.scan(spark, str(tmp_path / "none.json"), "config", single=True).count() == 0


def test_task_files(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/task_b.json").write_text(json.dumps({"task_id": "task_b", "content": [{"id": "1", "text": "x"}, {"id": "2", "text": "y"}]}, indent=2))
    (tmp_path / "p/task_a.json").write_text("broken {")
    assert [f.rsplit("/", 1)[1] for f in tables.files(spark, str(tmp_path / "p"))] == ["task_a.json", "task_b.json"] and tables.files(spark, str(tmp_path / "none")) == []
    rows = {r.named_id: r for r in tables.documents(spark, str(tmp_path / "p"), "tasks").collect()}
    assert rows["task_b"].readable and not rows["task_a"].readable and rows["task_b"].r.content[1].text == "y"
    assert tables.documents(spark, str(tmp_path / "none"), "tasks").count() == 0
    items = tables.exploded_items(tables.documents(spark, str(tmp_path / "p"), "tasks").where("readable").select("r.*"), "content")
    assert [tuple(r)[:4] for r in items.orderBy("pos").collect()] == [("task_b", 0, "1", "x"), ("task_b", 1, "2", "y")]
    pending, applied = (spark.createDataFrame(r, "task_id string, v string") for r in ([("a", "p")], [("a", "q"), ("b", "q")]))
    assert sorted(map(tuple, tables.preferred(pending, applied).collect())) == [("a", "p"), ("b", "q")]


def test_env(spark):
    body = ["# c", "A=1 # one", "export B = 'x # y' # z", 'C="a\\n\\"b\\""', "bad line", "D=", "E=x#y"]
    got = {r.key: r.value for r in tables.env_pairs(spark.createDataFrame([(x,) for x in body], "value string")).collect()}
    assert got == {"A": "1", "B": "x # y", "C": 'a\n"b"', "D": "", "E": "x#y"}
    assert tables.env_value({"K": " f "}, {"K": "p"}, "K") == "f" and tables.env_value({"K": ""}, {"K": "p"}, "K") == "p"
    with pytest.raises(KeyError):
        tables.env_value({}, {}, "K")
    assert files.upsert_env("# c\n export A=1\nB=2\nA=3\n", "A", "x y") == '# c\n export A="x y"\nB=2\n' and files.upsert_env(None, "A", "1") == "A=1\n"
    assert files.upsert_line("a\n.env", ".env") == "a\n.env\n" and files.upsert_line(None, ".env") == ".env\n"


def test_site_and_json_files(spark, tmp_path):
    out = tmp_path / "site"
    out.mkdir()
    (out / "old.html").write_text("old")
    pages = spark.createDataFrame([("index.html", "<p>é</p>", True), ("g/x/index.html", "", False)], "output_path string, html string, replayed boolean")
    assets = spark.createDataFrame([("a/i.png", bytearray(b"\x89P"))], "output_path string, body binary")
    assert tuple(files.write_site(pages, str(out), assets, ("_mirror/r.js", "js")).first()) == (2, 2)
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()) == ["_mirror/r.js", "a/i.png", "g/x/index.html", "index.html"]
    assert (out / "index.html").read_text() == "<p>é</p>" and (out / "a/i.png").read_bytes() == b"\x89P"
    with pytest.raises(Exception, match="leaves the folder"):
        files.write_files(spark.createDataFrame([("../x", "y")], "output_path string, content string"), str(out)).collect()

    path = str(tmp_path / "c.json")
    assert files.scaffold(spark, path, {"a": 1, "b": {"c": 2}}) and not files.scaffold(spark, path, {"a": 9})
    assert files.read_text(spark, path) == '{\n  "a": 1,\n  "b": {\n    "c": 2\n  }\n}\n'
    assert files.scaffold(spark, path, {"a": 9, "b": {"d": 3}}, merge=True) and json.loads(files.read_text(spark, path)) == {"a": 1, "b": {"c": 2, "d": 3}}
    assert files.archive(spark, path, str(tmp_path / "applied/c.json"), str(tmp_path / "history/c-1.json")) and files.read_text(spark, path) is None
    assert files.read_text(spark, str(tmp_path / "applied/c.json")) == files.read_text(spark, str(tmp_path / "history/c-1.json")) is not None
    assert not files.archive(spark, path, str(tmp_path / "x"), str(tmp_path / "y")) and files.remove(spark, str(tmp_path / "applied/c.json"), path) == 1


def test_state_is_stored_once(spark, tmp_path):
    source, made = str(tmp_path / "in"), []

    def make():
        made.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    assert store.stored(spark, "t", [source], make).count() == store.stored(spark, "t", [source], make).count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert store.stored(spark, "t", [source], make).count() == 5 and len(made) == 2
