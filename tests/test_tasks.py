"""Verification, apply, tasks, chunks, progress and completions on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import apply, chunks, site, state, tasks, verify
from palimpsest.sources import completion
from palimpsest.streaming import progress

REF = "array<struct<segment_id:string,source_hash:string>>"
CODES = "array<struct<text:string,dom_path:string>>"
MAPPING = f"task_id string, pos int, id string, kind string, segments {REF}, codes {CODES}, slots array<int>"
ITEMS = [("t", 0, "1", "- Hello {x} the cat"), ("t", 1, "2", "Use `a` and `a` or ``b`c``"), ("t", 2, "3", "**bold** text")]
MAPPED = [
    ("t", 0, "1", "segment", [("s1", "h1")], [], []), ("t", 1, "2", "inline-code", [("s2", "h2"), ("s3", "h3"), ("s4", "h4")], [("a", "p/code[1]"), ("a", "p/code[3]"), ("b`c", "p/code[5]")], [0, 1, 2]),
    ("t", 2, "3", "segment", [("s5", "h5")], [], []),
]
SEGMENTS = [(f"s{k}", f"h{k}", f"r{k}") for k in range(1, 6)]
GOOD = [("t", 0, "1", "- Hallo {x} die Katze"), ("t", 1, "2", "``b`c`` oder `a` und `a`."), ("t", 2, "3", "**fetter** Text")]


def tables(spark, answers, items=ITEMS, mapped=MAPPED, segments=SEGMENTS, named="t"):
    return {
        "task_items": spark.createDataFrame(items, "task_id string, pos int, id string, text string"), "mapping": spark.createDataFrame(mapped, MAPPING),
        "results": spark.createDataFrame([("t", named)], "task_id string, named_id string"), "result_items": spark.createDataFrame(answers, "task_id string, pos int, id string, translated_text string"),
        "segments": spark.createDataFrame(segments, "segment_id string, source_hash string, reuse_key string"),
    }


def codes(df):
    return sorted((r.code, r.json_path) for r in df.collect())


@pytest.mark.parametrize(("answers", "change", "want"), [
    (GOOD, {}, []),
    ([("t", 0, "1", "Hallo {y} die Katze"), GOOD[1], ("t", 2, "3", " ")], {}, [("list_marker_mismatch", 0), ("markup_structure_mismatch", 2), ("placeholder_mismatch", 0), ("translation_empty", 2)]),
    ([GOOD[0], ("t", 1, "2", "`a` ``b`c``"), GOOD[2]], {}, [("inline_code_mismatch", 1)]),
    ([GOOD[0], ("t", 1, "2", "`a` `a` ``b`c"), GOOD[2]], {}, [("inline_code_mismatch", 1)]),
    ([("t", 0, "2", "x `a` `a` ``b`c``"), ("t", 1, "2", GOOD[1][3])], {}, [("id_duplicate", 1), ("id_missing", None), ("id_out_of_order", 0), ("translation_count_mismatch", None)]),
    ([*GOOD, ("t", 3, "9", "y")], {}, [("id_unknown", None), ("translation_count_mismatch", None), ("translation_id_unknown", 3)]),
    (GOOD, {"named": "other"}, [("task_id_mismatch", "$.taskId")]),
    (GOOD, {"segments": SEGMENTS[1:4] + [("s5", "new", "r")]}, [("task_segment_missing", "$.content[0]"), ("task_stale", "$.content[2]")]),
    (GOOD, {"mapped": MAPPED[:2]}, [("mapping_item_count_mismatch", "$.content"), ("translation_id_unknown", 2)]),
])
def test_errors(spark, answers, change, want):
    t = tables(spark, answers, **change)
    found = codes(verify.errors(**t))
    place = lambda c, at: at if isinstance(at, str) else "$.translations" if at is None else f"$.translations[{at}]" + (".id" if c.startswith("id_") or c == "translation_id_unknown" else ".translatedText")
    assert found == sorted((c, place(c, at)) for c, at in want)


def test_glossary_warnings_and_report(spark):
    t = tables(spark, [GOOD[0], GOOD[1], ("t", 2, "3", "**Bold** text")])
    errors = verify.errors(**t, glossary=(("the", "der"), ("cat", "Katze"), (" ", "x"), ("dog", "Hund")))
    assert codes(errors) == [("glossary_target_missing", "$.translations[0].translatedText")]
    warned = verify.warnings(t["task_items"], t["result_items"])
    assert codes(warned) == [("translation_suspiciously_identical", "$.translations[2].translatedText")]
    r = verify.report(t["results"], errors, warned).first()
    assert (r.ok, r.error_count, r.warning_count) == (False, 1, 1) and r.headline.startswith("[glossary_target_missing]") and r.sample == [r.headline]


def test_mapping_rules(spark):
    bad = [("t", 0, "1", "inline-code", [("a", "b"), ("c", "d")], [("x", "p")], [1, 0]), ("t", 1, "1", "inline-code", [("a", "b")], [("x", "p")], [2, 3])]
    assert [c for c, _ in codes(verify.mapping_issues(spark.createDataFrame(bad, MAPPING)))] == ["id_duplicate", "slot_count_mismatch", "slot_out_of_range", "slots_not_increasing"]
    assert verify.mapping_issues(spark.createDataFrame(MAPPED, MAPPING)).count() == 0


def test_parse_issues(spark):
    raw = ['{"taskId": "t", "translations": []}', '{"taskId": 5}', "no", '{"taskId": "t", "translations": "x"}']
    schema = "taskId string, translations array<struct<id:string,translatedText:string>>"
    rows = spark.createDataFrame(list(enumerate(raw)), "k int, r string").select("k", verify.parse_issues(F.col("r"), schema).alias("i")).orderBy("k").collect()
    assert [sorted({(x.code, x.json_path) for x in r.i}) for r in rows] == [[], [("invalid_type", "$.translations")], [("json_invalid", "$")], [("invalid_type", "$.translations")]]


def test_apply(spark):
    t = tables(spark, GOOD)
    results = t["results"].selectExpr("task_id", "'b.json' AS file", "'openai' AS provider", "'m' AS model", "'2026' AS completed_at")
    rows = apply.updates(t["mapping"], results, t["result_items"], verify.errors(**t), t["segments"], "de")
    old = spark.createDataFrame([("s1", "old", "accepted"), ("s9", "kept", "stale")], "segment_id string, translated_text string, status string")
    got = {r.segment_id: r for r in apply.apply_results(old, rows).collect()}
    assert {k: r.translated_text for k, r in got.items()} == {"s1": "- Hallo {x} die Katze", "s2": " oder ", "s3": " und ", "s4": ".", "s5": "**fetter** Text", "s9": "kept"}
    assert got["s9"].status == "stale" and got["s2"].provider == "openai/m" and got["s2"].updated_at == "2026" and got["s2"].inline_plan == got["s4"].inline_plan
    assert [(p.kind, p.text, p.dom_path) for p in got["s2"].inline_plan.parts] == [("code", "b`c", "p/code[5]"), ("text", " oder ", None), ("code", "a", "p/code[1]"), ("text", " und ", None), ("code", "a", "p/code[3]"), ("text", ".", None)]
    assert [tuple(r) for r in apply.outcome(results, verify.errors(**t), rows).collect()] == [("t", 5, False)]
    bad = tables(spark, [GOOD[0], GOOD[1], ("t", 2, "3", "")])
    assert apply.updates(bad["mapping"], results, bad["result_items"], verify.errors(**bad), bad["segments"], "de").count() == 0


def test_the_last_file_holds(spark):
    t = tables(spark, GOOD)
    two = lambda df: df.unionByName(df.withColumn("task_id", F.lit("u")))
    results = spark.createDataFrame([("t", "b.json", "p", "m", "1"), ("u", "a.json", "p", "m", "2")], "task_id string, file string, provider string, model string, completed_at string")
    answers = two(t["result_items"]).withColumn("translated_text", F.when((F.col("task_id") == "u") & (F.col("id") == "1"), "- Hallo {x} du").otherwise(F.col("translated_text")))
    none = spark.createDataFrame([], "task_id string")
    rows = apply.updates(two(t["mapping"]), results, answers, none, t["segments"], "de")
    state_ = spark.createDataFrame([], "segment_id string, translated_text string")
    assert {r.segment_id: r.translated_text for r in apply.apply_results(state_, rows).collect()}["s1"] == "- Hallo {x} die Katze"


def test_inline_translations_do_not_carry(spark):
    seg = spark.createDataFrame([("n1", "k", "h"), ("n2", "k2", "h2")], "segment_id string, reuse_key string, source_hash string")
    tr = spark.createDataFrame([("o1", "k", "T", "h", "accepted", "1", "plan"), ("o2", "k2", "U", "h2", "stale", "2", None)], "segment_id string, reuse_key string, translated_text string, source_hash string, status string, updated_at string, inline_plan string")
    assert [(r.segment_id, r.translated_text) for r in state.carry_forward(tr, seg).collect()] == [("n2", "U")]


def test_plan_and_reconcile(spark):
    url = "https://docs.example.com/a"
    html = "<title>T</title><p>One <code>x</code> two</p><p title='tip'>Three</p><p>Four</p>"
    source = spark.createDataFrame([(url, html), (url + "b", "<p>z</p>")], "url string, html string")
    units, seg = site.units(source), site.segments(source)
    keep = seg.where("normalized_text IN ('two', 'tip', 'z')")
    plan = tasks.planned(units, keep).cache()
    one = plan.where(F.col("page_url") == url).first()
    assert [(c.id, c.text, c.note) for c in one.content] == [("1", "One `x` two", None), ("2", "tip", "<p> @title")] and one.title == "T"
    assert [(i.kind, len(i.segments), list(i.slots)) for i in one["items"]] == [("inline-code", 2, [0, 1]), ("segment", 1, [])]
    old = plan.where(F.col("page_url") == url).withColumns({"task_id": F.lit("t1"), "source_url": F.lit("s"), "target_locale": F.lit("de"), "readable": F.lit(True)})
    both = old.withColumn("file", F.lit("b")).unionByName(old.withColumn("file", F.lit("a"))).unionByName(old.withColumns({"file": F.lit("c"), "readable": F.lit(False), "page_url": F.lit(None).cast("string")}))
    kept, gone, new = tasks.reconcile(both, plan, "s", "de")
    assert [r.file for r in kept.collect()] == ["a"] and sorted(r.file for r in gone.collect()) == ["b", "c"] and [r.page_url for r in new.collect()] == [url + "b"]
    assert tasks.reconcile(both, plan, "s", "fr")[0].count() == 0


def test_manifest(spark):
    page = "task_id string, page_url string, title string, content_count int, readable boolean"
    pending = spark.createDataFrame([("a", "u2", None, 1, True), ("b", "u1", "B", 2, True), ("c", "u3", None, 1, False), ("d", "u4", None, 3, True)], page)
    results = spark.createDataFrame([("b", True, "now", "p", "m"), ("d", False, None, None, None)], "task_id string, readable boolean, completed_at string, provider string, model string")
    applied = spark.createDataFrame([("a", "u0", None, 9, True, True), ("e", "u5", None, 1, True, True), ("f", "u6", None, 1, True, None)], page + ", result_readable boolean")
    checked = spark.createDataFrame([("b", "now", False, 2)], "task_id string, checked_at string, ok boolean, error_count int")
    failed = spark.createDataFrame([("a", "now", "late")], "task_id string, failed_at string, message string")
    gone = spark.createDataFrame([("a",), ("g",)], "task_id string")
    entries = tasks.manifest(pending, results, applied, checked, failed, gone).cache()
    assert [(r.task_id, r.status) for r in tasks.in_order(entries).collect()] == [("a", "pending"), ("b", "done"), ("e", "applied"), ("g", "invalid"), ("c", "invalid"), ("d", "invalid"), ("f", "invalid")]
    assert tuple(tasks.summary(entries).first()) == (7, 1, 1, 1, 4)
    assert [r.line for r in tasks.board(entries).collect()][:2] == ["- [ ] a | pending | 1 items | u2 | last run failed: late", "- [x] b | done | 2 items | B | u1 | verify fail (2 errors)"]


def test_chunk_views_drafts_and_retries(spark):
    items = spark.createDataFrame([("t", k, str(k + 1), f"text {k}") for k in range(5)], "task_id string, pos int, id string, text string")
    plans = spark.createDataFrame([("t", 1, 1, 2), ("t", 2, 3, 5)], "task_id string, chunk_index int, item_start int, item_end int")
    view = chunks.views(plans, items).cache()
    assert sorted((r.chunk_index, r.k, r.id) for r in view.collect()) == [(1, 0, "1"), (1, 1, "2"), (2, 0, "3"), (2, 1, "4"), (2, 2, "5")]
    drafts = view.select("task_id", "chunk_index", "k", "id", F.upper("text").alias("translated_text"))
    merged, faults = chunks.merge_drafts(drafts, view)
    assert faults.count() == 0 and [r.id for r in merged.orderBy("pos").collect()] == list("12345")
    for broken, code in ((drafts.where("chunk_index = 1"), "draft_missing"), (drafts.where("chunk_index = 1 OR k < 2"), "draft_count_mismatch"), (drafts.withColumn("id", F.when(F.col("k") == 2, "9").otherwise(F.col("id"))), "draft_id_mismatch")):
        merged, faults = chunks.merge_drafts(broken, view)
        assert [tuple(r) for r in faults.collect()] == [("t", 2, code)] and merged.count() == 0
    issues = spark.createDataFrame([("t", "translation_empty", "$.translations[1].translatedText", "m"), ("t", "id_missing", "$.translations", 'Missing translation ids "3", "5"'), ("t", "task_id_mismatch", "$.taskId", "x")], "task_id string, code string, json_path string, message string")
    previous = spark.createDataFrame([("t", 1, "2", "")], "task_id string, pos int, id string, translated_text string")
    told = {r.id: (r.text, r.codes) for r in chunks.retry_context(issues, previous, items).collect()}
    assert told == {"2": ("text 1", ["translation_empty"]), "3": ("text 2", ["id_missing"]), "5": ("text 4", ["id_missing"]), None: (None, ["task_id_mismatch"])}
    waves = {(r.task_id, r.chunk_index): r.wave for r in chunks.dispatch(plans.unionByName(plans.withColumn("task_id", F.lit("u"))), 2).collect()}
    assert waves == {("t", 1): 0, ("u", 1): 0, ("t", 2): 1, ("u", 2): 1}


def test_headings_of_items(spark):
    items = spark.createDataFrame([("t", 0, "1", " Setup "), ("t", 1, "2", "body")], "task_id string, pos int, id string, text string")
    mapping = spark.createDataFrame([("t", 0, "1", "segment", [("s1", "h")], [], []), ("t", 1, "2", "segment", [("s2", "h")], [], [])], MAPPING)
    seg = spark.createDataFrame([("s1", "h2"), ("s2", "p")], "segment_id string, tag_name string")
    assert [tuple(r)[1:] for r in chunks.described(items, mapping, seg).orderBy("pos").collect()] == [(0, 5, "Setup"), (1, 4, None)]


def test_large_tasks_stream(spark):
    rng = random.Random(1)
    rows = [(f"t{t}", k, rng.randint(1, 60), rng.choice([None, None, "", "H"])) for t in range(40) for k in range(rng.choice([1, 3, 60]))]
    limits = chunks.Limits(10, 200, 300)
    got = chunks.chunk_plan(spark.createDataFrame(rows, "task string, pos int, chars int, heading string"), "task", "pos", "chars", "heading", limits).collect()
    for t in {r[0] for r in rows}:
        want = chunks.plan([(p, c, h) for n, p, c, h in rows if n == t], limits)
        assert sorted((r.chunk_index, r.item_start, r.item_end, r.heading) for r in got if r.task == t) == [(k, *w) for k, w in enumerate(want, 1)]


def run_events(seed, runs=6, n=60):
    rng = random.Random(seed)
    kinds = ["queued", "started", "attempt", "attempt", "attemptCompleted", "completed", "failed"]
    return [(f"r{r}", k, rng.choice(kinds if k else ["queued"]), k * 100 + rng.randint(0, 99), f"t{rng.randint(0, 3)}", rng.choice([None, "x", "y"]), rng.randint(5, 9), rng.randint(0, 5), rng.randint(0, 4), rng.randint(0, 4)) for r in range(runs) for k in range(n)]


EVENT = "run_id string, seq long, type string, at long, task_id string, activity_id string, total int, completed int, success_count int, failure_count int"


def test_progress_table_stream_and_fold(spark, tmp_path):
    rows = run_events(2)
    rows = [(*r[:5], f"{r[4]}{r[5]}" if r[5] else None, *r[6:]) for r in rows]
    names = [c.split()[0] for c in EVENT.split(", ")]
    want = {}
    for run in {r[0] for r in rows}:
        held = {}
        for r in rows:
            if r[0] == run:
                held = progress.fold(held, dict(zip(names, r, strict=True)))
        want[run] = progress.shown(run, held)
    events = spark.createDataFrame(rows, EVENT)
    rounded = lambda rs: {r[0]: tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rs}
    assert rounded(progress.run_state(events).collect()) == rounded(want.values())
    for k in range(3):
        events.where(f"seq % 60 >= {20 * k} AND seq % 60 < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = progress.run_stream(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    live.writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    last = {}
    for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.batch):
        last[r.run_id] = tuple(r)[:-1]
    files = {r.seq // 20 for r in events.collect()}
    assert files == {0, 1, 2} and set(last) == set(want)


def test_run_summary(spark):
    rows = [("a", 0, 1, False), ("a", 0, 2, True), ("a", 1, 1, True), ("b", 0, 1, False), ("b", 0, 3, False), ("b", 1, 1, True)]
    assert tuple(tasks.run_summary(spark.createDataFrame(rows, "task_id string, chunk int, attempt int, ok boolean")).first()) == (2, 1, 1, 3)


POINT = completion.Endpoint("m")


def test_completion_falls_back():
    seen = []

    def grumpy(endpoint, payload):
        seen.append((payload["stream"], "response_format" in payload))
        if payload["stream"]:
            raise completion.Refused("Streaming isn't supported", 400)
        if "response_format" in payload:
            raise completion.Refused("response_format json_object unknown", 400)
        assert payload["messages"][0]["content"].endswith("Return valid JSON only.")
        yield {"choices": [{"message": {"content": [{"text": '{"a"'}, {"text": ": 1}"}]}}]}

    assert completion.complete(POINT, grumpy, "s", "u") == '{"a": 1}' and seen == [(True, True), (False, True), (False, False)]
    streamed = lambda e, p: iter([{"choices": [{"delta": {"content": c}}]} for c in ('{"sta', 'tus":', None, '"ok"}')])
    assert completion.probe(POINT, streamed) == (True, "Connected to openai/m")
    with pytest.raises(completion.Refused, match="empty"):
        completion.complete(POINT, lambda e, p: iter([{"choices": []}]), "s", "u")
    assert completion.probe(POINT, lambda e, p: iter([{"choices": [{"delta": {"content": "hi"}}]}]))[0] is False


def test_drafts_from_prompts(spark):
    def echo(endpoint, payload):
        import json

        prompt = payload["messages"][1]["content"]
        if "zap" in prompt:
            raise completion.Refused("busy", 503)
        task = json.loads(prompt.split("Task:\n")[1].split("\n\n")[0])
        answer = json.dumps({"taskId": task["task_id"], "translations": [{"id": c["id"], "translatedText": c["text"].upper()} for c in task["content"]]})
        yield {"choices": [{"delta": {"content": f"<think>hm</think>```json\n{answer}\n```"}}]}

    content = "array<struct<id:string,text:string>>"
    given = spark.createDataFrame([("t", 1, 2, "H", "de", [("1", "use `x` {y}"), ("2", "b")]), ("u", 1, 1, None, "de", [("1", "zap")])], f"task_id string, chunk_index int, chunk_count int, heading string, target_locale string, content {content}")
    asked = completion.prompts(given)
    first = asked.where("task_id = 't'").first().prompt
    assert "one part of a page" in first and '"placeholders":["{y}"]' in first and "one part" not in asked.where("task_id = 'u'").first().prompt
    drafts = completion.drafts(asked, POINT, echo)
    assert [(r.named_id, r.k, r.translated_text) for r in completion.draft_items(drafts).orderBy("k").collect()] == [("t", 0, "USE `X` {Y}"), ("t", 1, "B")]
    assert drafts.where("task_id = 'u'").first().error == "busy"
    retry = spark.createDataFrame([("u", 1, "old", ["translation_empty"])], "task_id string, chunk_index int, previous string, issues array<string>")
    assert "to be mended" in completion.prompts(given, retry).where("task_id = 'u'").first().prompt


def test_content_is_joined_once(spark):
    t = tables(spark, GOOD)
    found = verify.content_issues(t["task_items"], t["mapping"], t["result_items"], (("cat", "Katze"),))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert verify.failing(**t).count() == 0
