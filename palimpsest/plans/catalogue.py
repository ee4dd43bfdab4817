"""The engine's registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import markup as M
from palimpsest.functions import text as T
from palimpsest.functions import urls as U
from palimpsest.operators import apply, chunks, crawl, site, state, tasks, verify
from palimpsest.plans.oracles import SITE, oracle_sql  # noqa: F401
from palimpsest.plans.store import stored, workdir
from palimpsest.session import table
from palimpsest.streaming import incremental, progress

FLAGSHIP = "pending"
NOW = "2026-01-01T00:00:00.000Z"
GLOSSARY = (("and", "und"), ("the", "das"), ("a", "ein"))
ORIGIN = "https://docs.example.com"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-blank line of a document as a text segment of a page, p-th of n from 0. Nothing is shuffled or written."""
    documents = table(spark, sf_dir, "documents")
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("source_text"))), lambda s: s["source_text"].rlike(T.WHITE.replace("[", "[^", 1)))
    texts = documents.select("doc_id", kept.alias("kept"))
    if not documents.groupBy("doc_id").count().where("count > 1").isEmpty():  # documents of one id are one page
        texts = texts.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("kept"))).alias("kept"))
    each = texts.select("doc_id", F.size("kept").alias("n"), F.posexplode_outer("kept").alias("p", "s")).where("p IS NOT NULL")
    url, dom = F.concat(F.lit(SITE), F.col("doc_id").cast("string")), F.concat(F.lit("root[0]/p["), F.col("s.pos").cast("string"), F.lit("]/#text[0]"))
    seg = each.select("doc_id", "s.pos", "p", "n", url.alias("page_url"), dom.alias("dom_path"), "s.source_text", T.normalize(F.col("s.source_text")).alias("norm"))
    none = F.lit("")
    return seg.withColumns({
        "segment_id": T.sha(F.col("page_url"), F.col("dom_path"), F.lit("text"), none),
        "reuse_key": T.sha(F.col("page_url"), F.lit("text"), none, F.lit("p"), none, F.col("norm")),
        "source_hash": F.sha2("norm", 256), "task_id": tasks.task_id("page_url"),
    })


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines written once: the state that extraction leaves."""
    return stored(spark, "segments", [f"{sf_dir}/documents.parquet"], lambda: lines(spark, sf_dir))


def translations(spark: SparkSession, sf_dir: str, moved: bool = False) -> DataFrame:
    """Stand-in state: labelled documents are translated; some hashes are old, some ids have moved."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    seg = segments(spark, sf_dir).join(labels, "doc_id")
    ident = F.when(F.col("pos") % 7 == 0, F.sha2(F.concat(F.lit("moved"), "segment_id"), 256)).otherwise(F.col("segment_id")) if moved else F.col("segment_id")
    old = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("x"), "source_hash")).otherwise(F.col("source_hash"))
    status = F.when(F.col("toxic") == 1, "stale").when(F.col("quality") == 1, "accepted").otherwise("draft")
    return seg.select(ident.alias("segment_id"), "reuse_key", F.concat(F.lit("t:"), "norm").alias("translated_text"), (F.col("source_hash") if moved else old).alias("source_hash"), status.alias("status"), F.lit("2025-01-01T00:00:00.000Z").alias("updated_at"))


def bundle_rows(s: DataFrame) -> DataFrame:
    """Lines with the text of their task and its stand-in translation; row by row, so nothing of it is stored."""
    c, lit = F.col, F.lit
    pick = lambda n, table_: F.coalesce(*[F.when(n == k, v) for k, v in table_.items()], c("text"))
    v = c("p") % 12
    s = s.withColumn("text", c("norm"))
    text = pick(v, {
        1: F.concat(lit("- "), "norm"), 2: F.concat(lit("- [x] "), "norm"), 3: F.concat(lit("**"), "norm", lit("** and __b__")), 4: F.concat("norm", lit(" {{name}} %.*f")),
        5: F.concat(lit("Use `a` or ``b`` "), "norm"), 6: F.concat(lit("[l](u) ![i](v) "), "norm"),
    })
    s = s.withColumns({"text": text, "v": v, "id": (c("p") + 1).cast("string")})
    swapped = F.when(c("v") == 5, F.concat(lit("Use ``b`` or `a` "), "norm")).otherwise(F.concat("text", lit(" neu")))
    w = F.when(c("doc_id") % 3 == 0, lit(5)).otherwise((c("doc_id") + c("p")) % 7)
    told = pick(w, {0: F.concat(lit("neu "), "text"), 2: lit(" "), 3: F.regexp_replace("text", r"[{*`\[]", ""), 4: F.concat("text", lit(" neu")), 5: swapped, 6: F.concat("text", lit(" `x"))})
    return s.select("doc_id", "page_url", "task_id", "p", "n", "id", "v", "text", "norm", "segment_id", "source_hash", "reuse_key", told.alias("translated_text"))


def bundles(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Stand-in tasks over all segments, their mappings, and results with faults of every kind in two of three documents."""
    c, lit = F.col, F.lit
    every = bundle_rows(segments(spark, sf_dir))
    fault = lambda m, p: (c("doc_id") % 3 != 0) & (c("doc_id") % m == 0) & (c("p") == p)
    ref = F.array(F.struct(F.when(fault(19, 4), F.concat(lit("gone"), "segment_id")).otherwise(c("segment_id")).alias("segment_id"), F.when(fault(17, 3), F.concat(lit("x"), "source_hash")).otherwise(c("source_hash")).alias("source_hash")))
    code = F.array(*[F.struct(lit(t).alias("text"), lit(f"root[0]/code[{k}]").alias("dom_path")) for k, t in enumerate("ab")])
    inline = c("v") == 5
    mapping = every.where(~fault(13, 2)).select("task_id", c("p").alias("pos"), "id", F.when(inline, "inline-code").otherwise("segment").alias("kind"), ref.alias("segments"), F.when(inline, code).otherwise(F.array_remove(code, code[0])).alias("codes"), F.when(inline, F.array(lit(0))).otherwise(F.array().cast("array<int>")).alias("slots"))
    mapping = mapping.withColumn("codes", F.when(F.col("kind") == "segment", F.slice("codes", 1, 0)).otherwise(F.col("codes")))
    items = every.select("task_id", c("p").alias("pos"), "id", "text")
    lost = (c("doc_id") % 3 != 0) & (c("doc_id") % 7 == 0) & (c("p") == c("n") - 1)
    answers = every.where(~lost).select("task_id", c("p").alias("pos"), F.when(fault(5, 1), lit("1")).otherwise(c("id")).alias("id"), "translated_text")
    heads = every.select("task_id", "doc_id").distinct()
    named = F.when((c("doc_id") % 3 != 0) & (c("doc_id") % 11 == 0), lit("other")).otherwise(c("task_id"))
    results = heads.select("task_id", named.alias("named_id"), F.concat("task_id", lit(".json")).alias("file"), lit("openai").alias("provider"), lit("m").alias("model"), lit(NOW).alias("completed_at"))
    return {"every": every, "items": items, "mapping": mapping, "results": results, "answers": answers, "segments": every.select("segment_id", "source_hash", "reuse_key")}


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in tries of a crawl: each different href of the pages is a url of one site, served with some page's source, now and then failing."""
    c = F.col
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    hrefs = crawl.anchors(pages).select("href").distinct()
    ranked = hrefs.withColumn("r", F.row_number().over(W.orderBy("href")) - 1)  # a summary of the navigation, not the data
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    known = ranked.crossJoin(F.broadcast(n)).withColumn("page_id", (c("r") % c("n")).cast("long")).unionByName(n.select(F.lit("/").alias("href"), F.lit(5).alias("r"), "n", F.lit(0).cast("long").alias("page_id")))
    r = c("r")
    status = F.when(r % 29 == 0, F.lit(None).cast("int")).when(r % 17 == 0, 404).when((r % 23 == 0) | ((r % 19 == 0) & (c("attempt") == 0)), 503).otherwise(200)
    kind = F.when(r % 13 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    body = known.join(pages, "page_id").withColumn("attempt", F.explode(F.array(*map(F.lit, range(3)))))
    return body.select(F.concat(F.lit(ORIGIN), "href").alias("url"), "attempt", status.alias("status"), F.when(r % 29 == 0, "ETIMEDOUT").alias("code"), F.when(r % 29 == 0, "timeout of 15000ms").alias("message"), kind.alias("content_type"), c("html").alias("body"))


def _canonical_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with urls as a crawler asks for them."""
    from palimpsest.functions import weburl

    given = answers(spark, sf_dir)
    names = given.select("url").distinct()

    def plain(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"url": b["url"], "asked": [weburl.parse(u).canonical() for u in b["url"]]})

    return given.join(names.mapInPandas(plain, "url string, asked string"), "url").drop("url").withColumnRenamed("asked", "url")


ROBOTS = "User-agent: *\nDisallow: /d\nAllow: /de\nDisallow: /*ing$\n\nUser-agent: other\nDisallow: /\n"


def _crawl(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    workdir(spark)
    return crawl.crawl(_canonical_answers(spark, sf_dir), crawl.Site(f"{ORIGIN}/", exclude=("/th",)), crawl.robots_rules(ROBOTS, "mirror-bot/1.0"))


def _crawl_pages(spark, d):
    return _crawl(spark, d)["pages"].select("url", "depth", "status", "output_path")


def _crawl_assets(spark, d):
    return _crawl(spark, d)["assets"].select("url", "content_type", "output_path")


def _crawl_issues(spark, d):
    return _crawl(spark, d)["issues"].select("kind", "url", "status", "code", "attempt_count")


def _crawl_stats(spark, d):
    return _crawl(spark, d)["stats"]


def _robots(spark, d):
    pages = table(spark, d, "pages").select("page_id", U.path(F.col("url")).alias("path"))
    rules = crawl.robots_rules("User-agent: *\nDisallow: /e\nAllow: /en/1\nDisallow: /*5$\nDisallow: /fr/*3", "any")
    return pages.select("page_id", crawl.allowed_by(rules, F.col("path")).alias("allowed"))


def _mime(spark, d):
    body = F.when(F.col("event_id") % 5 == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).when(F.col("event_id") % 5 == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.unhex(F.lit("00112233")))
    url = F.concat(F.lit("http://h/a"), F.element_at(F.array(*map(F.lit, (".css", ".PNG", "", ".unheard", "/x.woff2?v=1"))), (F.col("user_id") % 5 + 1).cast("int")))
    said = F.when(F.col("event_type") == "view", "text/html")
    return table(spark, d, "events").select("event_id", crawl.content_type(said, body, url).alias("content_type"))


def _page_manifest(spark, d):
    return crawl.page_manifest(table(spark, d, "pages"))


def _url_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return crawl.included(pages, [r"/en/", r"/de/"], [r"utm_source", r"#top$"])


def _anchors(spark, d):
    return crawl.anchors(table(spark, d, "pages"))


def _dangling(spark, d):
    pages = table(spark, d, "pages")
    known = pages.select(U.canonical(F.col("url")).alias("target")).distinct()
    base = pages.select("page_id", U.origin(F.col("url")).alias("o"))
    links = crawl.anchors(pages).join(base, "page_id").select("page_id", "ord", F.concat("o", "href").alias("target"))
    return links.join(known, "target", "left_anti")


def _public_paths(spark, d):
    return crawl.page_manifest(table(spark, d, "pages")).select("url", U.public_path(F.col("output_path"), "/mirror").alias("public_path"))


def _reachability(spark, d):
    """What the first page reaches by the navigation links that pages share."""
    workdir(spark)
    pages = table(spark, d, "pages").select("page_id", U.canonical(F.col("url")).alias("url"), "html")
    links = crawl.anchors(pages).join(pages.select("page_id", "url"), "page_id").select("url", "href").distinct()
    edges = links.select(F.col("url").alias("src"), F.col("href").alias("dst")).unionByName(links.select(F.col("href").alias("src"), F.col("url").alias("dst")))
    return crawl.reachable(edges, pages.where("page_id = 0").select(F.col("url").alias("node")))


def _mark_stale(spark, d):
    return state.mark_stale(translations(spark, d), segments(spark, d), NOW)


def _carry_forward(spark, d):
    return state.carry_forward(translations(spark, d, moved=True), segments(spark, d))


def _pending(spark, d):
    return state.pending(segments(spark, d), translations(spark, d)).select("segment_id", "page_url", "dom_path", "source_hash")


def _doctor(spark, d):
    return state.doctor(segments(spark, d), translations(spark, d))


def _task_items(spark, d):
    todo = state.pending(segments(spark, d), translations(spark, d))
    return todo.select(tasks.task_id("page_url").alias("task_id"), verify.numbered(todo, "page_url", "pos").alias("id"), F.col("source_text").alias("text"))


def _units(spark, d) -> DataFrame:
    """Segments as units of one member each."""
    one = F.array(F.struct("segment_id", "source_hash"))
    none = F.array().cast("array<struct<text:string,dom_path:string>>")
    return segments(spark, d).select("page_url", F.col("pos").alias("ord"), F.col("source_text").alias("text"), F.lit("T").alias("title"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("attribute_name"), F.lit("p").alias("tag_name"), one.alias("segments"), none.alias("codes"), F.array().cast("array<int>").alias("slots"))


def _task_plan(spark, d):
    plan = tasks.planned(_units(spark, d), state.pending(segments(spark, d), translations(spark, d)))
    last = F.element_at("items", -1)
    return plan.select(tasks.task_id("page_url").alias("task_id"), "n_items", "source_chars", last["id"].alias("last_id"), last["segments"][0]["segment_id"].alias("last_segment"))


def _reconcile(spark, d):
    plan = tasks.planned(_units(spark, d), state.pending(segments(spark, d), translations(spark, d)))
    number = F.regexp_extract("page_url", r"(\d+)$", 1).cast("long")
    old = plan.withColumns({"n": number, "task_id": tasks.task_id("page_url"), "source_url": F.lit(SITE), "target_locale": F.when(number % 5 == 0, "yy").otherwise("xx"), "readable": number % 7 != 0})
    old = old.where("n % 3 <> 0").withColumn("title", F.when(F.col("n") % 11 == 0, "Old").otherwise(F.col("title")))
    old = old.withColumn("file", F.explode(F.when(F.col("n") % 4 == 0, F.array(F.lit("b.json"), F.lit("a.json"))).otherwise(F.array(F.lit("a.json"))))).drop("n", "n_items", "source_chars")
    retained, invalid, created = tasks.reconcile(old, plan, SITE, "xx")
    rows = lambda df, what, file: df.select("page_url", "task_id", file.alias("file"), F.lit(what).alias("outcome"))
    return rows(retained, "retained", F.col("file")).unionByName(rows(invalid, "invalidated", F.col("file"))).unionByName(rows(created, "created", F.lit("")))


def _item_issues(spark, d):
    items = bundle_rows(lines(spark, d)).select("segment_id", "text", "translated_text")
    return verify.item_issues(items, "text", "translated_text").drop("text", "translated_text")


def _errors(spark, d, found=verify.errors) -> tuple[dict[str, DataFrame], DataFrame]:
    b = bundles(spark, d)
    return b, found(b["items"], b["mapping"], b["results"], b["answers"], b["segments"], GLOSSARY)


def _failing(spark, d) -> tuple[dict[str, DataFrame], DataFrame]:
    """The same with only the tasks that have errors, one row each, written once for their two readers."""
    b, found = _errors(spark, d, verify.failing)
    return b, stored(spark, "failing", [f"{d}/documents.parquet"], lambda: found)


def _verify_issues(spark, d):
    return _errors(spark, d)[1].select("task_id", "code", "json_path")


def _verify_report(spark, d):
    b, errors = _errors(spark, d)
    return verify.report(b["results"], errors, verify.warnings(b["items"], b["answers"])).select("task_id", "ok", "error_count", "warning_count", F.coalesce(F.size("sample"), F.lit(0)).alias("sample_lines"))


def _apply_bundle(spark, d):
    b, errors = _failing(spark, d)
    rows = apply.updates(b["mapping"], b["results"], b["answers"], errors, b["segments"], "xx")
    return apply.apply_results(translations(spark, d), rows).select("segment_id", "translated_text", "status", "source_hash", "updated_at", "provider")


def _apply_outcome(spark, d):
    b, errors = _failing(spark, d)
    return apply.outcome(b["results"], errors, apply.updates(b["mapping"], b["results"], b["answers"], errors, b["segments"], "xx"))


def _inline_match(spark, d):
    b = bundles(spark, d)
    plans = apply.inline_plans(b["mapping"], b["answers"])
    return plans.select("task_id", "pos", F.array_join(F.transform("plan.parts", lambda p: F.concat(p["kind"], F.lit(":"), p["text"])), "|").alias("parts"), F.array_join("texts", "|").alias("texts"))


def _placeholders(spark, d):
    given = bundle_rows(lines(spark, d))
    return given.select("segment_id", F.array_join(T.placeholders(F.col("translated_text")), "|").alias("found"), T.without_placeholders(F.col("text"), "_").alias("bare"))


def _list_marker(spark, d):
    marker = F.element_at(F.array(*map(F.lit, ("", "- ", "* [ ] ", "12. ", "1) ", "  + ", "-", "- [X]  ", "- [y] "))), (F.col("p") % 9 + 1).cast("int"))
    return bundle_rows(lines(spark, d)).select("segment_id", T.list_marker(F.concat(marker, "norm")).alias("marker"))


def _identical(spark, d):
    every = bundle_rows(lines(spark, d))
    return every.select("segment_id", T.comparable(F.col("text")).alias("source"), T.comparable(F.col("translated_text")).alias("target"))


def _ordered_ids(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").cast("string").alias("id"))
    found = turns.select("conv_id", "pos", F.when(F.col("conv_id") % 3 == 0, F.lit("0")).when(F.col("conv_id") % 3 == 1, F.concat(F.col("id"), F.lit("x"))).otherwise(F.col("id")).alias("id"))
    return verify.ordered_ids(found, turns, "conv_id")


def _entries(spark, d) -> DataFrame:
    """Stand-in task files: open orders lie pending, filled ones are applied, the rest are both."""
    c, k = F.col, F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").withColumns({"task_id": F.concat(F.lit("task_"), k.cast("string")), "page_url": F.concat(F.lit(SITE), (k % 1000).cast("string")), "title": F.when(k % 2 == 0, F.lit("T")), "content_count": (k % 9).cast("int")})
    base = ["task_id", "page_url", "title", "content_count"]
    pending = o.where("o_orderstatus <> 'F'").select(*base, (k % 31 != 0).alias("readable"))
    applied = o.where("o_orderstatus <> 'O'").select(*base, (k % 37 != 0).alias("readable"), F.when(k % 5 != 0, k % 7 != 0).alias("result_readable"))
    done = o.where("o_orderstatus <> 'F' AND o_orderkey % 3 < 2").select("task_id", (k % 3 == 0).alias("readable"), F.lit(NOW).alias("completed_at"), F.lit("openai").alias("provider"), F.lit("m").alias("model"))
    checked = o.where("o_orderkey % 4 = 0").select("task_id", F.lit(NOW).alias("checked_at"), (k % 8 == 0).alias("ok"), F.when(k % 8 == 0, 0).otherwise((k % 5).cast("int")).alias("error_count"))
    failed = o.where("o_orderkey % 10 = 1").select("task_id", F.lit(NOW).alias("failed_at"), F.lit("no answer").alias("message"))
    gone = o.where("o_orderkey % 50 = 0").select(F.concat("task_id", F.when(k % 100 == 0, F.lit("x")).otherwise(F.lit(""))).alias("task_id"))
    return tasks.manifest(pending, done, applied, checked, failed, gone).select("*", c("status").alias("state"))


def _task_manifest(spark, d):
    return _entries(spark, d).select("task_id", "page_url", "content_count", "status", "completed_at", "last_verify_status", "last_verify_error_count", "last_run_status")


def _manifest_order(spark, d):
    first = tasks.in_order(_entries(spark, d)).limit(50)
    return first.select("task_id", "status", "page_url")


def _manifest_board(spark, d):
    return tasks.board(_entries(spark, d)).select("line")


def _manifest_summary(spark, d):
    return tasks.summary(_entries(spark, d))


def _runtime(spark, d) -> tuple[DataFrame, DataFrame]:
    seg = segments(spark, d).withColumns({"kind": F.when(F.col("pos") % 3 == 0, "attr").otherwise("text"), "attribute_name": F.when(F.col("pos") % 6 == 0, "Title").when(F.col("pos") % 6 == 3, "data-x"), "tag_name": F.when(F.col("pos") % 10 == 9, "CODE").otherwise("p")})
    told = F.when(F.col("segment_id") < "8", F.concat(F.lit("t:"), F.lower("norm"))).otherwise(F.concat(F.lit("u:"), F.lower("norm")))
    tr = segments(spark, d).select("segment_id", "source_hash", F.when(F.col("pos") % 5 == 4, F.col("source_text")).otherwise(told).alias("translated_text"), F.when(F.col("pos") % 7 == 6, "stale").otherwise("accepted").alias("status"))
    return state.runtime_manifest(seg.withColumn("source_text", F.lower(F.regexp_extract("source_text", r"^(\S+)", 1))), tr)


def _runtime_manifest(spark, d):
    return _runtime(spark, d)[0]


def _runtime_conflicts(spark, d):
    return _runtime(spark, d)[1]


def _apply_upsert(spark, d):
    base = translations(spark, d)
    updates = base.where("status = 'draft'").withColumn("status", F.lit("accepted")).withColumn("updated_at", F.lit(NOW))
    return state.upsert(base, updates, "segment_id", "updated_at")


def _run_events(spark, d) -> DataFrame:
    """Stand-in events of runs: users are runs, kinds of events are kinds of progress."""
    c = F.col
    kind = F.create_map(*[F.lit(x) for x in ("signup", "started", "click", "attempt", "view", "attemptCompleted", "purchase", "completed", "error", "failed")])[c("event_type")]
    kind = F.when(c("event_id") % 97 == 0, "queued").otherwise(kind)
    task = F.concat(F.lit("t"), (c("event_id") % 3).cast("string"))
    return table(spark, d, "events").select(c("user_id").cast("string").alias("run_id"), c("event_id").alias("seq"), kind.alias("type"), F.unix_millis(c("ts").cast("timestamp")).alias("at"), task.alias("task_id"), F.when(c("event_id") % 2 == 0, F.concat(task, F.lit("a"))).alias("activity_id"), (c("event_id") % 50 + 10).cast("int").alias("total"), (c("event_id") % 10).cast("int").alias("completed"), (c("event_id") % 7).cast("int").alias("success_count"), (c("event_id") % 4).cast("int").alias("failure_count"))


def _run_state(spark, d):
    return progress.run_state(_run_events(spark, d))


def _run_summary(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("task_id"), (F.col("event_id") % 4).cast("int").alias("chunk"), (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), (F.col("event_type") != "error").alias("ok"))
    return tasks.run_summary(e)


def _progress_metrics(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last_at"))


def _issue_topk(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", "value")
    return e.orderBy(F.col("value").desc_nulls_last(), "event_id").limit(5)


def _issue_sample(spark, d):
    e = table(spark, d, "events").where("event_type = 'error'")
    lines = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("event_id"))).alias("ids"))
    return lines.select("user_id", F.array_join(verify.sampled(F.transform("ids", lambda i: i.cast("string"))), ",").alias("sample"))


def _asset_paths(spark, d):
    url, k = F.col("url"), F.col("page_id") % 4
    other = F.when(k == 0, F.concat(U.origin(url), F.lit(":443/x"))).when(k == 1, F.concat(U.origin(url), F.lit(":80/x"))).when(k == 2, F.concat(F.upper(U.origin(url)), F.lit("/x"))).otherwise(F.concat(U.origin(url), F.lit(".org/x")))
    return table(spark, d, "pages").select("page_id", U.asset_path(url).alias("asset_path"), U.cache_name(url, ".bin").alias("cache_name"), U.same_origin(url, F.regexp_replace(other, "^HTTP", "http")).alias("same"))


def _link_rewrite(spark, d):
    pages = table(spark, d, "pages")
    outgoing = crawl.anchors(pages).join(pages.select("page_id", U.origin(F.col("url")).alias("o")), "page_id").select("page_id", F.concat("o", "href").alias("link"))
    links = outgoing.unionByName(pages.select("page_id", F.col("url").alias("link"))).distinct()
    return crawl.rewritten(links, "link", crawl.page_manifest(pages), "/mirror").select("page_id", "link", "rewritten")


def _varied(options: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (k % len(options) + 1).cast("int"))


SRCSETS = ("/a/# 1x,, /b.png  2x ", "/#.png", " , ", "/a.png 100w,/#.png 200w", "data:image/png;base64,AA# 2x")
STYLES = ("background: url('/i/#.png'), url( \"/j.png\" ), url(var(--x)), url(/k.png)", "color: red", "src: url(/#.woff) format('woff')", "x: url('a b#.png')", "x: url(/a b#.png)")
SPANS = ("Use `#` with ``a`b`` now", "`#``b`", "none #", "open `# here", "````#```` end", "a ``#`` b `c` ``d")
MARKUPS = ("**#** and [a](u) ![i](v) ~~x~~ __#__", "** #** __ #__", "`**#**` [](u) [a]()", "**#\nb** ~~\nx~~", "[a](u)[b](v)![c](w)", "open `**#**")
ANSWERS = ("<think>plan {</think>\n```json\n#\n```", "Here: # done", "#", "```\n#", "{broken #", "no json", "<think a='1'>x</think>#", "[1, 2]")


def _filled(options: tuple[str, ...], k: Column, value: Column) -> Column:
    return F.replace(_varied(options, k), F.lit("#"), value)


def _srcset(spark, d):
    given = _filled(SRCSETS, F.col("p_partkey"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", M.rewrite_srcset(given, lambda u: F.concat(F.lit("/mirror"), u)).alias("srcset"))


def _css_urls(spark, d):
    style = _filled(STYLES, F.col("p_partkey"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(M.css_urls(style), "|").alias("urls"))


def _code_spans(spark, d):
    given = _filled(SPANS, F.col("p_partkey"), F.col("p_brand"))
    found = table(spark, d, "part").select("p_partkey", T.code_spans(given).alias("c"), M.fence(given).alias("fenced"))
    return found.select("p_partkey", F.array_join("c.spans", "|").alias("spans"), F.array_join("c.texts", "|").alias("texts"), "fenced")


def _markup(spark, d):
    given = _filled(MARKUPS, F.col("p_partkey"), F.col("p_name"))
    told = F.when(F.col("p_size") % 2 == 0, given).otherwise(F.replace(given, F.lit("~~"), F.lit("")))
    sign = M.signature(given)
    return table(spark, d, "part").select("p_partkey", *[sign[c].alias(c) for c in M.MARKUP], M.markup_mismatch(given, told).alias("mismatch"))


def _json_repair(spark, d):
    raw = _filled(ANSWERS, F.col("event_id"), F.col("props"))
    return table(spark, d, "events").select("event_id", M.json_object(raw).alias("repaired"))


def _glossary(spark, d):
    terms = (("and", "und"), ("the", "das"), ("a", "ein"), ("DE LA", "neu"), ("Übung", "x"), (" ", "x"))
    seg = segments(spark, d).select("segment_id", "source_text", F.concat(F.lit("neu "), "source_text").alias("target_text"))
    return verify.glossary_issues(seg, "segment_id", "source_text", "target_text", terms)


def _status(spark, d):
    counts = translations(spark, d).agg(F.count(F.lit(1)).alias("translations"), *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "stale", "draft")])
    seg = segments(spark, d).agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("page_url").alias("pages"))
    assets = site.resources(table(spark, d, "pages")).where("kind = 'asset'").agg(F.count_distinct("target").alias("assets"))
    t = _manifest_summary(spark, d)
    return seg.crossJoin(assets).crossJoin(counts).crossJoin(t.select(F.col("pending").alias("pending_tasks"), F.col("done").alias("done_tasks"), F.col("applied").alias("applied_tasks"), F.col("invalid").alias("invalid_tasks")))


def _retries(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 404, 408, 429, 500, 501, 503, 504)]), (F.col("event_id") % 8 + 1).cast("int"))
    header = _varied(("", "3", "2.5", "soon", "Mon, 01 Jan 2024 00:00:30 GMT", "Sun, 31 Dec 2023 00:00:00 GMT"), F.col("event_id"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    tries = table(spark, d, "events").select("event_id", status.alias("status"), header.alias("header")).where(crawl.retryable(F.col("status")))
    return tries.select("event_id", "status", "header", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("attempt")).withColumn("wait_ms", crawl.wait_ms(F.col("attempt"), F.col("header"), now)).drop("header")


def _request_errors(spark, d):
    code = F.nullif(_varied(("", "ECONNRESET", "ETIMEDOUT", "ENOTFOUND"), F.col("event_id")), F.lit(""))
    said = _varied(("socket hang up", "Timeout of x", "  ", "getaddrinfo", "refused"), F.col("event_id"))
    return table(spark, d, "events").select("event_id", crawl.error_text(code, said, 15000).alias("message"), crawl.timed_out(code, said).alias("timed_out"))


def _chunk_plan(spark, d):
    seg = segments(spark, d).select("page_url", "pos", T.utf16_length(T.normalize_ends(F.col("source_text"))).alias("chars"), F.when(F.length("norm") < 40, F.col("norm")).alias("heading"))
    return chunks.chunk_plan(seg, "page_url", "pos", "chars", "heading", chunks.Limits(10, 600, 900))


def _chunk_drafts(spark, d):
    """Faults of chunk drafts made of the tasks' answers, each fourth chunk lost and each fifth with a wrong id."""
    every = bundles(spark, d)["every"]
    items = every.select("task_id", F.col("p").alias("pos"), "id", "translated_text")
    ends = every.groupBy("task_id").agg((F.max("p") + 1).alias("n"))
    plans = ends.select("task_id", F.posexplode(F.sequence(F.lit(1), F.col("n"), F.lit(4))).alias("k", "item_start"), "n").select("task_id", (F.col("k") + 1).alias("chunk_index"), "item_start", F.least(F.col("item_start") + 3, "n").alias("item_end"))
    view = chunks.views(plans, items)
    drafts = view.where("(chunk_index + length(translated_text)) % 4 > 0 OR k > 0").withColumn("id", F.when((F.col("chunk_index") % 5 == 0) & (F.col("k") == 1), F.lit("x")).otherwise(F.col("id")))
    return chunks.merge_drafts(drafts, view)[1]


def _html_segments(spark, d):
    return site.segments(table(spark, d, "pages")).select("page_url", "ord", "segment_id", "reuse_key", "dom_path", "kind", "attribute_name", "normalized_text", "source_hash", "tag_name", "title")


def _segments_h1(spark, d):
    rules = site.Extraction(include=("article > h1",))
    return site.segments(table(spark, d, "pages"), rules).select("page_url", "dom_path", "segment_id", "normalized_text", "source_hash")


def _segments_nav(spark, d):
    rules = site.Extraction(include=("nav li:not(:first-child) a, footer",))
    return site.segments(table(spark, d, "pages"), rules).select("page_url", "dom_path", "normalized_text", "tag_name")


def _html_links(spark, d):
    found = site.resources(table(spark, d, "pages").select("page_id", F.concat(U.origin(F.col("url")), F.lit("/x/y")).alias("url"), "html"))
    return found.where("kind = 'link'").groupBy("page_url").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("target").alias("targets"))


def _html_resources(spark, d):
    return site.resources(table(spark, d, "pages"))


def _html_units(spark, d):
    return site.units(table(spark, d, "pages"))


def _site_build(spark, d):
    """Every page built: translations, links between pages and to what stands for assets, and the data that its scripts replay."""
    pages = table(spark, d, "pages").dropDuplicates(["url"])
    seg = site.segments(pages)
    tr = seg.select("segment_id", "source_hash", F.concat(F.lit("t:"), "normalized_text").alias("translated_text"), F.when(F.col("ord") % 5 > 0, "accepted").otherwise("draft").alias("status"))
    own = pages.select("url", U.origin(F.col("url")).alias("o"), F.explode(F.array(F.lit("/de"), F.lit("/the"), F.lit("/in"))).alias("h")).select(F.concat("o", "h").alias("url")).distinct()
    known = own.select("url", U.output_path(F.col("url")).alias("output_path"))
    built = site.build(pages, site.bindings(seg, tr), "xx", links=site.rewrites(pages, known, base="/mirror"), runtime=state.runtime_manifest(seg, tr)[0], base="/mirror")
    return built.select("page_url", F.sha2("html", 256).alias("html_sha256"), "applied", "missing", "rewritten", "replayed")


def _build_links(spark, d):
    """The references of each page that the build rewrites."""
    pages = table(spark, d, "pages")
    own = pages.select(U.origin(F.col("url")).alias("o"), F.explode(F.array(F.lit("/de"), F.lit("/the"), F.lit("/in"))).alias("h")).select(F.concat("o", "h").alias("url")).distinct()
    links = site.rewrites(pages, own.select("url", U.output_path(F.col("url")).alias("output_path")), base="/mirror")
    return links.select("page_url", "raw", "rewritten")


def _run_progress(spark, d):
    return incremental.progress(table(spark, d, "events"))


def queries() -> dict:
    return {
        "page_manifest": _page_manifest, "url_filter": _url_filter, "link_anchors": _anchors, "dangling_links": _dangling, "public_paths": _public_paths, "reachability": _reachability,
        "mark_stale": _mark_stale, "carry_forward": _carry_forward, "pending": _pending, "doctor": _doctor, "task_items": _task_items, "task_plan": _task_plan, "task_reconcile": _reconcile, "apply_upsert": _apply_upsert,
        "item_issues": _item_issues, "verify_issues": _verify_issues, "verify_report": _verify_report, "apply_bundle": _apply_bundle, "apply_outcome": _apply_outcome, "inline_match": _inline_match,
        "placeholders": _placeholders, "list_marker": _list_marker, "identical": _identical, "ordered_ids": _ordered_ids,
        "task_manifest": _task_manifest, "manifest_order": _manifest_order, "manifest_board": _manifest_board, "manifest_summary": _manifest_summary, "runtime_manifest": _runtime_manifest, "runtime_conflicts": _runtime_conflicts,
        "run_state": _run_state, "run_summary": _run_summary, "progress_metrics": _progress_metrics, "run_progress": _run_progress, "issue_topk": _issue_topk, "issue_sample": _issue_sample,
        "asset_paths": _asset_paths, "link_rewrite": _link_rewrite, "srcset": _srcset, "css_urls": _css_urls, "code_spans": _code_spans, "markup": _markup, "json_repair": _json_repair,
        "glossary": _glossary, "status": _status, "retries": _retries, "request_errors": _request_errors, "robots": _robots, "mime": _mime,
        "crawl_pages": _crawl_pages, "crawl_assets": _crawl_assets, "crawl_issues": _crawl_issues, "crawl_stats": _crawl_stats, "chunk_plan": _chunk_plan, "chunk_drafts": _chunk_drafts,
        "html_segments": _html_segments, "segments_h1": _segments_h1, "segments_nav": _segments_nav, "html_links": _html_links, "html_resources": _html_resources, "html_units": _html_units, "site_build": _site_build, "build_links": _build_links,
    }
