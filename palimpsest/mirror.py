"""A mirror as a folder: its commands from crawl to build over tables that each command leaves for the next.

Tables are Parquet, written anew under a new name and then named current, so a command that fails leaves the
state as it was. Tasks, results and reports are also written as JSON for people and other tools.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import apply, chunks, crawl, run, site, state, tasks, verify
from palimpsest.plans import stages, store
from palimpsest.sources import completion, files, http, tables

#: The columns of tables that a new mirror has none of yet.
_EMPTY = {
    "pages": "url string, status int, content_type string, output_path string, page_hash string, discovered_from string, depth int, html string, asset_refs array<string>",
    "assets": "url string, content_type string, output_path string, cache_name string, content_hash string, body binary",
    "segments": "page_url string, ord int, dom_path string, kind string, attribute_name string, source_text string, tag_name string, title string, normalized_text string, segment_id string, reuse_key string, source_hash string",
    "translations": tables.SCHEMAS["translations"].replace(" NOT NULL", ""),
    "tasks": "page_url string, title string, content array<struct<id:string,text:string,note:string>>, items array<struct<id:string,kind:string,segments:array<struct<segment_id:string,source_hash:string>>,codes:array<struct<text:string,dom_path:string>>,slots:array<int>>>, task_id string, file string, source_url string, target_locale string, readable boolean",
    "results": "task_id string, named_id string, file string, provider string, model string, completed_at string, translations array<struct<id:string,translated_text:string>>",
    "failures": "task_id string, failed_at string, attempt_count int, message string, errors array<struct<json_path:string,code:string,message:string>>",
    "reports": "task_id string, checked_at string, ok boolean, error_count long, warning_count long, headline string, sample array<string>",
    "invalidated": "task_id string",
}
_EMPTY["applied"] = _EMPTY["tasks"] + ", result struct<provider:string,model:string,completed_at:string>"
DEFAULTS = {
    "entryUrls": [], "includePatterns": [], "excludePatterns": [], "requestHeaders": {}, "crawlConcurrency": 4, "requestTimeoutMs": 15000, "requestRetryCount": 2, "requestRetryDelayMs": 500,
    "selectors": {"include": [], "exclude": list(site.Extraction().exclude)}, "attributes": {"translate": list(site.Extraction().attributes), "ignore": list(site.Extraction().ignored)},
    "build": {"basePath": "/", "runtimeReconciler": {"enabled": True}},
    "ai": {"llmProvider": "openai", "baseUrl": "", "modelName": "", "authTokenEnvVar": "PALIMPSEST_AI_TOKEN", "concurrency": 4, "requestTimeoutMs": 300000, "maxAttemptsPerTask": 3, "temperature": 0.2, "chunking": {"enabled": True, "maxItemsPerChunk": 80, "softMaxSourceCharsPerChunk": 6000, "hardMaxSourceCharsPerChunk": 9000}},
}


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"


def io_concurrency(cpus: int, most: int = 8) -> int:
    """Half of the processors, two at least."""
    return min(max(2, cpus // 2), most)


@dataclass
class Mirror:
    """``root`` is a folder that all executors reach. ``web`` and ``chat`` stand for the network where they are given."""

    spark: SparkSession
    root: str
    web: http.Transport = http.urllib_transport
    chat: completion.Transport | None = None
    stopped: Callable[[], bool] = lambda: False

    def __post_init__(self) -> None:
        store.workdir(self.spark)
        self.root = self.root.rstrip("/")

    # the state's tables

    def load(self, name: str) -> DataFrame:
        current = files.read_text(self.spark, f"{self.root}/state/{name}/CURRENT")
        if current is None:
            return self.spark.createDataFrame([], _EMPTY[name])
        try:
            return self.spark.read.parquet(f"{self.root}/state/{name}/{current.split()[0]}")
        except AnalysisException:
            return self.spark.createDataFrame([], _EMPTY[name])

    def save(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table under a new name and name it current; the one before stays, for what a command still reads of it, those before go."""
        pointer = f"{self.root}/state/{name}/CURRENT"
        before = (files.read_text(self.spark, pointer) or "").split()
        new = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/state/{name}/{new}")
        files.write_text(self.spark, pointer, "\n".join([new, *before[:1]]) + "\n")
        files.remove(self.spark, *[f"{self.root}/state/{name}/{old}" for old in before[1:]])
        return self.spark.read.parquet(f"{self.root}/state/{name}/{new}")

    @property
    def config(self) -> dict:
        text = files.read_text(self.spark, f"{self.root}/config.json")
        if text is None:
            raise FileNotFoundError(f"{self.root}/config.json: run init first")
        return files.merged(json.loads(text), DEFAULTS)

    @property
    def rules(self) -> site.Extraction:
        c = self.config
        return site.Extraction(tuple(c["selectors"]["include"]), tuple(c["selectors"]["exclude"]), tuple(c["attributes"]["translate"]), tuple(c["attributes"]["ignore"]))

    @property
    def glossary(self) -> verify.Glossary:
        text = files.read_text(self.spark, f"{self.root}/glossary.json")
        return tuple((e["source"], e["target"]) for e in json.loads(text or "[]"))

    def report(self, name: str, value: object) -> str:
        path = f"{self.root}/reports/{name}.json"
        files.write_json(self.spark, path, value)
        return path

    # commands

    def init(self, source_url: str, locale: str, token: str = "") -> None:
        """Create what is missing, add keys that the config lacks, and leave the rest as it is."""
        files.scaffold(self.spark, f"{self.root}/config.json", {"sourceUrl": source_url, "targetLocale": locale, **DEFAULTS}, merge=True)
        files.scaffold(self.spark, f"{self.root}/glossary.json", [])
        key = self.config["ai"]["authTokenEnvVar"]
        for path, body in ((".env", lambda text: files.upsert_env(text, key, token)), (".gitignore", lambda text: files.upsert_line(text, ".env"))):
            files.write_text(self.spark, f"{self.root}/{path}", body(files.read_text(self.spark, f"{self.root}/{path}")))

    def token(self) -> str:
        lines = (files.read_text(self.spark, f"{self.root}/.env") or "").splitlines()
        pairs = {r.key: r.value for r in tables.env_pairs(self.spark.createDataFrame([(x,) for x in lines], "value string")).collect()} if lines else {}
        return tables.env_value(pairs, dict(os.environ), self.config["ai"]["authTokenEnvVar"])

    def crawl(self) -> dict:
        """Fetch the site and replace pages and assets by what it has now; nothing got and something failed is an error."""
        c = self.config
        wanted = crawl.Site(c["sourceUrl"], tuple(c["entryUrls"]), tuple(c["includePatterns"]), tuple(c["excludePatterns"]), c["requestRetryCount"], c["requestTimeoutMs"])
        requests = http.Requests(headers=tuple(c["requestHeaders"].items()), timeout_ms=c["requestTimeoutMs"], retries=c["requestRetryCount"], delay_ms=c["requestRetryDelayMs"], budget=c["crawlConcurrency"])
        allowed, robots = http.robots(self.spark, wanted.source, requests, self.web)
        folder = f"{store.workdir(self.spark)}/palimpsest-harvest-{uuid.uuid4().hex}"
        try:
            answers = http.harvest(self.spark, wanted, folder, requests, self.web, allowed, self.stopped)
            got = crawl.crawl(answers, wanted, allowed)
            bodies = crawl.settle(answers, wanted.retries).select("url", "body")
            pages = self.save("pages", got["pages"])
            assets = self.save("assets", got["assets"].join(bodies, "url"))
            issues = got["issues"].unionByName(robots)
            stats = got["stats"].first().asDict() | {"robots_failures": robots.count()}
            failed = crawl.fatal(got["stats"], pages, assets).first().fatal
            listed = [r.asDict() for r in crawl.in_order(issues).limit(1000).collect()]  # a report for people
        finally:
            files.remove(self.spark, folder)
        out = {"pages": pages.count(), "assets": assets.count(), "issues": issues_count(listed), "stats": stats}
        self.report("crawl-latest", {"generatedAt": now(), **out, "listed": listed})
        if failed:
            raise RuntimeError(f"nothing could be fetched: {listed[0]['message'] if listed else 'robots.txt allows nothing'}")
        return out

    def extract(self) -> dict:
        """Segments of the pages now; translations become stale, or come back, or carry over to moved segments."""
        seg = self.save("segments", site.segments(self.load("pages"), self.rules).dropDuplicates(["segment_id"]))
        old = self.load("translations")
        marked = state.mark_stale(old, seg, now())
        kept = old.drop("reuse_key", "translated_text", "source_hash", "status", "updated_at")
        marked = marked.join(kept, "segment_id").select(old.columns)
        moved = state.carry_forward(marked, seg).withColumns({"target_locale": F.lit(self.config["targetLocale"]), "provider": F.lit("carried"), "inline_plan": F.lit(None).cast(old.schema["inline_plan"].dataType)})
        self.save("translations", marked.unionByName(moved.select(old.columns)))
        return {"segments": seg.count()}

    def plan(self) -> dict:
        """Tasks of the pages that have pending segments; those that still stand for their page stay."""
        c = self.config
        seg = self.load("segments")
        todo = state.pending(seg, self.load("translations"))
        planned = tasks.planned(site.units(self.load("pages"), self.rules), todo).checkpoint()
        before = self.load("tasks")
        kept, gone, new = tasks.reconcile(before, planned, c["sourceUrl"], c["targetLocale"])
        stay = before.join(kept.select("task_id", "file"), ["task_id", "file"], "left_semi").select(before.columns).checkpoint()
        made = new.withColumns({"file": F.concat("task_id", F.lit(".json")), "source_url": F.lit(c["sourceUrl"]), "target_locale": F.lit(c["targetLocale"]), "readable": F.lit(True)})
        gone, made = gone.checkpoint(), made.select(before.columns).checkpoint()
        new_tasks = self.save("tasks", stay.unionByName(made))
        self.save("results", self.load("results").join(gone.select("task_id"), "task_id", "left_anti"))
        self.save("invalidated", gone.select("task_id").join(new_tasks.select("task_id"), "task_id", "left_anti").distinct())
        entries = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in self.glossary]) if self.glossary else F.array().cast("array<struct<source:string,target:string>>")
        body = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), "task_id", "source_url", "target_locale", F.lit(now()).alias("created_at"), "page_url", "title", entries.alias("glossary"), "content"))
        files.write_files(made.select("file", body.alias("content")), f"{self.root}/tasks/pending", "file").count()
        mapped = F.to_json(F.struct(F.lit(2).alias("schemaVersion"), "task_id", "source_url", "target_locale", "page_url", "items"))
        files.write_files(made.select("file", mapped.alias("content")), f"{self.root}/tasks/mappings", "file").count()
        for row in gone.select("file").distinct().toLocalIterator():  # each invalidated task has a few files
            files.remove(self.spark, *[f"{self.root}/tasks/{part}/{row.file}" for part in ("pending", "mappings", "done")])
        self.manifest()
        return {"created": made.count(), "retained": stay.count(), "invalidated": gone.count()}

    def run(self) -> dict:
        """Translate the pending tasks that have no result yet."""
        if self.chat is None:
            raise RuntimeError("no chat transport: give Mirror(chat=...) one for the endpoint")
        ai = self.config["ai"]
        point = completion.Endpoint(ai["modelName"], ai["llmProvider"], ai["temperature"], ai["requestTimeoutMs"], ai["concurrency"])
        cut = ai["chunking"]
        limits = chunks.Limits(cut["maxItemsPerChunk"], cut["softMaxSourceCharsPerChunk"], cut["hardMaxSourceCharsPerChunk"]) if cut["enabled"] else chunks.Limits(1 << 30, 1 << 30, 1 << 30)
        old = self.load("results")
        todo = self.load("tasks").join(old.select("task_id"), "task_id", "left_anti").checkpoint()
        got = run.translate(todo, self.load("segments"), point, self.chat, self.config["targetLocale"], now(), limits, ai["maxAttemptsPerTask"], self.glossary, self.stopped)
        self.save("results", old.unionByName(got["results"]))
        body = F.to_json(F.struct("task_id", "provider", "model", "completed_at", "translations"))
        files.write_files(got["results"].select("file", body.alias("content")), f"{self.root}/tasks/done", "file").count()
        still = self.load("failures").join(todo.select("task_id"), "task_id", "left_anti")
        self.save("failures", still.unionByName(got["failures"]))
        done, failed = got["results"].count(), got["failures"].count()
        self.manifest()
        return {"completed": done + failed, "succeeded": done, "failed": failed, "failure_attempts": (got["failures"].agg(F.max("attempt_count")).first()[0] or 0)}

    def _checked(self, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        items, mapping = run.exploded(self.load("tasks").join(results.select("task_id"), "task_id", "left_semi"))
        answers = results.select("task_id", F.posexplode("translations").alias("pos", "t")).select("task_id", "pos", "t.*")
        errors = verify.errors(items, mapping, results, answers, self.load("segments"), self.glossary)
        return mapping, answers, errors, verify.warnings(items, answers)

    def verify(self, task_id: str | None = None) -> list[dict]:
        """Reports of the results that wait to be applied, of one task or all."""
        results = self.load("results")
        if task_id is not None:
            results = results.where(F.col("task_id") == task_id)
        _, _, errors, warned = self._checked(results)
        told = verify.report(results, errors, warned).withColumn("checked_at", F.lit(now())).select("task_id", "checked_at", "ok", "error_count", "warning_count", "headline", "sample").checkpoint()
        rest = self.load("reports").join(told.select("task_id"), "task_id", "left_anti")
        self.save("reports", rest.unionByName(told))
        files.write_files(told.select(F.concat("task_id", F.lit(".json")).alias("file"), F.to_json(F.struct(*told.columns)).alias("content")), f"{self.root}/reports/verify", "file").count()
        return [r.asDict(True) for r in told.orderBy("task_id").limit(1000).collect()]

    def apply(self) -> dict:
        """Every result without errors into the state, whole; its task moves to the applied ones."""
        results = self.load("results").join(self.load("tasks").select("task_id"), "task_id", "left_semi")
        mapping, answers, errors, _ = self._checked(results)
        errors = errors.checkpoint()
        old = self.load("translations")
        rows = apply.updates(mapping, results, answers, errors, self.load("segments"), self.config["targetLocale"]).checkpoint()
        self.save("translations", apply.apply_results(old, rows).select(old.columns))
        done = results.join(errors.select("task_id").distinct(), "task_id", "left_anti").checkpoint()
        pending, applied = self.load("tasks"), self.load("applied")
        moved = pending.join(done.select("task_id", F.struct("provider", "model", "completed_at").alias("result")), "task_id").select(applied.columns)
        self.save("applied", applied.join(done.select("task_id"), "task_id", "left_anti").unionByName(moved))
        names = [r.file for r in done.select("file").toLocalIterator()]  # each applied task moves a few files
        self.save("tasks", pending.join(done.select("task_id"), "task_id", "left_anti"))
        self.save("results", self.load("results").join(done.select("task_id"), "task_id", "left_anti"))
        stamp = now().replace(":", "-").replace(".", "-")
        for name in names:
            for part, kind in (("pending", "task"), ("mappings", "mapping"), ("done", "result")):
                stem = name.removesuffix(".json")
                files.archive(self.spark, f"{self.root}/tasks/{part}/{name}", f"{self.root}/tasks/applied/{stem}.{kind}.json", f"{self.root}/tasks/applied/history/{stem}.{stamp}.{kind}.json")
        self.manifest()
        return {"applied_files": len(names), "applied_segments": rows.count(), "skipped": errors.select("task_id").distinct().count()}

    def build(self) -> dict:
        """The translated site, emptied and written."""
        c = self.config
        pages, seg, tr, assets = self.load("pages"), self.load("segments"), self.load("translations"), self.load("assets")
        runtime = state.runtime_manifest(seg, tr)[0] if c["build"]["runtimeReconciler"]["enabled"] else None
        base = "" if c["build"]["basePath"] == "/" else c["build"]["basePath"]
        built = site.build(pages, site.bindings(seg, tr), c["targetLocale"], self.rules, site.page_plans(seg, tr), site.rewrites(pages, pages, assets, base), runtime, base)
        placed = built.join(pages.select(F.col("url").alias("page_url"), "output_path"), "page_url").checkpoint()
        counts = files.write_site(placed, f"{self.root}/site", assets.select("output_path", "body"), (site.RUNTIME_PATH, site.RUNTIME_SOURCE)).first()
        return {"pages": counts.pages, "assets": counts.assets, "missing": placed.agg(F.coalesce(F.sum("missing"), F.lit(0))).first()[0]}

    def doctor(self) -> dict:
        """Counts of what is translated, missing and stale, and of pages without a source."""
        pages = self.load("pages")
        found = state.doctor(self.load("segments"), self.load("translations")).first().asDict()
        out = {"pages": pages.count(), "assets": self.load("assets").count(), "segments": self.load("segments").count(), **found, "missing_snapshots": pages.where("html IS NULL").count()}
        self.report("doctor-latest", {"generatedAt": now(), **out})
        return out

    def manifest(self) -> DataFrame:
        """The manifest and the board of tasks, from the tables as they are."""
        count = F.size("content").alias("content_count")
        pending = self.load("tasks").select("task_id", "page_url", "title", count, "readable")
        applied = self.load("applied").select("task_id", "page_url", "title", count, "readable", F.col("result").isNotNull().alias("result_readable"), "result.completed_at", "result.provider", "result.model")
        results = self.load("results").select("task_id", F.lit(True).alias("readable"), "completed_at", "provider", "model")
        entries = tasks.manifest(pending, results, applied, self.load("reports"), self.load("failures"), self.load("invalidated")).checkpoint()
        board = tasks.board(entries).limit(10_000).collect()  # a file for people
        files.write_text(self.spark, f"{self.root}/tasks/QUEUE.md", "\n".join(["# Translation queue", "", *(r.line for r in board)]) + "\n")
        self.report("tasks-latest", {"generatedAt": now(), **tasks.summary(entries).first().asDict()})
        return tasks.in_order(entries)

    def status(self) -> dict:
        c, tr = self.config, self.load("translations")
        counts = tr.agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "stale").alias("stale")).first().asDict()
        queue = tasks.summary(self.manifest()).first().asDict()
        return {"source_url": c["sourceUrl"], "target_locale": c["targetLocale"], "pages": self.load("pages").count(), "assets": self.load("assets").count(), "segments": self.load("segments").count(), **counts, **{f"{k}_tasks": queue[k] for k in tasks.STATES}}

    def update(self) -> dict:
        return {"crawl": self.crawl(), "extract": self.extract(), "plan": self.plan()}

    def auto(self, listen: Callable[[tuple[str, str, str]], None] = lambda event: None) -> stages.Outcome:
        """Update, run, apply and build; a failure leaves the later stages out, failed tasks make the run a partial one."""
        partial = lambda stage, result: f"{result['failed']} failed" if stage == "run" and result["failed"] else None
        return stages.run([(name, lambda _, f=getattr(self, name): f()) for name in stages.STAGES], partial, listen, self.stopped)


def issues_count(listed: list[dict]) -> dict:
    """Issues by kind."""
    out: dict[str, int] = {}
    for r in listed:
        out[r["kind"]] = out.get(r["kind"], 0) + 1
    return out


def with_stop(mirror: Mirror, stopped: Callable[[], bool]) -> Mirror:
    return replace(mirror, stopped=stopped)
