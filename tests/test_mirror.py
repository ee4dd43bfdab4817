"""A whole mirror from crawl to build, with a web and a chat that are functions."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.mirror import Mirror, io_concurrency
from palimpsest.operators import crawl
from palimpsest.sources import completion, http

O = "https://docs.example.com"
WEB = {
    "/robots.txt": (200, "text/plain", "User-agent: *\nDisallow: /secret"),
    "/": (200, "text/html", '<title>Home</title><link rel="icon" href="/i.png"><h1>Welcome home</h1><p>Run <code>a</code> with {x} first</p><p>Run <code>a</code> with {x} first</p><a href="/guide/">Guide</a><a href="/gone">x1</a><a href="/secret">y1</a>'),
    "/guide": (200, "text/html", "<h1>Guide</h1><p>- item <b>two</b></p>"), "/i.png": (200, "image/png", "PNG"), "/gone": (404, "text/html", ""), "/secret": (200, "text/html", "no"),
}


def make_web(pages):
    def web(url, headers, timeout):
        path = url.removeprefix(O)
        if path not in pages:
            raise http.Unreachable("ENOTFOUND", "no host")
        status, kind, body = pages[path]
        return http.Answer(status, body.encode(), {"content-type": kind})

    return web


def make_chat():
    """Upper-cases what isn't protected; the first try of a page that has a Guide and an item comes back with an empty heading."""

    def chat(endpoint, payload):
        import re

        prompt = payload["messages"][1]["content"]
        task = json.loads(prompt.split("Task:\n")[1].split("\n\n")[0])
        again = "to be mended" in prompt
        shout = lambda t: re.sub(r"`[^`]*`|\{[^}]*\}|([^`{]+)", lambda m: m[1].upper() if m[1] else m[0], t)
        out = [{"id": c["id"], "translatedText": "" if c["text"] == "Guide" and "item" in prompt and not again else shout(c["text"])} for c in task["content"]]
        yield {"choices": [{"delta": {"content": json.dumps({"taskId": task["task_id"], "translations": out})}}]}

    return chat


def make_busy():
    def busy(endpoint, payload):
        raise completion.Refused("busy", 503)
        yield

    return busy


@pytest.fixture(scope="module")
def mirror(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("mirror"))
    out = Mirror(spark, root, make_web(WEB), make_chat())
    out.init(f"{O}/", "de", "secret token")
    config = json.loads(Path(root, "config.json").read_text())
    config["requestRetryDelayMs"], config["ai"]["modelName"], config["build"]["basePath"] = 0, "m", "/m"
    Path(root, "config.json").write_text(json.dumps(config))
    return out


def test_from_crawl_to_build(spark, mirror):
    root = Path(mirror.root)
    assert mirror.token() == "secret token" and ".env" in (root / ".gitignore").read_text()
    done = mirror.auto()
    assert done.ok, (done.status, done.events)
    update, ran, applied, built = (done.results[s] for s in ("update", "run", "apply", "build"))
    assert update["crawl"]["pages"] == 2 and update["crawl"]["assets"] == 1 and update["crawl"]["stats"]["skipped_by_robots"] == 1 and update["crawl"]["issues"] == {"page-fetch": 1}
    assert update["plan"] == {"created": 2, "retained": 0, "invalidated": 0} and ran == {"completed": 2, "succeeded": 2, "failed": 0, "failure_attempts": 0}
    assert applied["applied_files"] == 2 and applied["skipped"] == 0 and built == {"pages": 2, "assets": 2, "missing": 0}
    home = (root / "site/index.html").read_text()
    assert '<html lang="de">' in home and "<h1>WELCOME HOME</h1>" in home and "<p>RUN <code>a</code> WITH {x} FIRST</p>" in home
    assert '<a href="/m/guide/">GUIDE</a><a href="/gone">X1</a>' in home and '<link rel="icon" href="/m/i.png">' in home and "mirror-replay-data" in home
    assert (root / "site/guide/index.html").exists() and (root / "site/i.png").read_text() == "PNG" and (root / "site/_mirror/replay.js").exists()
    status = mirror.status()
    assert (status["pages"], status["applied_tasks"], status["pending_tasks"]) == (2, 2, 0) and status["accepted"] == status["segments"]
    assert "applied" in (root / "tasks/QUEUE.md").read_text() and len(list((root / "tasks/applied").glob("*.task.json"))) == 2 and not list((root / "tasks/pending").glob("*.json"))
    assert mirror.doctor()["missing"] == 0


def test_changes_make_new_work(spark, mirror):
    changed = WEB | {"/guide": (200, "text/html", "<h1>Guide</h1><p>- item <b>three</b></p><p>New {y}</p>")}
    other = Mirror(spark, mirror.root, make_web(changed), make_chat())
    got = other.update()
    assert got["plan"]["created"] == 1
    kept = {r.translated_text for r in other.load("translations").where("status = 'accepted'").collect()}
    assert "GUIDE" in kept and "two" not in kept
    again = other.plan()
    assert again == {"created": 0, "retained": 1, "invalidated": 0}
    busy = Mirror(spark, mirror.root, make_web(changed), make_busy())
    assert busy.run() == {"completed": 1, "succeeded": 0, "failed": 1, "failure_attempts": 3}
    assert "last run failed: busy" in Path(mirror.root, "tasks/QUEUE.md").read_text()
    assert other.run()["succeeded"] == 1
    results = other.load("results")
    assert [r["ok"] for r in other.verify()] == [True]
    broken = results.withColumn("translations", F.transform("translations", lambda t: F.struct(t["id"].alias("id"), F.regexp_replace(t["translated_text"], r"\{", "").alias("translated_text"))))
    other.save("results", broken.checkpoint())
    report = other.verify()[0]
    assert not report["ok"] and report["headline"].startswith("[placeholder_mismatch]") and other.apply()["applied_files"] == 0
    removed = Mirror(spark, mirror.root, make_web({k: v for k, v in changed.items() if k != "/guide"}), make_chat())
    assert removed.update()["plan"]["invalidated"] == 1 and removed.load("results").count() == 0
    status = removed.status()
    assert (status["pending_tasks"], status["applied_tasks"], status["invalid_tasks"]) == (0, 2, 0)  # what was applied outranks an id that was invalidated


def test_a_site_that_is_gone_fails(spark, tmp_path, capsys):
    lost = Mirror(spark, str(tmp_path), make_web({}), make_chat())
    lost.init(f"{O}/", "de")
    config = json.loads((tmp_path / "config.json").read_text()) | {"requestRetryDelayMs": 0}
    (tmp_path / "config.json").write_text(json.dumps(config))
    done = lost.auto()
    assert done.status == {"update": "failed", "run": "skipped", "apply": "skipped", "build": "skipped"} and "ENOTFOUND" in done.events[1][2]
    assert cli.main(["auto", "--root", str(tmp_path)], mirror=lost) == 1 and json.loads(capsys.readouterr().out)["status"]["run"] == "skipped"
    assert cli.main(["init"], mirror=lost) == 2 and cli.main(["doctor"], mirror=lost) == 0 and json.loads(capsys.readouterr().out)["pages"] == 0
    assert cli.main(["verify"], mirror=lost) == 1


def test_retries_and_waits(spark):
    asked = []

    def flaky(url, headers, timeout):
        import os

        n = len(asked)
        asked.append(os.getpid())
        if n == 0:
            return http.Answer(429, b"", {"retry-after": "2"})
        if n == 1:
            raise http.Unreachable("ETIMEDOUT", "timeout")
        return http.Answer(200, b"x", {})

    waits = []
    rows = http.fetch(spark.createDataFrame([(O + "/a",)], "url string"), http.Requests(retries=2, delay_ms=10), flaky, lambda s: waits.append(s)).collect()
    assert [(r.attempt, r.status, r.code) for r in rows] == [(0, 429, None), (1, None, "ETIMEDOUT"), (2, 200, None)]
    assert (http._wait("2", 0, 500), http._wait(None, 1, 500), http._wait("soon", 0, 500), http._wait("Mon, 01 Jan 2024 00:00:00 GMT", 0, 500)) == (2.0, 1.0, 0.5, 0.0)
    assert [io_concurrency(n) for n in (1, 4, 64)] == [2, 2, 8] and io_concurrency(64, 6) == 6


@pytest.mark.parametrize(("answer", "rules", "issues"), [((404, "", ""), [], 0), ((500, "", ""), [], 1), (None, [], 1), ((200, "text/plain", "User-agent: *\nDisallow: /x"), [(False, "/x")], 0)])
def test_robots_load(spark, answer, rules, issues):
    got, told = http.robots(spark, f"{O}/a", http.Requests(retries=0), make_web({"/robots.txt": answer} if answer else {}))
    assert got == rules and told.count() == issues


def test_stopping_leaves_the_rest(spark, tmp_path):
    quiet = Mirror(spark, str(tmp_path), make_web(WEB), make_chat(), stopped=lambda: True)
    quiet.init(f"{O}/", "de")
    assert quiet.auto().status == {s: "skipped" for s in ("update", "run", "apply", "build")}
    assert http.harvest(spark, crawl.Site(f"{O}/"), str(tmp_path / "h"), http.Requests(), make_web(WEB), stopped=lambda: True).count() == 1
