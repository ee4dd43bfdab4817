"""``python -m palimpsest.cli COMMAND --root FOLDER``: the mirror's commands; each prints what it did as JSON."""

from __future__ import annotations

import argparse
import json
import signal
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from palimpsest.mirror import Mirror
from palimpsest.sources import completion

COMMANDS = ("init", "crawl", "extract", "plan", "run", "verify", "apply", "build", "update", "auto", "doctor", "status", "probe")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("--root", default=".", help="the mirror's folder, on a file system that all executors reach")
    out.add_argument("--source", help="init: the site's url")
    out.add_argument("--locale", help="init: the language to translate to")
    out.add_argument("--token", default="", help="init: the endpoint's token, kept in .env")
    out.add_argument("--task", help="verify: one task")
    out.add_argument("--debug", action="store_true", help="tell the events of each stage")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, mirror: Mirror | None = None) -> int:
    """0 if all went well, 1 if a stage or a check failed, 130 if it was stopped."""
    args = parser().parse_args(argv)
    asked = {"stop": False}
    if mirror is None:
        mirror = Mirror(spark or SparkSession.builder.appName("palimpsest").getOrCreate(), args.root)
        before = signal.signal(signal.SIGINT, lambda *_: asked.update(stop=True))  # the first asks, the second breaks off
        mirror = replace(mirror, stopped=lambda: asked["stop"] and not signal.signal(signal.SIGINT, before))
    if args.command == "init":
        if not args.source or not args.locale:
            print("init needs --source and --locale", file=sys.stderr)
            return 2
        mirror.init(args.source, args.locale, args.token)
        return 0
    if args.command in ("run", "auto", "probe") and mirror.chat is None:
        mirror.chat = completion.http_transport(mirror.config["ai"]["baseUrl"], mirror.token())
    if args.command == "probe":
        ai = mirror.config["ai"]
        fine, said = completion.probe(completion.Endpoint(ai["modelName"], ai["llmProvider"], ai["temperature"], ai["requestTimeoutMs"]), mirror.chat)
        print(said)
        return 0 if fine else 1
    if args.command == "auto":
        done = mirror.auto(lambda event: print(*event, file=sys.stderr) if args.debug else None)
        print(json.dumps({"status": done.status, "profile": done.profile, "results": done.results}, default=str))
        return 130 if asked["stop"] else 0 if done.ok else 1
    result = mirror.verify(args.task) if args.command == "verify" else getattr(mirror, args.command)()
    print(json.dumps(result, default=str))
    if asked["stop"]:
        return 130
    if args.command == "verify":
        return 0 if result and all(r["ok"] for r in result) else 1
    return 1 if args.command == "run" and result["failed"] else 0


if __name__ == "__main__":
    sys.exit(main())
