"""Pages fetched over HTTP as a source: urls in, the answers that their tries got out.

The transport is a function, so a gateway, an archive or a test's table can stand for the network. Requests
run on the executors; a budget of tasks bounds how many are in flight.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import crawl, site

TRIES = "url string, attempt int, status int, code string, message string, content_type string, retry_after string, body binary"


@dataclass(frozen=True)
class Answer:
    status: int
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


class Unreachable(Exception):
    """No answer came: a code as network errors have, and what was said."""

    def __init__(self, code: str | None, message: str):
        super().__init__(message)
        self.code = code


@dataclass(frozen=True)
class Requests:
    agent: str = "palimpsest/0.2"
    headers: tuple[tuple[str, str], ...] = ()
    timeout_ms: int = 15000
    retries: int = 2
    delay_ms: int = 500
    budget: int = 4


Transport = Callable[[str, dict[str, str], int], Answer]


def urllib_transport(url: str, headers: dict[str, str], timeout_ms: int) -> Answer:
    """The answer whatever its status; errors of the network by their usual codes."""
    import socket
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout_ms / 1000) as got:
            return Answer(got.status, got.read(), {k.lower(): v for k, v in got.headers.items()})
    except urllib.error.HTTPError as refused:
        return Answer(refused.code, refused.read(), {k.lower(): v for k, v in refused.headers.items()})
    except urllib.error.URLError as error:
        why = error.reason
        code = {socket.gaierror: "ENOTFOUND", ConnectionRefusedError: "ECONNREFUSED", ConnectionResetError: "ECONNRESET", TimeoutError: "ETIMEDOUT"}.get(type(why), "ERR_NETWORK")
        raise Unreachable(code, str(why)) from error
    except TimeoutError as error:
        raise Unreachable("ETIMEDOUT", "timeout") from error


def _wait(header: str | None, attempt: int, base: int) -> float:
    """Seconds before the next try: what the header asks for, else doubled each time."""
    from email.utils import parsedate_to_datetime

    if header:
        try:
            return max(0.0, float(header))
        except ValueError:
            try:
                return max(0.0, parsedate_to_datetime(header).timestamp() - time.time())
            except (TypeError, ValueError):
                pass
    return base * 2**attempt / 1000


def fetch(urls: DataFrame, requests: Requests = Requests(), transport: Transport = urllib_transport, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """One row for each try of each url; tries go on while an answer calls for another and some are left."""
    headers = {"user-agent": requests.agent, **dict(requests.headers)}
    names = [c.split()[0] for c in TRIES.split(", ")]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for url in batch["url"]:
                rows = []
                for attempt in range(requests.retries + 1):
                    wait = None
                    try:
                        got = transport(url, headers, requests.timeout_ms)
                        wait = got.headers.get("retry-after")
                        rows.append((url, attempt, got.status, None, None, got.headers.get("content-type"), wait, got.body))
                        again = got.status in crawl.RETRYABLE
                    except Unreachable as lost:
                        rows.append((url, attempt, None, lost.code, str(lost), None, None, None))
                        again = True
                    if not again or attempt == requests.retries:
                        break
                    sleep(_wait(wait, attempt, requests.delay_ms))
                yield pd.DataFrame(rows, columns=names)

    return urls.select("url").distinct().repartition(requests.budget, "url").mapInPandas(ask, TRIES)


def robots(spark: SparkSession, source: str, requests: Requests = Requests(), transport: Transport = urllib_transport, sleep: Callable[[float], None] = time.sleep) -> tuple[list[tuple[bool, str]], DataFrame]:
    """(rules, issues): a file that is missing allows all, and so does one that can't be had, which is an issue."""
    from palimpsest.functions import weburl

    url = f"{weburl.parse(source).origin}/robots.txt"
    told = crawl.settle(fetch(spark.createDataFrame([(url,)], "url string"), requests, transport, sleep), requests.retries).first()
    schema = "kind string, severity string, url string, message string, discovered_from string, status int, code string, attempt_count int"
    issue = lambda text: spark.createDataFrame([("robots", "warn", url, f"{text}; all is allowed", None, told.status, told.code, told.attempt_count)], schema)
    if told.status is None:
        return [], issue("No robots.txt")
    if told.status >= 400:
        return [], spark.createDataFrame([], schema) if told.status == 404 else issue(f"Status {told.status} for robots.txt")
    return crawl.robots_rules(bytes(told.body or b"").decode("utf-8", "replace"), requests.agent), spark.createDataFrame([], schema)


def harvest(spark: SparkSession, wanted: crawl.Site, folder: str, requests: Requests = Requests(), transport: Transport = urllib_transport, rules: list[tuple[bool, str]] = (), stopped: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The answers of all that a crawl asks for, level by level: pages that links lead to, and what they show.

    Each level's answers are written before they are read, so no request is made again when executors are
    lost after it. ``stopped`` is asked between levels; what was fetched until then is returned.
    """
    c = F.col
    entries = spark.createDataFrame([(u,) for u in wanted.entries or (wanted.source,)], "url string")
    front = crawl.admitted(entries, wanted, found=False).select(crawl.U.canonical(c("url")).alias("url"))
    front = front.where(crawl.allowed_by(list(rules), F.concat(crawl.U.path(c("url")), crawl.U.query(c("url")))))
    level, seen = 0, []
    while True:
        fetch(front, requests, transport, sleep).write.mode("overwrite").parquet(f"{folder}/level={level}")
        seen.append(f"{folder}/level={level}")
        done = spark.read.parquet(*seen)
        if stopped():
            return done
        got = crawl.settle(spark.read.parquet(seen[-1]), requests.retries).where("status < 400")
        html = got.where(F.contains(F.lower(F.coalesce("content_type", F.lit("text/html"))), F.lit("html"))).select("url", c("body").cast("string").alias("html"))
        refs = site.resources(html).where("target IS NOT NULL").select("kind", c("target").alias("url")).distinct()
        pages = crawl.admitted(refs.where("kind = 'link'"), wanted).where(crawl.allowed_by(list(rules), F.concat(crawl.U.path(c("url")), crawl.U.query(c("url")))))
        new = pages.select("url").unionByName(crawl.admitted(refs.where("kind = 'asset'"), wanted, found=False).select("url")).distinct()
        front = new.join(done.select("url").distinct(), "url", "left_anti").checkpoint()
        if front.isEmpty():
            return done
        level += 1
