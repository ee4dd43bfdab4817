"""Pages, links and reachability over snapshots."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import urls as U
from palimpsest.operators import site as site_ops


def page_manifest(pages: DataFrame) -> DataFrame:
    """One row for each canonical url, the first by id: where it is written and what it hashes to."""
    keyed = pages.select("page_id", U.canonical(F.col("url")).alias("url"), F.sha2("html", 256).alias("page_hash"))
    first = keyed.groupBy("url").agg(F.min(F.struct("page_id", "page_hash")).alias("f"))
    return first.select("url", "f.page_id", "f.page_hash", U.output_path(F.col("url")).alias("output_path"))


def included(pages: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """Pages whose url no exclude pattern matches and some include pattern does, if there are any."""
    any_of = lambda patterns: F.col("url").rlike("|".join(f"(?:{p})" for p in patterns))
    out = pages.where(~any_of(exclude)) if exclude else pages
    return out.where(any_of(include)) if include else out


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, ord, href) of each anchor in document order."""
    hrefs = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(hrefs).alias("ord", "href"))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, depth) of what the seeds reach over edges (src, dst), level by level.

    Each level is checkpointed to the shared folder, so plans stay short and lost executors don't start
    the walk again. What was seen is one table of slim rows with one partitioning throughout; a
    level joins its new nodes with it. The walk ends with the first level that finds nothing new.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hops = edges.select("src", "dst").distinct().repartition(n, "src").checkpoint()
    seen = seeds.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in count(1):
        step = front.join(hops, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if depth % 16 == 0:
            seen = seen.repartition(n, "node").checkpoint()
    return seen


#: Fixed value: statuses after which a request is tried again.
RETRYABLE = (408, 429, 500, 502, 503, 504)


#: Fixed value: network errors after which a request is tried again.
RETRYABLE_CODES = ("ECONNABORTED", "ECONNREFUSED", "ECONNRESET", "EAI_AGAIN", "ENETUNREACH", "ENOTFOUND", "ETIMEDOUT", "ERR_NETWORK")


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def backoff_ms(attempt: Column, base: int = 500) -> Column:
    """Milliseconds before the try after this one, doubled each time."""
    return (F.lit(base) * F.pow(F.lit(2), attempt)).cast("int")


def retry_after_ms(header: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for: seconds, or an HTTP date from ``now`` on; null if it is neither."""
    text = F.trim(header)
    seconds = F.when(text.rlike(r"^\+?(\d+\.?\d*|\.\d+)$"), text.try_cast("double"))
    at = F.try_to_timestamp(F.regexp_extract(text, r"^\w+, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(at.isNotNull(), F.greatest(F.lit(0), F.unix_millis(at) - F.unix_millis(now))).cast("double")
    return F.coalesce(seconds * 1000, wait).cast("long")


def wait_ms(attempt: Column, header: Column, now: Column, base: int = 500) -> Column:
    """What the header asks for, else the doubled delay."""
    return F.coalesce(retry_after_ms(header, now), backoff_ms(attempt, base).cast("long"))


def timed_out(code: Column, message: Column) -> Column:
    return F.coalesce(code.isin("ECONNABORTED", "ETIMEDOUT"), F.lit(False)) | F.coalesce(F.contains(F.lower(message), F.lit("timeout")), F.lit(False))


def error_text(code: Column, message: Column, timeout_ms: int) -> Column:
    """What an issue says of a failed request."""
    plain = F.coalesce(F.nullif(F.trim(message), F.lit("")), F.lit("Network request failed"))
    return F.when(timed_out(code, message), F.lit(f"Request timed out after {timeout_ms}ms")).when(code.isNotNull(), F.concat(code, F.lit(": "), plain)).otherwise(plain)


@dataclass(frozen=True)
class Site:
    """What a crawl is asked for."""

    source: str
    entries: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    retries: int = 2
    timeout_ms: int = 15000


def settle(attempts: DataFrame, retries: int = 2) -> DataFrame:
    """The outcome of each url from the answers that its tries got.

    ``attempts`` has url, attempt (from 0), status, code, message, content_type and body; a row without a
    status is a network error. Tries go on while an answer calls for another and some are left, so
    the outcome is the first row that doesn't, or the last allowed one. Adds attempt_count and timeouts.
    """
    a = F.col
    again = F.when(a("status").isNotNull(), retryable(a("status"))).otherwise(F.lit(True))  # without an answer, any error may pass
    told = attempts.where(a("attempt") <= retries).withColumn("ends", ~again | (a("attempt") == retries))
    last = told.groupBy("url").agg(F.min(F.when(a("ends"), a("attempt"))).alias("stop"), F.max("attempt").alias("most")).select("url", F.coalesce("stop", "most").alias("stop"))
    used = told.join(last, "url").where(a("attempt") <= a("stop"))
    lost = a("status").isNull() & timed_out(a("code"), a("message"))
    each = used.groupBy("url").agg((F.max("attempt") + 1).alias("attempt_count"), F.count_if(lost).alias("timeouts"), F.max_by(F.struct("status", "code", "message", "content_type", "body"), "attempt").alias("r"))
    return each.select("url", "attempt_count", "timeouts", "r.*")


_TOKEN = re.compile(r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*(?:#.*)?$")


def robots_rules(text: str, agent: str) -> list[tuple[bool, str]]:
    """(allowed, pattern) of the groups that name the agent, longest name first, else of those for all.

    Consecutive user-agent lines share a group; an empty pattern says nothing.
    """
    groups: dict[str, list[tuple[bool, str]]] = {}
    names: list[str] = []
    open_ = False
    for line in text.splitlines():
        m = _TOKEN.match(line)
        if m is None:
            continue
        field, value = m[1].lower(), m[2]
        if field == "user-agent":
            names = [*names, value.lower()] if open_ else [value.lower()]
            open_ = True
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            open_ = False
            for n in names:
                if value:
                    groups[n].append((field == "allow", value))
        else:
            open_ = False
    wanted = agent.lower().split("/")[0]
    fit = sorted((n for n in groups if n != "*" and n and (wanted == n or wanted.startswith(n))), key=len)
    return groups[fit[-1]] if fit else groups.get("*", [])


def allowed_by(rules: list[tuple[bool, str]], path: Column) -> Column:
    """Whether the longest pattern that fits a path and query allows it; of equal ones, allow. No pattern allows."""
    best = F.lit(-1)
    for allow, pattern in rules:
        body, end = (pattern[:-1], "$") if pattern.endswith("$") else (pattern, "")
        expression = "^" + ".*".join(re.escape(p) for p in body.split("*")) + end
        rank = 2 * len(pattern) + (1 if allow else 0)
        best = F.greatest(best, F.when(path.rlike(expression), F.lit(rank)).otherwise(F.lit(-1)))
    return (best < 0) | (best % 2 == 1)


def admitted(urls: DataFrame, site: Site, found: bool = True) -> DataFrame:
    """Rows of the site's origin; those that were found by a link have to pass the patterns too."""
    out = urls.where(U.same_origin(F.col("url"), F.lit(site.source)))
    return included(out, list(site.include), list(site.exclude)) if found else out


MIME = {
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "mjs": "text/javascript", "json": "application/json", "map": "application/json",
    "xml": "text/xml", "txt": "text/plain", "md": "text/markdown", "csv": "text/csv", "svg": "image/svg+xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "ico": "image/vnd.microsoft.icon", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf",
    "otf": "font/otf", "pdf": "application/pdf", "zip": "application/zip", "mp4": "video/mp4", "webm": "video/webm", "mp3": "audio/mpeg", "wasm": "application/wasm",
}
#: The first bytes of common formats, in hex.
MAGIC = (
    ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("25504446", "application/pdf"),
    ("504B0304", "application/zip"), ("1F8B", "application/gzip"), ("774F4646", "font/woff"), ("774F4632", "font/woff2"), ("0061736D", "application/wasm"),
    ("00000100", "image/x-icon"), ("494433", "audio/mpeg"), ("1A45DFA3", "video/webm"),
)


def content_type(said: Column, body: Column, url: Column) -> Column:
    """The type that the server gave, else that of the first bytes, else that of the extension, else octets."""
    head = F.hex(F.substring(body.cast("binary"), 1, 16))
    extension = F.lower(F.regexp_extract(U.path(url), r"\.([^./]+)$", 1))
    sniffed = F.coalesce(*[F.when(F.startswith(head, F.lit(m)), F.lit(t)) for m, t in MAGIC], F.when(F.substring(head, 1, 8) == "52494646", F.when(F.substring(head, 17, 8) == "57454250", "image/webp")))
    named = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])[extension]
    return F.coalesce(F.nullif(said, F.lit("")), sniffed, named, F.lit("application/octet-stream"))


def crawl(answers: DataFrame, site: Site, rules: list[tuple[bool, str]] = ()) -> dict[str, DataFrame]:
    """What a crawl of a site gives when urls answer as in ``answers``: pages, assets, issues, stats.

    ``answers`` is a table of tries as in :func:`settle`: what a fetcher wrote, or an archive of one. A
    url without answers fails as unreachable. Pages are walked level by level from the entries (which
    needn't pass the patterns); a page that robots refuses is counted, not reported; failures and
    statuses from 400 on are issues; what isn't HTML becomes an asset. Assets are those of the walked
    pages, same origin only, whatever robots and patterns say. Urls are canonical.
    """
    spark = answers.sparkSession
    table = settle(answers, site.retries).withColumn("url", U.canonical(F.col("url"))).dropDuplicates(["url"])
    table = table.withColumn("content_type", F.coalesce(F.col("content_type"), F.lit(None).cast("string"))).checkpoint()
    c = F.col
    fits = F.coalesce(F.contains(F.lower(F.coalesce("content_type", F.lit("text/html"))), F.lit("html")), F.lit(False))
    ok = c("status").isNotNull() & (c("status") < 400)
    found = site_ops.resources(table.where(ok & fits).select("url", c("body").cast("string").alias("html"))).checkpoint()
    links = found.where("kind = 'link'").select(c("page_url").alias("src"), c("target").alias("url")).distinct()
    edges = admitted(links, site).select("src", c("url").alias("dst"))
    open_ = allowed_by(list(rules), F.concat(U.path(c("src")), U.query(c("src"))))
    entries = spark.createDataFrame([(u,) for u in site.entries or (site.source,)], "url string")
    seeds = admitted(entries, site, found=False).select(U.canonical(c("url")).alias("node")).distinct()
    seen = reachable(edges.where(open_), seeds)
    first = seen.join(edges.withColumnRenamed("dst", "node").where(open_), "node", "left").join(seen.select(c("node").alias("src"), c("depth").alias("from_depth")), "src", "left")
    tasks = first.groupBy("node", "depth").agg(F.min(F.when(c("from_depth") == c("depth") - 1, c("src"))).alias("discovered_from"))
    tasks = tasks.select(c("node").alias("url"), "depth", "discovered_from").withColumn("allowed", allowed_by(list(rules), F.concat(U.path(c("url")), U.query(c("url")))))
    fetched = tasks.where("allowed").join(table, "url", "left").withColumn("fine", F.coalesce(ok, F.lit(False))).withColumn("is_html", fits).checkpoint()

    html = fetched.where("fine AND is_html")
    refs = found.where("kind = 'asset'").select("page_url", c("target").alias("ref")).distinct()
    pages = html.select("url", "status", F.coalesce("content_type", F.lit("text/html")).alias("content_type"), U.output_path(c("url")).alias("output_path"), F.sha2("body", 256).alias("page_hash"), "discovered_from", "depth", c("body").cast("string").alias("html"))
    pages = pages.join(refs.groupBy(c("page_url").alias("url")).agg(F.array_sort(F.collect_set("ref")).alias("asset_refs")), "url", "left").withColumn("asset_refs", F.coalesce("asset_refs", F.array().cast("array<string>")))

    named = refs.join(html.select(c("url").alias("page_url")), "page_url", "left_semi").groupBy(c("ref").alias("url")).agg(F.min("page_url").alias("discovered_from"))
    named = admitted(named, site, found=False).withColumn("direct", F.lit(1)).unionByName(fetched.where("fine AND NOT is_html").select("url", "discovered_from", F.lit(0).alias("direct")))
    wanted = named.groupBy("url").agg(F.min("direct").alias("direct"), F.min_by("discovered_from", "direct").alias("discovered_from"))
    got = wanted.join(table, "url", "left").withColumn("fine", F.coalesce(ok, F.lit(False))).checkpoint()
    assets = got.where("fine").select("url", content_type(c("content_type"), c("body"), c("url")).alias("content_type"), U.asset_path(c("url")).alias("output_path"), U.cache_name(c("url"), "").alias("cache_name"), F.sha2(c("body"), 256).alias("content_hash"))

    def failed(rows: DataFrame, kind: str) -> DataFrame:
        what = kind.removesuffix("-fetch")
        said = F.when(c("status").isNotNull(), F.format_string(f"Status %d for {what}", "status")).otherwise(F.concat(F.lit(f"No {what}: "), error_text(c("code"), F.coalesce("message", F.lit("no answer")), site.timeout_ms)))
        return rows.where("NOT fine").select(F.lit(kind).alias("kind"), F.lit("warn").alias("severity"), "url", said.alias("message"), "discovered_from", "status", "code", F.coalesce("attempt_count", F.lit(site.retries + 1)).alias("attempt_count"))

    none = lambda t: F.lit(None).cast(t)
    broken = found.where("kind = 'invalid'").join(html.select(c("url").alias("page_url")), "page_url", "left_semi")
    bad = broken.select(F.lit("invalid-link").alias("kind"), F.lit("warn").alias("severity"), c("page_url").alias("url"), F.concat(F.lit("Invalid "), "tag", F.lit("["), "attribute", F.lit("]: "), "raw").alias("message"), none("string").alias("discovered_from"), none("int").alias("status"), none("string").alias("code"), none("int").alias("attempt_count"))
    issues = failed(fetched, "page-fetch").unionByName(failed(got.where("direct = 1"), "asset-fetch")).unionByName(bad)
    requests = fetched.select("attempt_count", "timeouts").unionByName(got.where("direct = 1").select("attempt_count", "timeouts")).na.fill(0)
    by_kind = issues.agg(*[F.count_if(c("kind") == k).alias(n) for k, n in (("page-fetch", "page_failures"), ("asset-fetch", "asset_failures"), ("invalid-link", "invalid_links"))])
    stats = by_kind.crossJoin(tasks.agg(F.count_if(~c("allowed")).alias("skipped_by_robots"))).crossJoin(requests.agg(F.coalesce(F.sum(F.greatest(F.lit(0), c("attempt_count") - 1)), F.lit(0)).alias("retried_requests"), F.coalesce(F.sum("timeouts"), F.lit(0)).alias("timed_out_requests")))
    return {"pages": pages, "assets": assets, "issues": issues, "stats": stats}


def in_order(issues: DataFrame) -> DataFrame:
    """Errors first, then by url."""
    return issues.orderBy(F.when(F.col("severity") == "error", 0).otherwise(1), "url", "kind", "message")


def fatal(stats: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: whether nothing was got although something was tried and failed or was refused."""
    counts = pages.agg(F.count(F.lit(1)).alias("pages")).crossJoin(assets.agg(F.count(F.lit(1)).alias("assets"))).crossJoin(stats)
    return counts.select(((F.col("pages") == 0) & (F.col("assets") == 0) & (F.col("page_failures") + F.col("asset_failures") + F.col("skipped_by_robots") > 0)).alias("fatal"))


def rewritten(links: DataFrame, link: str, manifest: DataFrame, base: str) -> DataFrame:
    """``links`` with where each leads in the mirror, fragment kept; links to no page stay as they are."""
    at = manifest.select(F.col("url").alias("__target"), F.col("output_path").alias("__path"))
    joined = links.join(at, U.canonical(F.col(link)) == F.col("__target"), "left")
    new = F.concat(U.public_path(F.col("__path"), base), U.fragment(F.col(link)))
    return joined.withColumn("rewritten", F.coalesce(new, F.col(link))).drop("__target", "__path")
