"""Pages to segments, resources and units, and translated pages back out.

The tree of a page is a sequential parse, so it runs in batches of Python, one page at a time.
What follows from its rows, such as normal forms, keys and hashes, is Column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.functions import dom, weburl
from palimpsest.functions import markup as M
from palimpsest.functions import text as T
from palimpsest.functions import urls as U
from palimpsest.operators import state

#: Tags whose content isn't translated, and metas whose content is.
SKIPPED = ("script", "style", "noscript", "pre", "code")
METAS = ("description", "og:title", "og:description", "twitter:title")
#: Fixed value: the white space of ECMAScript's trim.
_WHITE = "\t\n\x0b\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_ROWS = 4096  # rows gathered before they go on


#: The defaults of what is extracted.
@dataclass(frozen=True)
class Extraction:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = (*SKIPPED, ".language-switcher")
    attributes: tuple[str, ...] = ("title", "alt", "aria-label", "placeholder")
    ignored: tuple[str, ...] = ("data-*",)


_RAW = "page_url string, ord int, dom_path string, kind string, attribute_name string, source_text string, tag_name string, title string"


def visit(document: dom.Node, rules: Extraction) -> Iterator[tuple[str, str, str | None, str, str, dom.Node]]:
    """(path, kind, attribute, text, tag, node) of each text that may be translated, in document order."""
    todo = [(node, f"root[{i}]", "root") for i, node in reversed(list(enumerate(dom.roots(document, rules.include))))]
    while todo:
        node, path, above = todo.pop()
        if node.tag == "#text":
            yield path, "text", None, node.data, above, node
            continue
        if not node.is_element or node.tag in SKIPPED or any(dom.matches(node, s) for s in rules.exclude):
            continue
        for name in rules.attributes:
            if name not in rules.ignored and node.attrs.get(name):
                yield path, "attr", name, node.attrs[name], node.tag, node
        if node.tag == "meta" and node.attrs.get("name", node.attrs.get("property")) in METAS:
            yield path, "meta", "content", node.attrs.get("content", ""), node.tag, node
        below = [(c, f"{path}/{c.tag if c.is_element or c.tag == '#text' else 'node'}[{i}]", node.tag) for i, c in enumerate(node.children)]
        todo.extend(reversed(below))


def _each(make: Callable[..., list[tuple]], columns: list[str]) -> Callable:
    """A function over batches of pages whose rows come out in page order, some thousand at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                found = make(*row)
                rows += found
                held += len(row[1] or "")
                if len(rows) >= _ROWS or held > 1 << 22:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return run


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


def segments(pages: DataFrame, rules: Extraction = Extraction(), url: str = "url", html: str = "html") -> DataFrame:
    """The segments of each page, with their place, keys and hashes.

    Blank texts are none. Pages without a source have no segments; a null url counts as empty in keys.
    """

    def rows(page: str, source: str) -> list[tuple]:
        document = dom.parse(source)
        title = next((n.text() for n in document.walk() if n.tag == "title"), None)
        return [(page, i, path, kind, attr, text, tag, title) for i, (path, kind, attr, text, tag, _) in enumerate(visit(document, rules))]

    raw = pages.select(url, html).mapInPandas(_each(rows, _names(_RAW)), _RAW)
    norm, title = T.normalize(F.col("source_text")), T.normalize(F.col("title"))
    found = raw.withColumns({"normalized_text": norm, "title": title}).where("normalized_text <> ''")
    c = F.col
    return found.withColumns({
        "segment_id": T.sha(c("page_url"), c("dom_path"), c("kind"), c("attribute_name")),
        "reuse_key": T.sha(c("page_url"), c("kind"), c("attribute_name"), c("tag_name"), c("title"), c("normalized_text")),
        "source_hash": F.sha2(F.concat_ws(":", "attribute_name", "normalized_text"), 256),
    })


_UNIT = (
    "page_url string, ord int, text string, title string, kind string, attribute_name string, tag_name string, "
    "members array<struct<dom_path:string,kind:string,attribute_name:string,text:string>>, codes array<struct<text:string,dom_path:string>>, slots array<int>"
)


def _fenced(code: str) -> str:
    longest = max((len(r) for r in re.findall("`+", code)), default=0)
    return "`" * (longest + 1) + code + "`" * (longest + 1)


def _blank(text: str) -> bool:
    return not text.strip(_WHITE)


def _runs(found: list[tuple]) -> dict[int, list[dom.Node]]:
    """Runs of texts and code of one element, by the texts in them: each has both, and no two texts side by side."""
    texts = {id(v[5]) for v in found if v[1] == "text"}
    run_of: dict[int, list[dom.Node]] = {}
    for parent in {id(v[5].parent): v[5].parent for v in found if v[1] == "text"}.values():
        run: list[dom.Node] = []
        for child in [*parent.children, dom.Node("#end")]:
            is_text = id(child) in texts
            is_code = child.tag == "code" and not _blank(child.text())
            if not (is_text or is_code) or (is_text and run and run[-1].tag == "#text"):
                if any(n.tag == "code" for n in run) and any(n.tag == "#text" for n in run):
                    run_of |= {id(n): run for n in run}
                run = []
            if is_text or is_code:
                run.append(child)
    return run_of


def units(pages: DataFrame, rules: Extraction = Extraction(), url: str = "url", html: str = "html") -> DataFrame:
    """What is translated as one: a run of texts and inline code of one element, or a segment alone.

    A run needs a text and a code; other elements, and two texts in a row, end it. The unit stands
    where its first text does; ``slots`` says how many codes come before each of its texts, ``segments``
    are the ids and hashes of what it covers.
    """

    def rows(page: str, source: str) -> list[tuple]:
        document = dom.parse(source)
        title = next((n.text() for n in document.walk() if n.tag == "title"), None)
        found = [v for v in visit(document, rules) if not _blank(v[3])]
        paths = {id(v[5]): v[0] for v in found if v[1] == "text"}
        run_of = _runs(found)
        out, told = [], set()
        for path, kind, attr, text, tag, node in found:
            run = run_of.get(id(node)) if kind == "text" else None
            if run is None:
                out.append((page, len(out), text, title, kind, attr, tag, [(path, kind, attr, text)], [], []))
            elif id(run) not in told:
                told.add(id(run))
                above = path.rpartition("/")[0]
                place = {id(c): i for i, c in enumerate(node.parent.children)}
                slots, codes = [], []
                for n in run:
                    if n.tag == "code":
                        codes.append((n.text(), f"{above}/code[{place[id(n)]}]"))
                    else:
                        slots.append(len(codes))
                whole = "".join(_fenced(n.text()) if n.tag == "code" else n.data for n in run)
                out.append((page, len(out), whole, title, "text", None, tag, [(paths[id(n)], "text", None, n.data) for n in run if n.tag == "#text"], codes, slots))
        return out

    raw = pages.select(url, html).mapInPandas(_each(rows, _names(_UNIT)), _UNIT)
    key = lambda m: T.sha(F.col("page_url"), m["dom_path"], m["kind"], m["attribute_name"])
    content = lambda m: F.sha2(F.concat_ws(":", m["attribute_name"], T.normalize(m["text"])), 256)
    held = F.transform("members", lambda m: F.struct(key(m).alias("segment_id"), content(m).alias("source_hash")))
    return raw.withColumns({"segments": held, "dom_paths": F.transform("members", lambda m: m["dom_path"]), "title": T.normalize(F.col("title"))}).drop("members")


_LINK = "page_url string, ord int, tag string, attribute string, raw string, target string, kind string"
#: Elements whose src is an asset, and words in a link's rel that make it one.
_SOURCES = ("img", "script", "source", "video", "audio")
_RELS = ("stylesheet", "icon", "preload", "modulepreload", "mask-icon")
_CALL = re.compile(M.CSS_URL)


def _address(url: str | None) -> weburl.Address | None:
    try:
        return weburl.parse(url or "")
    except weburl.Invalid:
        return None


def _css_value(call: str) -> str:
    value = call[4:-1].strip()
    return value[1:-1] if value[:1] in ("'", '"') else value


def resolve(base: weburl.Address | None, raw: str) -> tuple[str | None, str] | None:
    """(canonical url, kind of failure) of a reference; None if it isn't one to follow."""
    bare = raw.strip(_WHITE)
    if not bare or bare.startswith(("#", "mailto:", "javascript:")):
        return None
    try:
        found = weburl.parse(bare, base)
    except weburl.Invalid:
        return None, "invalid"
    return (found.canonical(), "") if found is not None else None


def references(document: dom.Node) -> Iterator[tuple[str, str, str, str]]:
    """(kind, tag, attribute, raw) of links and assets: anchors, sources, link elements, source sets, styles."""
    nodes = [n for n in document.walk() if n.is_element]
    for n in nodes:
        if n.tag == "a" and "href" in n.attrs:
            yield "link", n.tag, "href", n.attrs["href"]
    for n in nodes:
        if n.tag in _SOURCES and "src" in n.attrs:
            yield "asset", n.tag, "src", n.attrs["src"]
    for n in nodes:
        if n.tag == "link" and "href" in n.attrs and any(r in n.attrs.get("rel", "").lower() for r in _RELS):
            yield "asset", n.tag, "href", n.attrs["href"]
    for n in nodes:
        for part in n.attrs["srcset"].split(",") if "srcset" in n.attrs else ():
            if part.strip(_WHITE):
                yield "asset", n.tag, "srcset", re.split(r"\s+", part.strip(_WHITE))[0]
    for n in nodes:
        for call in _CALL.findall(n.attrs.get("style", "")):
            yield "asset", n.tag, "style", _css_value(call)


def resources(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links, assets and invalid references of each page, each once, as first seen; a base element doesn't count."""

    def rows(page: str, source: str) -> list[tuple]:
        out: list[tuple] = []
        seen: set[tuple] = set()
        base = _address(page)
        for kind, tag, attr, raw in references(dom.parse(source)):
            got = resolve(base, raw)
            if got is None:
                continue
            target, fault = got
            key = (fault, tag, attr, raw.strip(_WHITE)) if fault else (kind, target)
            if key not in seen:
                seen.add(key)
                out.append((page, len(out), tag, attr, raw.strip(_WHITE) if fault else raw, target, fault or kind))
        return out

    return pages.select(url, html).mapInPandas(_each(rows, _names(_LINK)), _LINK)


_REF = "page_url string, raw string, target string, fragment string"


def link_targets(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, raw, target, fragment) of each different reference that a page's rewriting may change."""

    def rows(page: str, source: str) -> list[tuple]:
        out: dict[str, tuple] = {}
        base = _address(page)
        for n in dom.parse(source).walk():
            if not n.is_element:
                continue
            raws = [n.attrs[a] for a in ("href", "src") if n.attrs.get(a)]
            raws += [re.split(r"\s+", c.strip(_WHITE))[0] for c in n.attrs.get("srcset", "").split(",") if c.strip(_WHITE)]
            raws += [_css_value(c) for c in _CALL.findall(n.attrs.get("style", ""))]
            for raw in raws:
                if raw in out or raw.startswith(("#", "mailto:", "tel:", "javascript:")):
                    continue
                try:
                    found = weburl.parse(raw, base)
                except weburl.Invalid:
                    continue
                if found is not None:
                    out[raw] = (page, raw, found.canonical(), found.fragment)
        return list(out.values())

    return pages.select(url, html).mapInPandas(_each(rows, _names(_REF)), _REF)


def rewrites(pages: DataFrame, manifest: DataFrame, assets: DataFrame | None = None, base: str = "", url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, raw, rewritten) of references to written pages and, where no page has the url, to assets.

    ``manifest`` and ``assets`` have url and output_path. The targets meet by url, so no page needs the
    whole manifest. The fragment stays; a query is in the file's name already. Pages of one url are one page here,
    with the references of all of them.
    """
    places = manifest.select(F.col("url").alias("target"), "output_path", F.lit(0).alias("rank"))
    if assets is not None:
        places = places.unionByName(assets.select(F.col("url").alias("target"), "output_path", F.lit(1).alias("rank")))
    best = places.groupBy("target").agg(F.min_by("output_path", "rank").alias("output_path"))
    found = link_targets(pages, url, html).join(best, "target")
    return found.select("page_url", "raw", F.concat(U.public_path(F.col("output_path"), base), "fragment").alias("rewritten")).distinct()


def rewrite_page(document: dom.Node, table: dict[str, str]) -> int:
    """Put each href, src, source set and style url through a table; those not in it stay. Returns the changes."""
    changed = 0
    for n in document.walk():
        if not n.is_element:
            continue
        new = {a: table[n.attrs[a]] for a in ("href", "src") if n.attrs.get(a) in table}
        if n.attrs.get("srcset"):
            parts = []
            for candidate in filter(None, (c.strip(_WHITE) for c in n.attrs["srcset"].split(","))):
                first, *descriptors = re.split(r"\s+", candidate)
                parts.append(" ".join([table[first], " ".join(descriptors)]).strip() if first in table else candidate)
            new["srcset"] = ", ".join(parts)
        if n.attrs.get("style"):
            new["style"] = M.rewrite_style(n.attrs["style"], table.get)
        changed += sum(n.attrs[k] != v for k, v in new.items())
        n.attrs |= new
    return changed


#: Where the script that replays translations is written, and the id of its data in a page.
RUNTIME_PATH, RUNTIME_ID = "_mirror/replay.js", "mirror-replay-data"
RUNTIME_SOURCE = """(function () {
  var holder = document.getElementById("mirror-replay-data");
  if (!holder || window.__mirrorReplay) return;
  var map = JSON.parse(holder.textContent), names = Object.keys(map.attributes);
  var ignored = { SCRIPT: 1, STYLE: 1, PRE: 1, CODE: 1, NOSCRIPT: 1 };
  var has = function (table, key) { return Object.prototype.hasOwnProperty.call(table, key); };
  function hidden(node) {
    for (var up = node.nodeType === 1 ? node : node.parentNode; up; up = up.parentNode) if (ignored[up.nodeName]) return true;
    return false;
  }
  function visit(node) {
    if (hidden(node)) return;
    if (node.nodeType === 3) {
      if (has(map.text, node.data) && map.text[node.data] !== node.data) node.data = map.text[node.data];
      return;
    }
    if (node.nodeType === 1) names.forEach(function (name) {
      var value = node.getAttribute(name);
      if (value !== null && has(map.attributes[name], value)) node.setAttribute(name, map.attributes[name][value]);
    });
    Array.prototype.slice.call(node.childNodes).forEach(visit);
  }
  var options = { attributes: true, attributeFilter: names, characterData: true, childList: true, subtree: true };
  var observer = new MutationObserver(function (records) {
    observer.disconnect();
    try {
      records.forEach(function (r) {
        if (r.type === "childList") Array.prototype.slice.call(r.addedNodes).forEach(visit); else visit(r.target);
      });
    } finally { observer.observe(document.body, options); }
  });
  window.__mirrorReplay = observer;
  function start() { visit(document.body); observer.observe(document.body, options); }
  if (document.body) start(); else window.addEventListener("DOMContentLoaded", start, { once: true });
})();
"""


def runtime_data(entries: list[tuple[str, str, str]]) -> dict:
    """The page's data of (slot, source, translation) entries."""
    data: dict = {"version": 1, "text": {}, "attributes": {name: {} for name in state.RUNTIME_ATTRIBUTES}}
    for slot, source, translated in sorted(entries):
        (data["text"] if slot == "text" else data["attributes"][slot])[source] = translated
    return data


def inject_runtime(document: dom.Node, entries: list[tuple[str, str, str]], base: str = "") -> bool:
    """Add a page's data at the end of the head and the script at the end of the body; nothing without entries."""
    if not entries:
        return False
    data = json.dumps(runtime_data(entries), ensure_ascii=False, separators=(",", ":"))
    for char in "<>&":
        data = data.replace(char, f"\\u{ord(char):04x}")
    head, body = (next(n for n in document.walk() if n.tag == t) for t in ("head", "body"))
    head.add(dom.Node("script", {"type": "application/json", "id": RUNTIME_ID})).add(dom.Node("#text", data=data))
    body.add(dom.Node("script", {"src": f"{base.removesuffix('/')}/{RUNTIME_PATH}", "data-mirror-replay": "true"}))
    return True


def replay(document: dom.Node, entries: list[tuple[str, str, str]]) -> tuple[int, int]:
    """(texts, attributes) changed: what the script does to a page, for texts and attributes that match exactly."""
    data = runtime_data(entries)
    texts = attributes = 0
    todo = [document]
    while todo:
        n = todo.pop()
        if n.tag in state.RUNTIME_IGNORED:
            continue
        if n.tag == "#text" and data["text"].get(n.data, n.data) != n.data:
            n.data = data["text"][n.data]
            texts += 1
        for name, table in data["attributes"].items() if n.is_element else ():
            new = table.get(n.attrs.get(name, ""))
            if new is not None and new != n.attrs[name]:
                n.attrs[name] = new
                attributes += 1
        todo.extend(reversed(n.children))
    return texts, attributes


def apply_plan(tops: list[dom.Node], paths: list[str | None], parts: list) -> bool:
    """Put a run's texts and codes in the order of its plan, in place of what lay between the first and the last.

    All nodes have to be there and have one parent, else nothing is changed.
    """
    nodes = [dom.locate(tops, p) if p else None for p in paths]
    codes = {p["dom_path"]: dom.locate(tops, p["dom_path"]) for p in parts if p["kind"] == "code"}
    return _place(nodes, codes, parts)


def _place(nodes: list[dom.Node | None], codes: dict[str, dom.Node | None], parts: list) -> bool:
    group = [n for n in (*nodes, *codes.values()) if n is not None]
    if not group or any(n is None for n in codes.values()) or group[0].parent is None:
        return False
    parent = group[0].parent
    if any(n.parent is not parent for n in group):
        return False
    place = {id(c): i for i, c in enumerate(parent.children)}
    if any(id(n) not in place for n in group):
        return False
    at = sorted(place[id(n)] for n in group)
    new = []
    for p in parts:
        if p["kind"] == "code":
            new.append(codes[p["dom_path"]])
        elif p["text"]:
            new.append(dom.Node("#text", data=p["text"]))
    for n in new:
        n.parent = parent
    parent.children[at[0] : at[-1] + 1] = new
    return True


def page_plans(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """(page_url, plans): the inline plans of each page, the first of a group by segment id, with where its segments are.

    A plan belongs to the page of its first segment, whatever the state of its translation. It is ready
    if each of its segments has an accepted translation of its present content.
    """
    p = translations.where("inline_plan IS NOT NULL").select("segment_id", "inline_plan")
    first = p.groupBy("inline_plan.group_id").agg(F.min_by("inline_plan", "segment_id").alias("plan"))
    accepted = translations.where("status = 'accepted'").select("segment_id", F.col("source_hash").alias("told"))
    s = segments.select("segment_id", "page_url", "dom_path", "source_hash").join(accepted, "segment_id", "left")
    each = first.select("group_id", "plan", F.posexplode("plan.segment_ids").alias("k", "segment_id")).join(s, "segment_id", "left")
    fine = F.coalesce(F.col("told") == F.col("source_hash"), F.lit(False))
    one = each.groupBy("group_id").agg(
        F.first("plan").alias("plan"), F.max(F.when(F.col("k") == 0, F.col("page_url"))).alias("page_url"), F.min(fine).alias("ready"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "dom_path"))), lambda x: x["dom_path"]).alias("paths"),
    ).where("page_url IS NOT NULL")
    rows = one.select("page_url", F.struct("group_id", F.col("plan.segment_ids").alias("segment_ids"), F.col("plan.parts").alias("parts"), "ready", "paths").alias("p"))
    return rows.groupBy("page_url").agg(F.array_sort(F.collect_list("p"), lambda a, b: F.when(a["group_id"] < b["group_id"], -1).otherwise(1)).alias("plans"))


def bindings(segments: DataFrame, translations: DataFrame) -> DataFrame:
    """Each segment with the accepted translation of its present content, null where there is none."""
    accepted = translations.where("status = 'accepted'").select("segment_id", "source_hash", "translated_text")
    return segments.select("page_url", "segment_id", "dom_path", "kind", "attribute_name", "source_hash").join(accepted, ["segment_id", "source_hash"], "left").drop("source_hash")


_BUILT = "page_url string, html string, applied int, missing int, rewritten int, replayed boolean"


def build(pages: DataFrame, bound: DataFrame, locale: str, rules: Extraction = Extraction(), plans: DataFrame | None = None, links: DataFrame | None = None, runtime: DataFrame | None = None, base: str = "", url: str = "url", html: str = "html") -> DataFrame:
    """Each page with its translations in place: (page_url, html, applied, missing, rewritten, replayed).

    ``bound`` is what :func:`bindings` gives, ``plans`` :func:`page_plans`, ``links`` :func:`rewrites` and
    ``runtime`` the entries of :func:`palimpsest.operators.state.runtime_manifest`. Each comes to a page as
    one list, which the page's own size bounds. All nodes are found before any is changed; then come
    inline plans, other bindings (those in a plan are left out even if it failed), links and the
    runtime data. Bindings whose node isn't there, and those of plans that can't be applied, are missing.
    Urls are a page's key.
    """
    lists = {
        "bound": bound.select("page_url", F.struct("segment_id", "dom_path", "kind", "attribute_name", "translated_text").alias("x")),
        "links": links and links.select("page_url", F.struct("raw", "rewritten").alias("x")),
        "runtime": runtime and runtime.select("page_url", F.struct("slot", "source_text", "translated_text").alias("x")),
    }
    joined = pages.select(F.col(url).alias("page_url"), F.col(html).alias("html"))
    for name, rows_ in lists.items():
        each = rows_.groupBy("page_url").agg(F.collect_list("x").alias(name)) if rows_ is not None else None
        joined = joined.join(each, "page_url", "left") if each is not None else joined.withColumn(name, F.lit(None).cast("array<string>"))
    joined = joined.join(plans, "page_url", "left") if plans is not None else joined.withColumn("plans", F.lit(None).cast("array<string>"))

    def rows(page: str, source: str, bound_: list | None, links_: list | None, runtime_: list | None, plans_: list | None) -> list[tuple]:
        some = lambda x: [] if x is None else list(x)
        document = dom.parse(source)
        tops = dom.roots(document, rules.include)
        pairs = [(b, dom.locate(tops, b["dom_path"])) for b in some(bound_)]  # before any edit
        groups = [(p, [dom.locate(tops, x) if x else None for x in p["paths"]], {c["dom_path"]: dom.locate(tops, c["dom_path"]) for c in p["parts"] if c["kind"] == "code"}) for p in some(plans_)]
        applied = missing = 0
        for p, nodes, codes in groups:
            if p["ready"] and _place(nodes, codes, list(p["parts"])):
                applied += len(p["segment_ids"])
            else:
                missing += len(p["segment_ids"])
        within = {i for p, _, _ in groups for i in p["segment_ids"]}
        for b, node in pairs:
            if b["segment_id"] in within:
                continue
            if node is None or b["translated_text"] is None:
                missing += 1
                continue
            applied += 1
            if b["kind"] == "text":
                if node.tag == "#text":
                    node.data = b["translated_text"]
            elif b["attribute_name"]:
                node.attrs[b["attribute_name"]] = b["translated_text"]
        for node in document.children:
            if node.tag == "html":
                node.attrs["lang"] = locale
        rewritten = rewrite_page(document, {x["raw"]: x["rewritten"] for x in some(links_)})
        replayed = inject_runtime(document, [(x["slot"], x["source_text"], x["translated_text"]) for x in some(runtime_)], base)
        return [(page, dom.serialise(document), applied, missing, rewritten, replayed)]

    ordered = joined.select("page_url", "html", "bound", "links", "runtime", "plans")
    return ordered.mapInPandas(_each(rows, _names(_BUILT)), _BUILT)
