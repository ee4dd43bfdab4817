"""DuckDB SQL for the registered queries, over the same parquet tables."""

from __future__ import annotations

from palimpsest.functions import text as T

SITE = "https://docs.example.com/d/"
_NOW = "2026-01-01T00:00:00.000Z"
_N = "[^A-Za-z0-9_]"

_SEG = rf"""
l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(0, len(t))) AS pos FROM l),
n AS (SELECT doc_id, pos, '{SITE}' || doc_id AS page_url, 'root[0]/p[' || pos || ']/#text[0]' AS dom_path, t[pos + 1] AS source_text,
  regexp_replace(regexp_replace(t[pos + 1], '{T.WHITE}+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM p),
seg AS (SELECT *, sha256(page_url || '::' || dom_path || '::text::') AS segment_id, sha256(page_url || '::text::::p::::' || norm) AS reuse_key, sha256(norm) AS source_hash FROM n WHERE norm <> ''),
lab AS (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY doc_id),
tr0 AS (SELECT seg.*, CASE WHEN toxic = 1 THEN 'stale' WHEN quality = 1 THEN 'accepted' ELSE 'draft' END AS status FROM seg JOIN lab USING (doc_id)),
tr AS (SELECT segment_id, reuse_key, 't:' || norm AS translated_text, CASE WHEN pos % 5 = 0 THEN 'x' || source_hash ELSE source_hash END AS source_hash, status, '2025-01-01T00:00:00.000Z' AS updated_at FROM tr0),
trm AS (SELECT CASE WHEN pos % 7 = 0 THEN sha256('moved' || segment_id) ELSE segment_id END AS segment_id, reuse_key, 't:' || norm AS translated_text, source_hash, status, '2025-01-01T00:00:00.000Z' AS updated_at FROM tr0)
"""
_PENDING = "SELECT * FROM seg WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.segment_id = seg.segment_id AND tr.source_hash = seg.source_hash AND tr.status = 'accepted')"
_URL = r"""
u AS (SELECT page_id, html, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS o, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS p, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM pages),
c AS (SELECT page_id, html, o, q, o || CASE WHEN p = '' THEN '/' ELSE p END || q AS url, regexp_replace(p, '^/+', '') AS s FROM u),
m AS (SELECT url, min(page_id) AS page_id, arg_min(sha256(html), page_id) AS page_hash, min(s) AS s, min(q) AS q FROM c GROUP BY url),
w AS (SELECT *, CASE WHEN s = '' THEN 'index.html' WHEN contains(regexp_extract(s, '([^/]*)$', 1), '.') THEN s ELSE s || '/index.html' END AS plain FROM m),
x AS (SELECT *, regexp_extract(plain, '[^/](\.[^./]*)$', 1) AS ext FROM w),
man AS (SELECT url, page_id, page_hash, substr(plain, 1, length(plain) - length(ext)) || CASE WHEN q = '' THEN '' ELSE '__q_' || substr(sha256(q), 1, 12) END || ext AS output_path FROM x)
"""


def _bare(text: str) -> str:
    """Text without code spans of one or two backticks, as it is if a backtick is left."""
    cut = f"regexp_replace({text}, '``[^`]*``|`[^`]*`', ' ', 'g')"
    return f"CASE WHEN contains({cut}, '`') THEN {text} ELSE {cut} END"


def _comparable(text: str) -> str:
    gone = f"regexp_replace({_bare(text)}, '{T.PLACEHOLDER}', ' ', 'g')"
    norm = f"regexp_replace(regexp_replace({gone}, '{T.WHITE}+', ' ', 'g'), '^ | $', '', 'g')"
    return rf"lower(regexp_replace(regexp_replace({norm}, '[\p{{P}}\p{{S}}]+', ' ', 'g'), '^{T.WHITE}+|{T.WHITE}+$', '', 'g'))"


_CLASSES = {
    "bold": r"\*\*[^*\n][\s\S]*?\*\*", "underlined": r"__[^_\n][\s\S]*?__", "struck": r"~~[^~\n][\s\S]*?~~", "images": r"!\[[^\]]+\]\([^)]+\)",
}


def _count(text: str, name: str) -> str:
    """Counts of a class of markup; links are those in brackets that no exclamation mark precedes."""
    if name == "links":
        return rf"(len(regexp_extract_all({text}, '!?\[[^\]]+\]\([^)]+\)')) - len(regexp_extract_all({text}, '{_CLASSES['images']}')))"
    return f"len(regexp_extract_all({text}, '{_CLASSES[name]}'))"


def _markup_broken(s: str, t: str) -> str:
    return "(" + " OR ".join(f"({_count(s, n)} > 0 AND {_count(s, n)} <> {_count(t, n)})" for n in (*_CLASSES, "links")) + ")"


_PH = f"'{T.PLACEHOLDER}'"
_MARK = f"'({T.LIST_MARKER})'"
_FAULT = "(doc_id % 3 <> 0 AND doc_id % {} = 0 AND p = {})"
_BUNDLE = rf"""
b0 AS (SELECT *, (row_number() OVER (PARTITION BY page_url ORDER BY pos) - 1)::INT AS p, count(*) OVER (PARTITION BY page_url) AS n FROM seg),
b1 AS (SELECT *, p % 12 AS v, 'task_' || substr(sha256(page_url), 1, 10) AS task_id, (p + 1)::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE (doc_id + p) % 7 END AS w FROM b0),
b2 AS (SELECT *, CASE v WHEN 1 THEN '- ' || norm WHEN 2 THEN '- [x] ' || norm WHEN 3 THEN '**' || norm || '** and __b__' WHEN 4 THEN norm || ' {{{{name}}}} %.*f'
  WHEN 5 THEN 'Use `a` or ``b`` ' || norm WHEN 6 THEN '[l](u) ![i](v) ' || norm ELSE norm END AS s FROM b1),
b AS (SELECT *, CASE w WHEN 0 THEN 'neu ' || s WHEN 2 THEN ' ' WHEN 3 THEN regexp_replace(s, '[{{*`\[]', '', 'g') WHEN 4 THEN s || ' neu'
  WHEN 5 THEN CASE WHEN v = 5 THEN 'Use ``b`` or `a` ' || norm ELSE s || ' neu' END WHEN 6 THEN s || ' `x' ELSE s END AS t FROM b2),
bc AS (SELECT *, {_bare("s")} AS sb, {_bare("t")} AS tb, contains(regexp_replace(t, '``[^`]*``|`[^`]*`', '', 'g'), '`') AS open,
  list_transform(regexp_extract_all(t, '``[^`]*``|`[^`]*`'), lambda x: trim(x, '`')) AS spans FROM b),
mp AS (SELECT task_id, p, id, v FROM b WHERE NOT {_FAULT.format(13, 2)}),
an AS (SELECT * REPLACE (CASE WHEN {_FAULT.format(5, 1)} THEN '1' ELSE id END AS id) FROM bc WHERE NOT (doc_id % 3 <> 0 AND doc_id % 7 = 0 AND p = n - 1)),
hd AS (SELECT DISTINCT task_id, doc_id, n FROM b),
j AS (SELECT a.task_id, a.p, a.id, a.t, a.tb, a.open, a.spans, q.s, q.sb, m.v AS mv, m.id IS NOT NULL AS mapped FROM an a LEFT JOIN (SELECT task_id, id, s, sb FROM bc) q USING (task_id, id) LEFT JOIN mp m ON m.task_id = a.task_id AND m.id = a.id),
e AS (
  SELECT task_id, 'task_segment_missing' AS code, '$.content[' || p || ']' AS json_path FROM mp JOIN (SELECT DISTINCT task_id, doc_id FROM hd) USING (task_id) WHERE {_FAULT.format(19, 4)}
  UNION ALL SELECT task_id, 'task_stale', '$.content[' || p || ']' FROM mp JOIN (SELECT DISTINCT task_id, doc_id FROM hd) USING (task_id) WHERE {_FAULT.format(17, 3)} AND NOT {_FAULT.format(19, 4)}
  UNION ALL SELECT task_id, 'mapping_item_count_mismatch', '$.content' FROM hd WHERE n <> (SELECT count(*) FROM mp WHERE mp.task_id = hd.task_id)
  UNION ALL SELECT task_id, 'task_id_mismatch', '$.taskId' FROM hd WHERE doc_id % 3 <> 0 AND doc_id % 11 = 0
  UNION ALL SELECT task_id, 'translation_count_mismatch', '$.translations' FROM hd WHERE n <> (SELECT count(*) FROM an WHERE an.task_id = hd.task_id)
  UNION ALL SELECT task_id, 'id_out_of_order', '$.translations[' || p || '].id' FROM an WHERE id <> (p + 1)::VARCHAR
  UNION ALL SELECT task_id, 'id_duplicate', '$.translations[' || p || '].id' FROM an WHERE EXISTS (SELECT 1 FROM an z WHERE z.task_id = an.task_id AND z.id = an.id AND z.p < an.p)
  UNION ALL SELECT DISTINCT task_id, 'id_missing', '$.translations' FROM b WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.task_id = b.task_id AND an.id = b.id)
  UNION ALL SELECT task_id, 'translation_empty', '$.translations[' || p || '].translatedText' FROM j WHERE trim(t) = ''
  UNION ALL SELECT task_id, 'translation_id_unknown', '$.translations[' || p || '].id' FROM j WHERE NOT mapped
  UNION ALL SELECT task_id, 'list_marker_mismatch', '$.translations[' || p || '].translatedText' FROM j WHERE mapped AND regexp_extract(s, {_MARK}, 1) <> '' AND regexp_extract(s, {_MARK}, 1) <> regexp_extract(t, {_MARK}, 1)
  UNION ALL SELECT task_id, 'markup_structure_mismatch', '$.translations[' || p || '].translatedText' FROM j WHERE mapped AND {_markup_broken("sb", "tb")}
  UNION ALL SELECT task_id, 'placeholder_mismatch', '$.translations[' || p || '].translatedText' FROM j WHERE mapped AND len(regexp_extract_all(s, {_PH})) > 0 AND list_sort(regexp_extract_all(s, {_PH})) <> list_sort(regexp_extract_all(t, {_PH}))
  UNION ALL SELECT task_id, 'inline_code_mismatch', '$.translations[' || p || '].translatedText' FROM j WHERE mapped AND mv = 5 AND (open OR list_sort(spans) <> ['a', 'b'])
  UNION ALL SELECT DISTINCT task_id, 'glossary_target_missing', '$.translations[' || p || '].translatedText' || CASE WHEN g.source = 'and' THEN '' ELSE '' END FROM j, (VALUES ('and', 'und'), ('the', 'das'), ('a', 'ein')) g(source, target)
    WHERE mapped AND regexp_matches(s, '(?i)(?:^|{_N})' || g.source || '(?:$|{_N})') AND NOT regexp_matches(t, '(?i)(?:^|{_N})' || g.target || '(?:$|{_N})') AND g.source = 'and'
  UNION ALL SELECT task_id, 'glossary_target_missing', '$.translations[' || p || '].translatedText' FROM j, (VALUES ('the', 'das'), ('a', 'ein')) g(source, target)
    WHERE mapped AND regexp_matches(s, '(?i)(?:^|{_N})' || g.source || '(?:$|{_N})') AND NOT regexp_matches(t, '(?i)(?:^|{_N})' || g.target || '(?:$|{_N})')
)
"""

_ORDERS = rf"""
o AS (SELECT *, o_orderkey AS k, 'task_' || o_orderkey AS task_id, '{SITE}' || (o_orderkey % 1000) AS page_url, CASE WHEN o_orderkey % 2 = 0 THEN 'T' END AS title, (o_orderkey % 9)::INT AS content_count FROM orders),
f1 AS (SELECT task_id, page_url, title, content_count, 0 AS rank, CASE WHEN k % 31 = 0 THEN 'invalid' WHEN k % 3 = 2 THEN 'pending' WHEN k % 3 = 0 THEN 'done' ELSE 'invalid' END AS status FROM o WHERE o_orderstatus <> 'F'),
f2 AS (SELECT task_id, page_url, title, content_count, 1 AS rank, CASE WHEN k % 37 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 THEN 'applied' ELSE 'invalid' END AS status FROM o WHERE o_orderstatus <> 'O'),
f3 AS (SELECT DISTINCT task_id || CASE WHEN k % 100 = 0 THEN 'x' ELSE '' END AS task_id, '' AS page_url, NULL::VARCHAR AS title, 0 AS content_count, 2 AS rank, 'invalid' AS status FROM o WHERE k % 50 = 0),
fa AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS nth FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3)),
en AS (SELECT fa.task_id, fa.page_url, fa.title, fa.content_count, fa.status, CASE WHEN fa.status = 'done' THEN '{_NOW}' END AS completed_at, fa.status <> 'invalid' AS live, o.k FROM fa LEFT JOIN o ON o.task_id = fa.task_id WHERE nth = 1),
ent AS (SELECT *, CASE WHEN live AND k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'pass' ELSE 'fail' END END AS last_verify_status, CASE WHEN live AND k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 0 ELSE (k % 5)::INT END END AS last_verify_error_count,
  CASE WHEN live AND k % 10 = 1 THEN 'fail' END AS last_run_status FROM en)
"""
_RANK = "list_position(['pending', 'done', 'applied', 'invalid'], status)"

_RUNTIME = rf"""
rs AS (SELECT page_url, pos, segment_id, source_hash, lower(regexp_extract(source_text, '^(\S+)', 1)) AS src, source_text, norm FROM seg),
rp AS (SELECT page_url, CASE WHEN pos % 3 <> 0 THEN 'text' WHEN pos % 6 = 0 THEN 'title' END AS slot, src AS source_text,
  CASE WHEN pos % 5 = 4 THEN source_text WHEN segment_id < '8' THEN 't:' || lower(norm) ELSE 'u:' || lower(norm) END AS translated_text, pos FROM rs WHERE pos % 7 <> 6 AND pos % 10 <> 9),
rk AS (SELECT page_url, slot, source_text, min(translated_text) AS translated_text, max(translated_text) AS most FROM rp
  WHERE slot IS NOT NULL AND length(regexp_replace(source_text, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')) >= 2 AND regexp_matches(source_text, '\p{{L}}') AND trim(translated_text) <> '' AND source_text <> translated_text GROUP BY ALL)
"""

_CRAWL = r"""
hr AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages),
rk AS (SELECT href, row_number() OVER (ORDER BY href) - 1 AS r FROM (SELECT DISTINCT href FROM hr)),
k AS (SELECT '/' AS path, 5 AS r, 0 AS page_id UNION ALL SELECT regexp_replace(replace(replace(url_encode(href), '%2F', '/'), '%2C', ','), '&amp;|%26amp%3B', '&', 'g'), r, r % (SELECT count(*) FROM pages) FROM rk),
a AS (SELECT 'https://docs.example.com' || path AS url, path, r, page_id, CASE WHEN r % 29 = 0 THEN NULL WHEN r % 17 = 0 THEN 404 WHEN r % 23 = 0 THEN 503 ELSE 200 END AS status,
  CASE WHEN r % 29 = 0 THEN 3 WHEN r % 17 = 0 THEN 1 WHEN r % 23 = 0 THEN 3 WHEN r % 19 = 0 THEN 2 ELSE 1 END AS attempt_count, r % 13 <> 0 AS is_html,
  (starts_with(path, '/de')) OR NOT (starts_with(path, '/d') OR regexp_matches(path, 'ing$')) AS allowed FROM k),
ed AS (SELECT DISTINCT s.path AS src, regexp_replace(replace(replace(url_encode(h.href), '%2F', '/'), '%2C', ','), '&amp;|%26amp%3B', '&', 'g') AS dst FROM a s JOIN hr h ON h.page_id = s.page_id
  WHERE s.status = 200 AND s.is_html AND s.allowed),
g AS (SELECT * FROM ed WHERE NOT contains(dst, '/th')),
w(path, depth) AS (SELECT '/', 0 UNION SELECT dst, depth + 1 FROM w JOIN g ON g.src = w.path WHERE depth < 40),
n AS (SELECT path, min(depth)::INT AS depth FROM w GROUP BY path),
t AS (SELECT a.*, n.depth FROM n JOIN a USING (path))
"""


def _chunk_sql(most: int, soft: int, hard: int) -> str:
    """The plan by three walks over the items of each task that isn't small: sections, joined sections, and cuts of those."""
    hi, hc = max(20, most // 2), max(1500, soft // 2)
    return rf"""WITH RECURSIVE {_SEG},
    it AS (SELECT page_url, (row_number() OVER (PARTITION BY page_url ORDER BY pos) - 1)::INT AS i, (length(s) + len(regexp_extract_all(s, '[\x{{10000}}-\x{{10FFFF}}]')))::INT AS chars, CASE WHEN length(norm) < 40 THEN norm END AS h
      FROM (SELECT *, regexp_replace(source_text, '^{T.WHITE}+|{T.WHITE}+$', '', 'g') AS s FROM seg)),
    sm AS (SELECT page_url, count(*)::INT AS n, sum(chars) AS c FROM it GROUP BY page_url),
    bg AS (SELECT it.* FROM it JOIN sm USING (page_url) WHERE n > {most} OR c > {soft}),
    a(page_url, i, cnt, ch, sec, h) AS (SELECT page_url, i, 1, chars, 0, h FROM bg WHERE i = 0 UNION ALL
      SELECT x.page_url, x.i, CASE WHEN nw THEN 1 ELSE cnt + 1 END, CASE WHEN nw THEN x.chars ELSE ch + x.chars END, sec + nw::INT, CASE WHEN x.h IS NOT NULL THEN x.h ELSE ah END
      FROM (SELECT bg.*, a.cnt, a.ch, a.sec, a.h AS ah, (bg.h IS NOT NULL OR a.cnt + 1 > {most} OR a.ch + bg.chars > {hard}) AS nw FROM a JOIN bg ON bg.page_url = a.page_url AND bg.i = a.i + 1) x),
    se AS (SELECT page_url, sec, min(i) AS lo, max(i) AS up, max(cnt) AS cnt, max(ch) AS ch, min(h) AS h FROM a GROUP BY page_url, sec),
    m(page_url, sec, cnt, ch, grp, h) AS (SELECT page_url, sec, cnt, ch, 0, h FROM se WHERE sec = 0 UNION ALL
      SELECT x.page_url, x.sec, CASE WHEN nw THEN x.cnt ELSE mcnt + x.cnt END, CASE WHEN nw THEN x.ch ELSE mch + x.ch END, grp + nw::INT, CASE WHEN nw THEN x.h ELSE coalesce(mh, x.h) END
      FROM (SELECT se.*, m.cnt AS mcnt, m.ch AS mch, m.grp, m.h AS mh, (m.cnt + se.cnt > {most} OR m.ch + se.ch > {soft} OR (coalesce(se.h, '') <> '' AND m.cnt >= {hi} AND m.ch >= {hc})) AS nw FROM m JOIN se ON se.page_url = m.page_url AND se.sec = m.sec + 1) x),
    gr AS (SELECT page_url, grp, arg_max(h, sec) AS h FROM (SELECT page_url, grp, sec, coalesce(h, chr(0)) AS h FROM m) GROUP BY page_url, grp),
    ig AS (SELECT bg.page_url, bg.i, bg.chars, m.grp FROM bg JOIN se ON se.page_url = bg.page_url AND bg.i BETWEEN lo AND up JOIN m ON m.page_url = se.page_url AND m.sec = se.sec),
    z(page_url, i, cnt, ch, grp, k) AS (SELECT page_url, i, 1, chars, grp, 0 FROM ig WHERE i = 0 UNION ALL
      SELECT x.page_url, x.i, CASE WHEN nw THEN 1 ELSE cnt + 1 END, CASE WHEN nw THEN x.chars ELSE ch + x.chars END, x.grp, k + nw::INT
      FROM (SELECT ig.*, z.cnt, z.ch, z.k, (ig.grp <> z.grp OR z.cnt + 1 > {most} OR z.ch + ig.chars > {soft}) AS nw FROM z JOIN ig ON ig.page_url = z.page_url AND ig.i = z.i + 1) x),
    ck AS (SELECT page_url, k, min(i) + 1 AS item_start, max(i) + 1 AS item_end, min(grp) AS grp FROM z GROUP BY page_url, k),
    nk AS (SELECT page_url, count(*)::INT AS chunk_count FROM ck GROUP BY page_url)
    SELECT page_url, (k + 1)::INT AS chunk_index, chunk_count, item_start::INT AS item_start, item_end::INT AS item_end, nullif(gr.h, chr(0)) AS heading FROM ck JOIN nk USING (page_url) JOIN gr USING (page_url, grp) WHERE chunk_count > 1
    UNION ALL SELECT page_url, 1, 1, 1, n, NULL FROM sm WHERE page_url NOT IN (SELECT page_url FROM nk WHERE chunk_count > 1)"""


def _varied(options: tuple[str, ...], k: str, value: str) -> str:
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"replace([{listed}][({k} % {len(options)} + 1)::INT], '#', {value})"


def oracle_sql() -> dict[str, str]:
    from palimpsest.plans import catalogue as C

    spans = _varied(C.SPANS, "p_partkey", "p_brand")
    return {
        "page_manifest": f"WITH {_URL} SELECT * FROM man",
        "public_paths": rf"WITH {_URL} SELECT url, '/mirror/' || regexp_replace(output_path, '(^|/)index\.html$', '\1') AS public_path FROM man",
        "url_filter": "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/en/|/de/') AND NOT regexp_matches(url, 'utm_source|#top$')",
        "link_anchors": """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages), b AS (SELECT page_id, h, unnest(range(0, len(h))) AS ord FROM a) SELECT page_id, ord::INT AS ord, h[ord + 1] AS href FROM b""",
        "dangling_links": f"""WITH {_URL}, a AS (SELECT page_id, o, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM c), b AS (SELECT page_id, o, h, unnest(range(0, len(h))) AS ord FROM a)
            SELECT page_id, ord::INT AS ord, o || h[ord + 1] AS target FROM b WHERE o || h[ord + 1] NOT IN (SELECT url FROM c)""",
        "reachability": f"""WITH RECURSIVE {_URL}, l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM c), e AS (SELECT url AS src, href AS dst FROM l UNION ALL SELECT href, url FROM l),
            r(node, depth) AS (SELECT url, 0 FROM c WHERE page_id = 0 UNION SELECT dst, depth + 1 FROM r JOIN e ON node = src WHERE depth < (SELECT count(DISTINCT dst) FROM e WHERE dst IN (SELECT url FROM c)) // 4 + 20) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""",
        "mark_stale": f"""WITH {_SEG}, j AS (SELECT tr.*, coalesce(s.source_hash = tr.source_hash, false) AS fresh, s.reuse_key AS now_key FROM tr LEFT JOIN seg s ON tr.segment_id = s.segment_id)
            SELECT segment_id, CASE WHEN fresh THEN coalesce(now_key, reuse_key) ELSE reuse_key END AS reuse_key, translated_text, source_hash, CASE WHEN NOT fresh THEN 'stale' WHEN status = 'stale' THEN 'accepted' ELSE status END AS status,
            CASE WHEN fresh AND status <> 'stale' THEN updated_at ELSE '{_NOW}' END AS updated_at FROM j""",
        "carry_forward": f"""WITH {_SEG}, a AS (SELECT reuse_key, source_hash, min(segment_id) AS segment_id FROM seg WHERE segment_id NOT IN (SELECT segment_id FROM trm) GROUP BY ALL HAVING count(*) = 1),
            b AS (SELECT reuse_key, source_hash, min(translated_text) AS translated_text, min(updated_at) AS updated_at FROM trm WHERE status <> 'draft' GROUP BY reuse_key, source_hash HAVING count(*) = 1)
            SELECT segment_id, reuse_key, translated_text, source_hash, 'accepted' AS status, updated_at FROM a JOIN b USING (reuse_key, source_hash)""",
        "pending": f"WITH {_SEG} SELECT segment_id, page_url, dom_path, source_hash FROM ({_PENDING})",
        "doctor": f"""WITH {_SEG}, j AS (SELECT tr.status, coalesce(s.source_hash = tr.source_hash, false) AS fresh FROM tr LEFT JOIN seg s ON tr.segment_id = s.segment_id)
            SELECT count(*) FILTER (WHERE fresh AND status = 'accepted') AS translated, count(*) FILTER (WHERE NOT fresh OR status = 'stale') AS stale, (SELECT count(*) FROM ({_PENDING})) AS missing FROM j""",
        "task_items": f"WITH {_SEG} SELECT 'task_' || substr(sha256(page_url), 1, 10) AS task_id, (row_number() OVER (PARTITION BY page_url ORDER BY pos))::VARCHAR AS id, source_text AS text FROM ({_PENDING})",
        "task_plan": f"WITH {_SEG} SELECT 'task_' || substr(sha256(page_url), 1, 10) AS task_id, count(*)::INT AS n_items, sum(length(source_text))::BIGINT AS source_chars, count(*)::VARCHAR AS last_id, arg_max(segment_id, pos) AS last_segment FROM ({_PENDING}) GROUP BY page_url",
        "task_reconcile": f"""WITH {_SEG}, pg AS (SELECT DISTINCT page_url, doc_id AS n, 'task_' || substr(sha256(page_url), 1, 10) AS task_id FROM ({_PENDING})),
            old AS (SELECT *, unnest(CASE WHEN n % 4 = 0 THEN ['b.json', 'a.json'] ELSE ['a.json'] END) AS file, n % 5 <> 0 AND n % 7 <> 0 AND n % 11 <> 0 AS fits FROM pg WHERE n % 3 <> 0),
            kept AS (SELECT page_url, task_id, min(file) AS file FROM old WHERE fits GROUP BY ALL)
            SELECT page_url, task_id, file, 'retained' AS outcome FROM kept UNION ALL SELECT page_url, task_id, file, 'invalidated' FROM old WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.page_url = old.page_url AND kept.file = old.file)
            UNION ALL SELECT page_url, task_id, '', 'created' FROM pg WHERE page_url NOT IN (SELECT page_url FROM kept)""",
        "apply_upsert": f"WITH {_SEG} SELECT segment_id, reuse_key, translated_text, source_hash, CASE WHEN status = 'draft' THEN 'accepted' ELSE status END AS status, CASE WHEN status = 'draft' THEN '{_NOW}' ELSE updated_at END AS updated_at FROM tr",
        "item_issues": f"""WITH {_SEG}, {_BUNDLE} SELECT segment_id, regexp_replace(t, '^{T.WHITE}+|{T.WHITE}+$', '', 'g') = '' AS translation_empty,
            len(regexp_extract_all(s, {_PH})) > 0 AND list_sort(regexp_extract_all(s, {_PH})) <> list_sort(regexp_extract_all(t, {_PH})) AS placeholder_mismatch,
            regexp_extract(s, {_MARK}, 1) <> '' AND regexp_extract(s, {_MARK}, 1) <> regexp_extract(t, {_MARK}, 1) AS list_marker_mismatch, {_markup_broken("sb", "tb")} AS markup_structure_mismatch,
            {_comparable("s")} = {_comparable("t")} AND regexp_matches({_comparable("s")}, '[\\p{{L}}\\p{{N}}]') AS translation_suspiciously_identical FROM bc""",
        "verify_issues": f"WITH {_SEG}, {_BUNDLE} SELECT * FROM e",
        "verify_report": f"""WITH {_SEG}, {_BUNDLE}, ec AS (SELECT task_id, count(*) AS n FROM e GROUP BY task_id),
            wc AS (SELECT task_id, count(*) AS n FROM j WHERE s IS NOT NULL AND {_comparable("s")} = {_comparable("t")} AND regexp_matches({_comparable("s")}, '[\\p{{L}}\\p{{N}}]') GROUP BY task_id)
            SELECT hd.task_id, ec.n IS NULL AS ok, coalesce(ec.n, 0) AS error_count, coalesce(wc.n, 0) AS warning_count, (CASE WHEN ec.n IS NULL THEN 0 ELSE least(ec.n, 6) END)::INT AS sample_lines FROM hd LEFT JOIN ec USING (task_id) LEFT JOIN wc USING (task_id)""",
        "apply_bundle": f"""WITH {_SEG}, {_BUNDLE}, good AS (SELECT segment_id, source_hash, CASE WHEN v = 5 THEN regexp_replace(t, '``[^`]*``|`[^`]*`', '', 'g') ELSE t END AS tt FROM bc WHERE task_id NOT IN (SELECT task_id FROM e))
            SELECT coalesce(good.segment_id, tr.segment_id) AS segment_id, coalesce(tt, translated_text) AS translated_text, CASE WHEN tt IS NULL THEN status ELSE 'accepted' END AS status, coalesce(good.source_hash, tr.source_hash) AS source_hash,
            CASE WHEN tt IS NULL THEN updated_at ELSE '{_NOW}' END AS updated_at, CASE WHEN tt IS NOT NULL THEN 'openai/m' END AS provider FROM tr FULL JOIN good ON good.segment_id = tr.segment_id""",
        "apply_outcome": f"WITH {_SEG}, {_BUNDLE} SELECT task_id, CASE WHEN bad THEN 0 ELSE n END AS applied_segments, bad AS skipped FROM (SELECT task_id, n, task_id IN (SELECT task_id FROM e) AS bad FROM hd)",
        "inline_match": f"""WITH {_SEG}, {_BUNDLE}, q AS (SELECT *, NOT open AND list_sort(spans) = ['a', 'b'] AS fits FROM j WHERE mapped AND mv = 5),
            r AS (SELECT *, string_split(regexp_replace(t, '``[^`]*``|`[^`]*`', chr(1), 'g'), chr(1)) AS x FROM q)
            SELECT task_id, p AS pos, CASE WHEN fits THEN array_to_string(list_filter(['text:' || x[1], 'code:' || spans[1], 'text:' || x[2], 'code:' || spans[2], 'text:' || x[3]], lambda y: y <> 'text:'), '|') END AS parts,
            CASE WHEN fits THEN array_to_string(x, '') END AS texts FROM r""",
        "placeholders": f"WITH {_SEG}, {_BUNDLE} SELECT segment_id, array_to_string(regexp_extract_all(t, {_PH}), '|') AS found, regexp_replace(s, {_PH}, '_', 'g') AS bare FROM b",
        "list_marker": f"""WITH {_SEG}, {_BUNDLE}, q AS (SELECT segment_id, ['', '- ', '* [ ] ', '12. ', '1) ', '  + ', '-', '- [X]  ', '- [y] '][(p % 9 + 1)::INT] || norm AS x FROM b)
            SELECT segment_id, regexp_extract(x, {_MARK}, 1) AS marker FROM q""",
        "identical": f"WITH {_SEG}, {_BUNDLE} SELECT segment_id, {_comparable('s')} AS source, {_comparable('t')} AS target FROM b",
        "ordered_ids": """WITH t AS (SELECT conv_id, turn AS pos, turn::VARCHAR AS id FROM conversations), f AS (SELECT conv_id, pos, CASE WHEN conv_id % 3 = 0 THEN '0' WHEN conv_id % 3 = 1 THEN id || 'x' ELSE id END AS id FROM t),
            k AS (SELECT conv_id, id, count(*) AS n FROM f GROUP BY ALL), w AS (SELECT DISTINCT conv_id, id FROM t)
            SELECT conv_id, id, 'id_duplicate' AS code FROM k WHERE n > 1 UNION ALL SELECT conv_id, id, 'id_unknown' FROM k ANTI JOIN w USING (conv_id, id) UNION ALL SELECT conv_id, id, 'id_missing' FROM w ANTI JOIN k USING (conv_id, id)
            UNION ALL SELECT f.conv_id, f.id, 'id_out_of_order' FROM f JOIN t ON f.conv_id = t.conv_id AND f.pos = t.pos WHERE f.id <> t.id""",
        "task_manifest": f"WITH {_ORDERS} SELECT task_id, page_url, content_count, status, completed_at, last_verify_status, last_verify_error_count, last_run_status FROM ent",
        "manifest_order": f"WITH {_ORDERS} SELECT task_id, status, page_url FROM ent ORDER BY {_RANK}, page_url, task_id LIMIT 50",
        "manifest_board": f"""WITH {_ORDERS} SELECT '- ' || CASE WHEN status IN ('done', 'applied') THEN '[x] ' ELSE '[ ] ' END || task_id || ' | ' || status || ' | ' || content_count || ' items' || CASE WHEN title IS NULL THEN '' ELSE ' | ' || title END || ' | ' || page_url
            || CASE WHEN last_verify_status IS NULL THEN '' ELSE ' | verify ' || last_verify_status || CASE WHEN last_verify_error_count > 0 THEN ' (' || last_verify_error_count || ' errors)' ELSE '' END END
            || CASE WHEN last_run_status IS NULL THEN '' ELSE ' | last run failed: no answer' END AS line FROM ent""",
        "manifest_summary": f"WITH {_ORDERS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'applied') AS applied, count(*) FILTER (WHERE status = 'invalid') AS invalid FROM ent",
        "runtime_manifest": f"WITH {_SEG}, {_RUNTIME} SELECT page_url, slot, source_text, translated_text FROM rk WHERE translated_text = most",
        "runtime_conflicts": f"WITH {_SEG}, {_RUNTIME} SELECT page_url, count(*) FILTER (WHERE translated_text <> most) AS conflict_count FROM rk GROUP BY page_url",
        "run_summary": """WITH a AS (SELECT user_id::VARCHAR AS task_id, event_id % 4 AS chunk, (event_id % 3 + 1)::INT AS attempt, event_type <> 'error' AS ok FROM events), c AS (SELECT task_id, chunk, bool_or(ok) AS ok, max(attempt) AS n FROM a GROUP BY ALL),
            t AS (SELECT task_id, bool_and(ok) AS ok, max(n) FILTER (WHERE NOT ok) AS n FROM c GROUP BY task_id) SELECT count(*) AS completed, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE NOT ok) AS failed, max(n) AS failure_attempts FROM t""",
        "run_state": """WITH ev AS (SELECT user_id::VARCHAR AS run_id, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'queued' ELSE CASE event_type WHEN 'signup' THEN 'started' WHEN 'click' THEN 'attempt' WHEN 'view' THEN 'attemptCompleted' WHEN 'purchase' THEN 'completed' ELSE 'failed' END END AS type,
              epoch_us(ts) // 1000 AS at, 't' || (event_id % 3) AS task_id, CASE WHEN event_id % 2 = 0 THEN 't' || (event_id % 3) || 'a' END AS activity_id, (event_id % 50 + 10)::INT AS total, (event_id % 10)::INT AS completed, (event_id % 7)::INT AS good, (event_id % 4)::INT AS bad FROM events),
            cur AS (SELECT ev.* FROM ev JOIN (SELECT run_id, coalesce(max(seq) FILTER (WHERE type = 'queued'), -1) AS q FROM ev GROUP BY run_id) USING (run_id) WHERE seq >= q),
            fin AS (SELECT a.run_id, a.at - max_by(b.at, b.seq) AS took, max(b.seq) AS began, a.seq, a.task_id FROM cur a JOIN cur b ON b.run_id = a.run_id AND b.task_id = a.task_id AND b.seq < a.seq AND b.type = 'started' WHERE a.type = 'completed' GROUP BY a.run_id, a.task_id, a.seq, a.at),
            took AS (SELECT run_id, avg(took) AS mean FROM fin WHERE NOT EXISTS (SELECT 1 FROM cur x WHERE x.run_id = fin.run_id AND x.task_id = fin.task_id AND x.type IN ('completed', 'failed') AND x.seq > fin.began AND x.seq < fin.seq) GROUP BY run_id),
            run AS (SELECT run_id, count(DISTINCT coalesce(activity_id, task_id))::INT AS running FROM cur a WHERE type = 'attempt' AND NOT EXISTS (SELECT 1 FROM cur x WHERE x.run_id = a.run_id AND x.task_id = a.task_id AND x.type IN ('completed', 'failed') AND x.seq > a.seq) GROUP BY run_id),
            s AS (SELECT run_id, arg_max(total, seq) AS total, coalesce(arg_max(completed, seq) FILTER (WHERE type <> 'queued'), 0) AS completed, coalesce(arg_max(good, seq) FILTER (WHERE type IN ('completed', 'failed')), 0) AS success_count,
              coalesce(arg_max(bad, seq) FILTER (WHERE type IN ('completed', 'failed')), 0) AS failure_count, count(*) FILTER (WHERE type = 'attempt') AS total_attempts, count(*) FILTER (WHERE type = 'attemptCompleted') AS successful_attempts FROM cur GROUP BY run_id)
            SELECT run_id, total, completed, success_count, failure_count, coalesce(running, 0) AS running, greatest(0, total - completed - coalesce(running, 0)) AS waiting, total_attempts, successful_attempts,
            CASE WHEN total_attempts > 0 THEN successful_attempts * 100.0::DOUBLE / total_attempts ELSE 100.0::DOUBLE END AS success_rate, coalesce(mean, 0.0::DOUBLE) AS mean_duration_ms FROM s LEFT JOIN run USING (run_id) LEFT JOIN took USING (run_id)""",
        "progress_metrics": "SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) AS last_at FROM events GROUP BY user_id",
        "run_progress": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) AS last_at, min(event_type) FILTER (WHERE k = 1) AS last_kind FROM r GROUP BY user_id",
        "issue_topk": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY value DESC NULLS LAST, event_id LIMIT 5",
        "issue_sample": "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'error') SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) || CASE WHEN min(n) > 5 THEN ',... and ' || (min(n) - 5) || ' more' ELSE '' END AS sample FROM r WHERE k <= 5 GROUP BY user_id",
        "asset_paths": r"""WITH u AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/+', '') AS s, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) AS q FROM pages),
            w AS (SELECT *, CASE WHEN s = '' THEN 'assets/index' ELSE s END AS plain FROM u), x AS (SELECT *, regexp_extract(plain, '[^/](\.[^./]*)$', 1) AS ext FROM w)
            SELECT page_id, substr(plain, 1, length(plain) - length(ext)) || CASE WHEN q = '' THEN '' ELSE '__q_' || substr(sha256(q), 1, 12) END || ext AS asset_path, sha256(url) || '.bin' AS cache_name,
            CASE page_id % 4 WHEN 0 THEN starts_with(url, 'https:') WHEN 1 THEN starts_with(url, 'http:') WHEN 2 THEN regexp_matches(upper(regexp_extract(url, '^(https?)', 1)), '^HTTP$') ELSE false END AS same FROM x""",
        "link_rewrite": rf"""WITH {_URL}, a AS (SELECT page_id, o, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS h FROM c), k AS (SELECT DISTINCT page_id, o || h AS link FROM a UNION SELECT page_id, url FROM pages),
            kc AS (SELECT page_id, link, lower(regexp_extract(link, '^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_replace(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') END || regexp_extract(link, '^[^?#]*(\?[^#]*)', 1) AS target FROM k)
            SELECT kc.page_id, link, CASE WHEN man.url IS NULL THEN link ELSE '/mirror/' || regexp_replace(output_path, '(^|/)index\.html$', '\1') || regexp_extract(link, '(#.*)$', 1) END AS rewritten FROM kc LEFT JOIN man ON man.url = target""",
        "srcset": rf"""WITH g AS (SELECT p_partkey, {_varied(C.SRCSETS, "p_partkey", "p_partkey::VARCHAR")} AS s FROM part), l AS (SELECT p_partkey, list_filter(list_transform(string_split(s, ','), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS c FROM g)
            SELECT p_partkey, array_to_string(list_transform(c, lambda x: '/mirror' || x), ', ') AS srcset FROM l""",
        "css_urls": rf"""WITH g AS (SELECT p_partkey, {_varied(C.STYLES, "p_partkey", "p_partkey::VARCHAR")} AS s FROM part)
            SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(s, 'url\(\s*(?:"[^"]*"|''[^'']*''|[^"''()\s]+)\s*\)'), lambda x: regexp_replace(x, '^url\(\s*["'']?|["'']?\s*\)$', '', 'g')), '|') AS urls FROM g""",
        "code_spans": rf"""WITH RECURSIVE g AS (SELECT p_partkey, {spans} AS s FROM part),
            w(k, s, rest, texts, spans, ok) AS (SELECT p_partkey, s, s, []::VARCHAR[], []::VARCHAR[], true FROM g UNION ALL
              SELECT k, s, CASE WHEN c = 0 THEN rest ELSE substr(tail, c + length(f)) END, list_append(texts, substr(rest, 1, a - 1)), list_append(spans, substr(tail, 1, c - 1)), c > 0
              FROM (SELECT *, strpos(tail, f) AS c FROM (SELECT *, substr(rest, a + length(f)) AS tail FROM (SELECT *, strpos(rest, '`') AS a, regexp_extract(rest, '`+') AS f FROM w WHERE ok AND contains(rest, '`'))))),
            d AS (SELECT * FROM w WHERE NOT ok OR NOT contains(rest, '`')), lg AS (SELECT p_partkey, coalesce(list_max(list_transform(regexp_extract_all(s, '`+'), lambda x: length(x))), 0) + 1 AS n FROM g)
            SELECT k AS p_partkey, CASE WHEN ok THEN array_to_string(spans, '|') END AS spans, CASE WHEN ok THEN array_to_string(list_append(texts, rest), '|') END AS texts, repeat('`', n) || s || repeat('`', n) AS fenced FROM d JOIN lg ON lg.p_partkey = k""",
        "markup": rf"""WITH g AS (SELECT p_partkey, p_size, {_varied(C.MARKUPS, "p_partkey", "p_name")} AS s FROM part), h AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN s ELSE replace(s, '~~', '') END AS t FROM g),
            q AS (SELECT *, {_bare("s")} AS sb, {_bare("t")} AS tb FROM h) SELECT p_partkey, {", ".join(f"{_count('sb', n)}::INT AS {n}" for n in (*_CLASSES, "links"))}, {_markup_broken("sb", "tb")} AS mismatch FROM q""",
        "json_repair": "SELECT event_id, CASE WHEN event_id % 8 IN (4, 5) THEN NULL WHEN event_id % 8 = 7 THEN '[1, 2]' ELSE props END AS repaired FROM events",
        "glossary": rf"""WITH {_SEG}, g(term, target) AS (VALUES ('and', 'und'), ('the', 'das'), ('a', 'ein')), q AS (SELECT segment_id, norm AS s, 'neu ' || norm AS t FROM seg)
            SELECT segment_id, term, target FROM q, g WHERE regexp_matches(s, '(?i)(?:^|{_N})' || term || '(?:$|{_N})') AND NOT regexp_matches(t, '(?i)(?:^|{_N})' || target || '(?:$|{_N})')
            UNION ALL SELECT segment_id, 'Übung', 'x' FROM q WHERE contains(lower(s), 'übung') AND NOT regexp_matches(t, '(?i)(?:^|{_N})x(?:$|{_N})')
            UNION ALL SELECT segment_id, 'DE LA', 'neu' FROM q WHERE contains(lower(s), 'de la') AND NOT regexp_matches(t, '(?i)(?:^|{_N})neu(?:$|{_N})')""",
        "status": f"""WITH {_SEG}, {_ORDERS} SELECT (SELECT count(*) FROM seg) AS segments, (SELECT count(DISTINCT page_url) FROM seg) AS pages, 0 AS assets, count(*) AS translations, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'draft') AS draft,
            (SELECT count(*) FROM ent WHERE status = 'pending') AS pending_tasks, (SELECT count(*) FROM ent WHERE status = 'done') AS done_tasks, (SELECT count(*) FROM ent WHERE status = 'applied') AS applied_tasks, (SELECT count(*) FROM ent WHERE status = 'invalid') AS invalid_tasks FROM tr""",
        "retries": """SELECT event_id, s AS status, attempt::INT AS attempt, (CASE event_id % 6 WHEN 1 THEN 3000 WHEN 2 THEN 2500 WHEN 4 THEN 30000 WHEN 5 THEN 0 ELSE 500 * (1 << attempt::INT) END)::BIGINT AS wait_ms
            FROM (SELECT event_id, [200, 404, 408, 429, 500, 501, 503, 504][event_id % 8 + 1] AS s FROM events), range(2) r(attempt) WHERE s IN (408, 429, 500, 502, 503, 504)""",
        "request_errors": """WITH q AS (SELECT event_id, ['', 'ECONNRESET', 'ETIMEDOUT', 'ENOTFOUND'][event_id % 4 + 1] AS c, ['socket hang up', 'Timeout of x', '  ', 'getaddrinfo', 'refused'][event_id % 5 + 1] AS m FROM events), r AS (SELECT *, c = 'ETIMEDOUT' OR contains(lower(m), 'timeout') AS late FROM q)
            SELECT event_id, CASE WHEN late THEN 'Request timed out after 15000ms' ELSE CASE WHEN c = '' THEN '' ELSE c || ': ' END || CASE WHEN trim(m) = '' THEN 'Network request failed' ELSE trim(m) END END AS message, late AS timed_out FROM r""",
        "robots": r"""WITH q AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p FROM pages)
            SELECT page_id, starts_with(p, '/en/1') OR NOT (starts_with(p, '/e') OR ends_with(p, '5') OR regexp_matches(p, '^/fr/.*3')) AS allowed FROM q""",
        "mime": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'text/html' WHEN event_id % 5 = 0 THEN 'image/png' WHEN event_id % 5 = 1 THEN 'image/jpeg'
            ELSE ['text/css', 'image/png', 'application/octet-stream', 'application/octet-stream', 'font/woff2'][(user_id % 5 + 1)::INT] END AS content_type FROM events""",
        "crawl_pages": rf"WITH RECURSIVE {_CRAWL} SELECT url, depth, status, CASE WHEN path = '/' THEN 'index.html' WHEN contains(path, '.') THEN substr(path, 2) ELSE substr(path, 2) || '/index.html' END AS output_path FROM t WHERE allowed AND status = 200 AND is_html",
        "crawl_assets": f"WITH RECURSIVE {_CRAWL} SELECT url, 'application/pdf' AS content_type, substr(path, 2) AS output_path FROM t WHERE allowed AND status = 200 AND NOT is_html",
        "crawl_issues": f"WITH RECURSIVE {_CRAWL} SELECT 'page-fetch' AS kind, url, status, CASE WHEN status IS NULL THEN 'ETIMEDOUT' END AS code, attempt_count FROM t WHERE allowed AND (status IS NULL OR status >= 400)",
        "crawl_stats": f"""WITH RECURSIVE {_CRAWL} SELECT count(*) FILTER (WHERE allowed AND (status IS NULL OR status >= 400)) AS page_failures, 0 AS asset_failures, 0 AS invalid_links, count(*) FILTER (WHERE NOT allowed) AS skipped_by_robots,
            sum(attempt_count - 1) FILTER (WHERE allowed)::BIGINT AS retried_requests, count(*) FILTER (WHERE allowed AND status IS NULL) * 3 AS timed_out_requests FROM t""",
        "chunk_plan": _chunk_sql(10, 600, 900),
        "chunk_drafts": f"""WITH {_SEG}, {_BUNDLE}, v AS (SELECT task_id, (p // 4 + 1)::INT AS chunk_index, p % 4 AS k, id, t FROM b), d AS (SELECT *, CASE WHEN chunk_index % 5 = 0 AND k = 1 THEN 'x' ELSE id END AS got FROM v WHERE (chunk_index + length(t)) % 4 > 0 OR k > 0),
            c AS (SELECT v.task_id, v.chunk_index, count(*) AS n, count(d.got) AS m, count(*) FILTER (WHERE d.got <> v.id) AS moved FROM v LEFT JOIN d ON d.task_id = v.task_id AND d.chunk_index = v.chunk_index AND d.k = v.k GROUP BY ALL)
            SELECT task_id, chunk_index, CASE WHEN m = 0 THEN 'draft_missing' WHEN n <> m THEN 'draft_count_mismatch' ELSE 'draft_id_mismatch' END AS code FROM c WHERE m = 0 OR n <> m OR moved > 0""",
        "segments_h1": rf"""WITH h AS (SELECT url AS page_url, replace(replace(replace(regexp_extract(html, '<article><h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS x FROM pages), n AS (SELECT page_url, regexp_replace(regexp_replace(x, '{T.WHITE}+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM h)
            SELECT page_url, 'root[0]/#text[0]' AS dom_path, sha256(page_url || '::root[0]/#text[0]::text::') AS segment_id, norm AS normalized_text, sha256(norm) AS source_hash FROM n WHERE norm <> ''""",
        "segments_nav": rf"""WITH a AS (SELECT url AS page_url, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a [^>]*>([^<]*)</a></li>', 1) AS x, regexp_extract(html, '<footer>([^<]*)</footer>', 1) AS f, repeat('b[0]/', len(regexp_extract_all(html, '<b>'))::INT) AS bold FROM pages),
            b AS (SELECT page_url, unnest(range(1, len(x))) AS i, x FROM a), c AS (SELECT page_url, 'root[' || (i - 1) || ']/#text[0]' AS dom_path, x[i + 1] AS t, 'a' AS tag_name FROM b UNION ALL SELECT page_url, 'root[' || (len(x) - 1) || ']/' || bold || '#text[0]', f, CASE WHEN bold = '' THEN 'footer' ELSE 'b' END FROM a),
            d AS (SELECT page_url, dom_path, tag_name, replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t FROM c)
            SELECT page_url, dom_path, regexp_replace(regexp_replace(t, '{T.WHITE}+', ' ', 'g'), '^ | $', '', 'g') AS normalized_text, tag_name FROM d WHERE regexp_replace(t, '{T.WHITE}+', '', 'g') <> ''""",
        "html_links": r"""WITH a AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/x/y' AS page_url, unnest(list_distinct(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1))) AS h, page_id FROM pages)
            SELECT page_url, count(*) AS links, count(DISTINCT h) AS targets FROM a GROUP BY page_url""",
        "build_links": r"""WITH a AS (SELECT DISTINCT url AS page_url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS raw FROM pages) SELECT page_url, raw, '/mirror' || raw || '/' AS rewritten FROM a WHERE raw IN ('/de', '/the', '/in')""",
    }
