"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of ECMAScript's \s, as a class both Java and RE2 read.
WHITE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Fixed value: placeholders that a translation has to keep, in order of precedence.
PLACEHOLDER = r"\{\{[^{}]+\}\}|\{[A-Za-z0-9_.-]+\}|%(\d+\$)?[+#0\- ]*(?:\d+|\*)?(?:\.(?:\d+|\*))?[sdifo]|<\/?\d+>|\$[A-Z_][A-Z0-9_]*"
#: Fixed value: the list marker, or task box, that a translation has to begin with.
LIST_MARKER = rf"^{WHITE}*(?:[-*+]{WHITE}+\[(?: |x|X)\]|[-*+]|\d+\.){WHITE}+"
#: A text, the fence of backticks after it, the code, and the same fence; always from where the last one ended.
_SPAN = r"\G([^`]*)(`++)([\s\S]*?)\2"


def normalize(text: Column) -> Column:
    """White space collapsed to single spaces and trimmed; most texts are that already, which a cheap look tells."""
    other = text.rlike(r"[^ -~\x{A1}-\x{167F}]")  # all white space but the plain space is among these
    touched = other | F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    return F.when(touched, F.regexp_replace(F.regexp_replace(text, f"{WHITE}+", " "), r"^ | \z", "")).otherwise(text)


def normalize_ends(text: Column) -> Column:
    """Trimmed, white space inside left as it is."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(WHITE), F.regexp_replace(text, rf"^{WHITE}+|{WHITE}+\z", "")).otherwise(text)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def may_hold_placeholders(text: Column) -> Column:
    """False only for texts without any placeholder: each begins with one of four characters."""
    return text.rlike(r"[{%<$]")


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), 1)


def without_placeholders(text: Column, instead: str = " ") -> Column:
    return F.when(may_hold_placeholders(text), F.regexp_replace(text, PLACEHOLDER, instead)).otherwise(text)


def heading_level(tag: Column) -> Column:
    """1 to 6 for a heading's tag, else null."""
    level = F.regexp_extract(tag, "^h([1-6])$", 1)
    return F.when(level != "", level.cast("int"))


def file_stamp(timestamp: Column) -> Column:
    """A timestamp's text as part of a file name."""
    return F.translate(timestamp, ":.", "--")


def list_marker(text: Column) -> Column:
    """The marker with the white space around it; the empty text if there is none."""
    return F.regexp_extract(text, f"({LIST_MARKER})", 1)


def code_spans(text: Column) -> Column:
    """Struct of texts and spans, one text more than spans; null if a fence isn't closed.

    A fence is a whole run of backticks where the text before it ends, and is closed by the next
    place that has as many, whether more follow or not.
    """
    rest = F.regexp_replace(text, _SPAN, "")
    both = F.struct(F.array_append(F.regexp_extract_all(text, F.lit(_SPAN), 1), rest).alias("texts"), F.regexp_extract_all(text, F.lit(_SPAN), 3).alias("spans"))
    plain = F.struct(F.array(text).alias("texts"), F.array().cast("array<string>").alias("spans"))
    return F.when(~F.contains(text, F.lit("`")), plain).when(~F.contains(rest, F.lit("`")), both)


def without_code(text: Column) -> Column:
    """The texts around code joined by spaces; the text as it is if a fence isn't closed."""
    return F.when(F.contains(text, F.lit("`")), F.coalesce(F.array_join(code_spans(text)["texts"], " "), text)).otherwise(text)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also where Spark looks for no common parts."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def comparable(text: Column) -> Column:
    """What is left to compare once code, placeholders, punctuation and case are gone."""
    bare = bound(bound(without_code(text), without_placeholders), normalize)
    return F.lower(bound(F.regexp_replace(bare, r"[\p{P}\p{S}]+", " "), normalize_ends))


def sha(*parts: Column) -> Column:
    """sha256 of the parts joined by two colons; a null part is empty."""
    return F.sha2(F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def json_list(texts: Column) -> Column:
    """An array of texts as a JSON list."""
    return F.to_json(texts)


def plural(count: Column, noun: str) -> Column:
    """``1 page``, ``2 pages``."""
    return F.concat(count.cast("string"), F.lit(f" {noun}"), F.when(count == 1, F.lit("")).otherwise(F.lit("s")))


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, the last three of them dots if some were left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, max(0, most - 3)), F.lit("...")))


def run_duration(ms: Column) -> Column:
    """Milliseconds, to the nearest second, as ``42s`` or ``3m 5s``."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5)).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60), s % 60))


def stage_duration(ms: Column) -> Column:
    """Milliseconds as ``850ms``, ``4.2s`` or, from ten seconds, ``42s``."""
    seconds = ms.cast("double") / 1000
    return F.when(ms < 1000, F.format_string("%dms", ms.cast("long"))).when(ms < 10_000, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%.0fs", seconds))


def chunk_range(heading: Column, first: Column, last: Column) -> Column:
    """``items 1-4``, with the heading if there is one."""
    items = F.format_string("items %d-%d", first, last)
    return F.when(F.coalesce(heading, F.lit("")) == "", items).otherwise(F.concat(items, F.lit(', heading "'), truncated(heading, 60), F.lit('"')))
