"""Code spans, light markup, styles, source sets and model responses as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as T

CSS_URL = r"""url\(\s*(?:"[^"]*"|'[^']*'|[^"'()\s]+)\s*\)"""
#: The classes of light markup that are counted, in text without code.
MARKUP = {
    "bold": r"\*\*[^*\n][\s\S]*?\*\*", "underlined": r"__[^_\n][\s\S]*?__", "struck": r"~~[^~\n][\s\S]*?~~",
    "images": r"!\[[^\]]+\]\([^)]+\)", "links": r"(?<!!)\[[^\]]+\]\([^)]+\)",
}
#: What a text of each class holds at least.
_SIGNS = {"bold": "**", "underlined": "__", "struck": "~~", "images": "](", "links": "]("}
#: How a report names them.
MARKUP_NAMES = {"bold": "boldAsterisk", "underlined": "boldUnderscore", "struck": "strike", "images": "image", "links": "link"}


def fence(code: Column) -> Column:
    """Code in a fence one backtick longer than its longest run of backticks."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), 1), F.length)
    ticks = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    return F.concat(ticks, code, ticks)


def signature(text: Column) -> Column:
    """Struct of counts of bold, underlined and struck text, images and links outside code."""
    plain = T.without_code(text)
    return F.struct(*[F.regexp_count(plain, F.lit(pattern)).alias(name) for name, pattern in MARKUP.items()])


def markup_mismatch(source: Column, target: Column) -> Column:
    """True if a class of markup that the source has is not as frequent in the target."""
    s, t = signature(source), signature(target)
    return F.greatest(*[F.when(F.contains(source, F.lit(_SIGNS[c])), F.coalesce((s[c] > 0) & (s[c] != t[c]), F.lit(False))).otherwise(F.lit(False)) for c in MARKUP])


def match_codes(expected: Column, found: Column) -> Column:
    """For each code found, the place of the expected one that it stands for; null unless it is a permutation.

    ``expected`` and ``found`` are arrays of texts; equal codes are matched in order.
    """
    nth = lambda x, i: F.size(F.filter(F.slice(found, 1, i), lambda y: y == x))
    places = lambda x: F.filter(F.transform(expected, lambda e, k: F.when(e == x, k)), lambda k: k.isNotNull())
    return F.when(F.array_sort(expected) == F.array_sort(found), F.transform(found, lambda x, i: F.get(places(x), nth(x, i))))


def slot_texts(texts: Column, slots: Column) -> Column:
    """The non-blank texts dealt to so many slots in order; the last slot takes all that remain, others may be empty."""
    seen = F.filter(texts, lambda t: t != "")
    rest = F.array_join(F.slice(seen, F.greatest(slots, F.lit(1)), F.greatest(F.size(seen), F.lit(1))), "")
    return F.transform(F.sequence(F.lit(1), slots), lambda k: F.when(k < slots, F.coalesce(F.get(seen, k - 1), F.lit(""))).otherwise(rest))


def css_urls(style: Column) -> Column:
    """The url() values of a style in order; variables and other functions are none."""
    calls = F.regexp_extract_all(style, F.lit(f"({CSS_URL})"), 1)
    return F.transform(calls, lambda c: F.regexp_replace(c, r"""^url\(\s*["']?|["']?\s*\)$""", ""))


def rewrite_style(style: str, target: Callable[[str], str | None]) -> str:
    """A style with each url() value put through ``target``, quotes and space as they are; None leaves a value alone."""

    def one(call: re.Match) -> str:
        inner = call[0][4:-1]
        value = inner.strip()
        quote = value[0] if value[:1] in ("'", '"') else ""
        bare = value[1:-1] if quote else value
        new = target(bare)
        return call[0] if new is None else f"url({inner.replace(value, quote + new + quote, 1)})"

    return re.sub(CSS_URL, one, style)


def rewrite_srcset(srcset: Column, target: Callable[[Column], Column]) -> Column:
    """A source set with each url put through ``target``; descriptors stay, blank candidates go."""
    parts = F.filter(F.transform(F.split(srcset, ","), T.normalize), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(target(F.regexp_extract(p, r"^(\S+)", 1)), F.regexp_replace(p, r"^\S+", ""))), ", ")


def clean_response(raw: Column) -> Column:
    """A model's answer without byte order mark and thinking blocks, and without code fences if they hold all of it."""
    bare = T.normalize_ends(F.regexp_replace(T.normalize_ends(raw), r"(?i)<think\b[^>]*>[\s\S]*?</think>", ""))
    inner = F.regexp_extract(bare, r"^(?i)```(?:json)?\s*([\s\S]*?)\s*```$", 1)
    return F.when(inner != "", T.normalize_ends(inner)).otherwise(bare)


def json_object(raw: Column) -> Column:
    """The answer if it parses as JSON, else what its outermost braces hold if that parses, else null."""
    whole = clean_response(raw)
    inner = F.regexp_extract(whole, r"(?s)(\{.*\})", 1)
    parses = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(parses(whole), whole).when(parses(inner), inner)


def html_safe(json: Column) -> Column:
    """JSON that may stand in a script element."""
    out = json
    for char in "<>&":
        code = f"\\u{ord(char):04x}"
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def has_term(text: Column, term: str) -> Column:
    """Whether a text holds a term, in any case and with white space collapsed; a blank term is in none.

    A term of ASCII letters, digits, underscores and dashes has to stand between word boundaries.
    """
    return has_term_in(T.normalize(text), term)


def has_term_in(text: Column, term: str) -> Column:
    """:func:`has_term` of a text whose white space is collapsed already."""
    bare = re.sub(r"\s+", " ", term.replace("\ufeff", " ")).strip()
    if not bare:
        return F.lit(False)
    if not re.fullmatch(r"[A-Za-z0-9_-]+", bare):
        return F.contains(F.lower(text), F.lower(F.lit(bare)))
    word, same = "[A-Za-z0-9_]", re.escape(bare)
    first = f"(?<={word}{same})" if bare[0] == "-" else f"(?<!{word}{same})"  # after the term, so that it is tried only where the term is
    last = f"(?={word})" if bare[-1] == "-" else f"(?!{word})"
    return text.rlike(f"(?iu){same}{first}{last}")
