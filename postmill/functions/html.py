"""HTML to text, element extraction, entity decoding and URLs (Column -> Column).

Pages are read with regular expressions and array functions only, so every step stays in the
JVM. Markup is taken as captured: no repair of badly nested tags is attempted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import apply_sql, as_col, clean_text, let, strip

_RAW_TEXT_TAGS = ("script", "style", "template")

# Elements a browser lays out on lines of their own.
_BLOCK_TAGS = (
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td th thead tr ul"
).split()

# Every alternative starts with '<', so text between tags is passed over by one comparison.
_TAG = r"(?s)<(?:/?[a-zA-Z][^>]*|![^>]*|\?[^>]*)>"


def _drop_pattern(tags) -> str:
    blocks = "|".join(rf"{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in tags)
    return rf"(?is)<(?:!--.*?(?:-->|\z)|{blocks})"


def strip_html(c: Column | str, decode_first: bool = False, drop: tuple[str, ...] = ()) -> Column:
    """Visible text: scripts, styles and comments go, tags become spaces, entities are decoded.

    ``decode_first`` is for double-escaped content, whose tags only appear after decoding.
    """
    html = F.coalesce(as_col(c), F.lit(""))
    if decode_first:
        html = decode_entities(html)
    html = F.regexp_replace(html, _drop_pattern((*_RAW_TEXT_TAGS, *drop)), " ")
    return clean_text(decode_entities(F.regexp_replace(html, _TAG, " ")))


def rendered_text(c: Column | str) -> Column:
    """Text as laid out on screen: block elements start new lines, inline tags leave no gap."""
    html = F.regexp_replace(F.coalesce(as_col(c), F.lit("")), _drop_pattern((*_RAW_TEXT_TAGS, "noscript")), "")
    html = F.regexp_replace(html, r"[\t\n\f\r ]+", " ")
    html = F.regexp_replace(html, rf"(?i)</?(?:{'|'.join(_BLOCK_TAGS)})\b[^>]*>", "\n")
    return strip(decode_entities(F.regexp_replace(html, _TAG, "")))


# --- entities -----------------------------------------------------------------------------


def _map(entries: dict[str, str]) -> str:
    """SQL of a string map; the optimizer folds it to one literal."""
    return "from_json(r'" + json.dumps(entries).replace("'", r"\u0027") + "', 'map<string,string>')"


# Names come from the standard library's HTML 5 table; old ones may lack the semicolon.
_NAMED = _map({name.rstrip(";"): text for name, text in html5.items()})
_BARE = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# The handful of entities that make up nearly all of real text.
_COMMON = _map({"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "nbsp;": "\u00a0", "#39;": "'"})
# Code points 128-159 mean Windows-1252 characters.
_C1 = _map({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)})
# References to control characters and noncharacters are dropped.
_PLANES = ["", *"123456789abcdef", "10"]
_SILENT = (
    r"[\x01-\x08\x0b\x0e-\x1f\x7f\x{fdd0}-\x{fdef}" + "".join(rf"\x{{{p}fffe}}\x{{{p}ffff}}" for p in _PLANES) + "]"
)
_TOKEN = "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]{1,31};?)"

# token of a numeric reference -> its character, by the HTML rules for odd code points
_NUMERIC = f"""transform(transform(array(ltrim('0', regexp_replace(x.token, '[#xX;]', ''))),
    d -> CASE WHEN d = '' THEN 0L WHEN length(d) > 8 THEN NULL
         WHEN x.token RLIKE '^#[xX]' THEN bigint(conv(d, 16, 10)) ELSE try_cast(d AS bigint) END),
    c -> CASE WHEN c BETWEEN 1 AND 55295 OR c BETWEEN 57344 AND 1114111
         THEN coalesce(try_element_at({_C1}, string(c)),
              regexp_replace(decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32'), r'{_SILENT}', ''))
         ELSE chr(0) END)[0]""".replace("chr(0)", "'\\uFFFD'")

# x.part is the text after an ampersand, x.token the reference it may start with.
_REFERENCE = f"""CASE WHEN x.token = '' THEN concat('&', x.part) ELSE coalesce(
    concat(coalesce(try_element_at({_COMMON}, x.token), CASE WHEN startswith(x.token, '#') THEN {_NUMERIC} END),
           substr(x.part, length(x.token) + 1)),
    transform(array({_NAMED}), names -> coalesce(
      concat(CASE WHEN endswith(x.token, ';') THEN try_element_at(names, rtrim(';', x.token)) END, substr(x.part, length(x.token) + 1)),
      transform(array(regexp_extract(x.part, '^(?:{_BARE})', 0)),
        n -> concat(try_element_at(names, n), substr(x.part, length(n) + 1)))[0]))[0],
    concat('&', x.part)) END"""

_DECODE = f"""t -> CASE WHEN NOT contains(t, '&') THEN t ELSE transform(array(split(t, '&')), parts -> concat(parts[0],
    array_join(transform(transform(slice(parts, 2, size(parts)),
      p -> struct(p AS part, regexp_extract(p, '{_TOKEN}', 1) AS token)), x -> {_REFERENCE}), '')))[0] END"""


def decode_entities(c: Column | str) -> Column:
    """Decode character references once, left to right; text without '&' pays one search."""
    return apply_sql(as_col(c), _DECODE)


# --- elements -----------------------------------------------------------------------------


def attr_contains(attr: str, text: str) -> str:
    """Regex of an attribute whose value holds ``text``."""
    t = re.escape(text)
    return rf"""\b{attr}\s*=\s*(?:"[^"]*{t}[^"]*"|'[^']*{t}[^']*')"""


def class_token(token: str) -> str:
    """Regex of a class attribute listing exactly ``token``."""
    t = re.escape(token)
    return rf"""\bclass\s*=\s*(?:"(?:[^"]*\s)?{t}(?:\s[^"]*)?"|'(?:[^']*\s)?{t}(?:\s[^']*)?')"""


def opening(tag: str = "[a-zA-Z][a-zA-Z0-9]*", attribute: str = "") -> str:
    """Regex of an opening tag, optionally with an attribute."""
    return rf"<{tag}\b[^>]*?{attribute}[^>]*>" if attribute else rf"<{tag}\b[^>]*>"


# s is the page from the element's opening tag on. It is split before every opening or closing
# tag of the same name; pieces are kept until the nesting depth is back at zero. An element that
# is never closed runs to the end of the page. One that holds none of its name is its first piece.
_INNER = r"""s -> CASE WHEN s <> '' THEN transform(
    array(split(s, concat('(?i)(?=</?', regexp_extract(s, '^<([a-zA-Z][a-zA-Z0-9]*)', 1), r'\b)'))),
    pieces -> CASE WHEN startswith(get(pieces, 1), '</') THEN regexp_replace(pieces[0], '^<[^>]*>', '') ELSE regexp_replace(array_join(slice(pieces, 1, aggregate(pieces,
        struct(0 AS depth, 0 AS kept, false AS closed),
        (a, p) -> CASE WHEN a.closed THEN a ELSE transform(array(a.depth + IF(startswith(p, '</'), -1, 1)),
          d -> struct(d AS depth, a.kept + 1 AS kept, d <= 0 AS closed))[0] END,
        a -> IF(a.closed, a.kept - 1, size(pieces)))), ''), '^<[^>]*>', '') END)[0] END"""


def element_inner(html: Column | str, open_tag: str) -> Column:
    """Inner HTML of the first element whose opening tag matches; NULL if there is none."""
    return apply_sql(F.regexp_extract(as_col(html), f"(?is){open_tag}.*", 0), _INNER)


# Where a page is cut: before each tag. Piece 0 is what stands before the first one.
_PIECES = r"(?i)(?=<(?:/?[a-z]|!))"
_NAME = "^<(/?[a-zA-Z][a-zA-Z0-9]*)"

# x.events are the places at which elements of one name open (1) and close (2), and their containers (3, 4), x.n the number of pieces. The stack holds the
# places of open elements, and -1 for an open container. An element in a container is ended by the next one of its name there, and with the container.
# Spans are gathered as text, "s,e;" each: a fold copies what it has gathered with every event, and text is copied whole.
_SPANS = """x -> aggregate(x.events, struct(CAST(array() AS array<int>) AS open, '' AS spans),
    (a, v) -> transform(array(coalesce(try_element_at(a.open, -1), -1)), top -> transform(array(top >= 0 AND (v.k IN (2, 4) OR v.k = 1 AND x.listed)),
      ends -> transform(array(IF(ends, slice(a.open, 1, size(a.open) - 1), a.open)),
        open -> struct(CASE WHEN v.k = 1 THEN array_append(open, v.i) WHEN v.k = 3 THEN array_append(open, -1)
          WHEN v.k = 4 AND size(open) > 0 THEN slice(open, 1, size(open) - 1) ELSE open END AS open,
          IF(ends, concat(a.spans, top, ',', v.i, ';'), a.spans) AS spans))[0])[0])[0],
    a -> concat(transform(slice(split(a.spans, ';'), 1, length(a.spans) - length(replace(a.spans, ';', ''))),
        p -> struct(CAST(substring_index(p, ',', 1) AS int) AS s, CAST(substring_index(p, ',', -1) AS int) AS e)),
      transform(filter(a.open, o -> o >= 0), o -> struct(o AS s, x.n AS e))))"""

# Elements whose end tag may be left out, and what contains them.
_LISTS = {"li": ("ul", "ol", "menu"), "tr": ("table",)}


def pieces(html: Column | str) -> Column:
    """The page, cut before each of its tags."""
    return F.split(as_col(html), _PIECES)


def tag_names(parts: Column) -> Column:
    """The lower-cased name of the tag that each piece begins with, with a slash for an end tag; '' for none."""
    return F.transform(parts, lambda p: F.lower(F.regexp_extract(p, _NAME, 1)))


def element_spans(names: Column, name: Column) -> Column:
    """(s, e) of every element called ``name``, from :func:`tag_names`: it begins with piece s and ends before piece e.

    End tags are matched to the last open element of the name. One that is never closed runs to the end of the page, or of its list or table.
    """
    owners = F.create_map(*[F.lit(x) for k, v in _LISTS.items() for x in (k, list(v))])

    def spans(x: Column) -> Column:
        # Most tags are none of these; one search for a name's place in the list turns them away.
        at = F.filter(F.transform(x["names"], lambda n, i: F.struct(i.alias("i"), F.array_position(x["wanted"], n).alias("p"))), lambda v: v["p"] > 0)
        kind = lambda p: F.when(p <= 2, p.cast("int")).when(p <= 2 + x["owners"], 3).otherwise(4)
        events = F.transform(at, lambda v: F.struct(v["i"].alias("i"), kind(v["p"]).alias("k")))
        return apply_sql(F.struct(events.alias("events"), F.size(x["names"]).alias("n"), (x["owners"] > 0).alias("listed")), _SPANS)

    def listed(x: Column) -> Column:
        end = lambda n: F.concat(F.lit("/"), n)
        wanted = F.concat(F.array(x["name"], end(x["name"])), x["inside"], F.transform(x["inside"], end))
        return F.struct(x["names"].alias("names"), wanted.alias("wanted"), F.size(x["inside"]).alias("owners"))

    inside = F.coalesce(F.try_element_at(owners, name), F.array().cast("array<string>"))
    return let(let(F.struct(names.alias("names"), name.alias("name"), inside.alias("inside")), listed), spans)


def joined(parts: Column, start: Column, end: Column) -> Column:
    """The source of the pieces from ``start`` up to ``end``."""
    return F.array_join(F.slice(parts, start + 1, end - start), "")


def first_element(html: Column, open_tags: Sequence[str]) -> Column:
    """Inner HTML for the first of several opening tags that occurs in the page."""
    return let(html, lambda page: F.coalesce(*[element_inner(page, t) for t in open_tags]))


def without_scripts(html: Column | str, extra: tuple[str, ...] = ()) -> Column:
    return F.regexp_replace(F.coalesce(as_col(html), F.lit("")), _drop_pattern((*_RAW_TEXT_TAGS, *extra)), " ")


ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>.*?(?=</a\s*>|<a\b|\z)"""


def anchors(html: Column | str, pattern: str = ANCHOR) -> Column:
    """Array of anchor sources (opening tag and content) in page order."""
    return F.regexp_extract_all(as_col(html), F.lit(pattern), 0)


def attribute(tag_source: Column | str, name: str) -> Column:
    """Decoded attribute value of the leading tag, '' if absent."""
    both = rf"""(?is)^<[^>]*?\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    src = as_col(tag_source)
    return decode_entities(F.concat(F.regexp_extract(src, both, 1), F.regexp_extract(src, both, 2)))


def embedded_json(html: Column | str, pattern: str) -> Column:
    """First group of ``pattern`` in the page, NULL if the page does not hold it."""
    found = F.regexp_extract(as_col(html), pattern, 1)
    return F.nullif(found, F.lit(""))


def json_unescape(c: Column | str) -> Column:
    """Decode the body of a JSON string literal; NULL if it is not one."""
    wrapped = F.concat(F.lit('{"v":"'), as_col(c), F.lit('"}'))
    return F.from_json(wrapped, "v string")["v"]


# --- URLs ---------------------------------------------------------------------------------


# Walks path segments, dropping '.' and letting '..' take away the segment before it.
_DOTS = """transform(array(split(p, '/')), g -> concat('/', ltrim('/', array_join(
    concat(aggregate(g, CAST(array() AS array<string>), (acc, e) -> CASE WHEN e = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0))
             WHEN e = '.' THEN acc ELSE array_append(acc, e) END),
           IF(element_at(g, -1) IN ('.', '..'), array(''), array())), '/'))))[0]"""

_SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*:"
_BASE = rf"^(({_SCHEME})(?://[^/?#]*)?)([^?#]*)"

# x.b is the base, x.h the reference; only paths with a dot segment need the segment walk.
_RESOLVE = f"""x -> CASE WHEN x.h = '' THEN x.b
    WHEN x.h RLIKE r'^{_SCHEME}' THEN x.h
    WHEN startswith(x.h, '//') THEN concat(regexp_extract(x.b, r'{_BASE}', 2), x.h)
    WHEN startswith(x.h, '?') THEN concat(regexp_extract(x.b, r'{_BASE}', 1), regexp_extract(x.b, r'{_BASE}', 3), x.h)
    WHEN startswith(x.h, '#') THEN concat(regexp_extract(x.b, '^([^#]*)', 1), IF(x.h = '#', '', x.h))
    ELSE concat(regexp_extract(x.b, r'{_BASE}', 1),
      transform(array(IF(startswith(x.h, '/'), regexp_extract(x.h, '^([^?#]*)', 1), regexp_replace(
          coalesce(nullif(regexp_replace(regexp_extract(x.b, r'{_BASE}', 3), '[^/]*$', ''), ''), '/')
          || regexp_extract(x.h, '^([^?#]*)', 1), '/+', '/'))),
        p -> CASE WHEN p RLIKE r'/[.][.]?(?:/|$)' THEN {_DOTS} ELSE p END)[0],
      regexp_extract(x.h, '^[^?#]*(.*)$', 1)) END"""


def absolutize_url(base: Column | str, href: Column | str) -> Column:
    """Resolve ``href`` against ``base`` (RFC 3986 reference resolution)."""
    return apply_sql(F.struct(as_col(base).alias("b"), F.trim(as_col(href)).alias("h")), _RESOLVE)
