"""Text normalisation, keyword and location predicates (Column -> Column)."""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.schema import DEFAULT_KEYWORDS

# The characters Python treats as whitespace, as a Java character class body.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Letters that case-fold to one ASCII letter (other marks drop out later) ...
FOLD_ONE = {
    "\u0130": "i", "\u0149": "n", "\u017f": "s", "\u01f0": "j", "\u1e96": "h",
    "\u1e97": "t", "\u1e98": "w", "\u1e99": "y", "\u1e9a": "a", "\u212a": "k",
}
# ... and letters that case-fold to several.
FOLD_MANY = {
    "\u00df": "ss", "\u1e9e": "ss", "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl",
    "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
}

# What clean_text has to change: runs of two or more, and single characters other than a blank.
# The first operand of each intersection turns ordinary letters away with one range test.
UNCLEAN = (
    rf"[\x00-\x20\x80-\uffff&&[{SPACE}]]{{2,}}|"
    rf"[\x00-\x1f\x80-\uffff&&[{SPACE}]]"
)

EMPTY = ""


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apply_sql(value: Column, function: str) -> Column:
    """``function``, an SQL lambda such as ``x -> upper(x)``, applied to ``value``.

    Long expressions are written this way: the text is parsed in one step, where the same built
    from Columns takes a call into the JVM for every node.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(function)), F.lit(0))


def computed(**values: Column) -> Column:
    """Columns to select that are computed once per row.

    A filter on an ordinary computed column is pushed below its projection and then evaluates
    the expression a second time. It cannot pass a generator, so costly fields go through one.
    """
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in values.items()])))


def strip(c: Column | str) -> Column:
    """Remove Python whitespace at both ends."""
    return F.regexp_replace(as_col(c), f"^[{SPACE}]+|[{SPACE}]+$", EMPTY)


def clean_text(c: Column | str) -> Column:
    """Whitespace runs become one space, ends are trimmed, NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit(EMPTY)), UNCLEAN, " "))


def normalize_text(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(as_col(c)), "[^a-z0-9]+", " "))


def dedupe_key(company: Column | str, title: Column | str, location: Column | str | None = None) -> Column:
    """``company::title::location`` of normalised parts; NULL if a part is NULL."""
    place = F.lit(EMPTY) if location is None else normalize_text(location)
    return F.concat(normalize_text(company), F.lit("::"), normalize_text(title), F.lit("::"), place)


def normalize_company(c: Column | str) -> Column:
    """Full case folding, then only ASCII letters and digits remain."""
    folded = F.translate(as_col(c), "".join(FOLD_ONE), "".join(FOLD_ONE.values()))
    for letter, plain in FOLD_MANY.items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.regexp_replace(F.lower(folded), "[^a-z0-9]+", EMPTY)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only, as SQLite's lower() and LIKE do."""
    return F.translate(as_col(c), string.ascii_uppercase, string.ascii_lowercase)


def like_anywhere(c: Column | str, keyword: str) -> Column:
    """SQLite ``LIKE '%keyword%'``: ASCII case-blind, user % and _ stay wildcards, no escapes."""
    folded = "".join(ch.lower() if ch in string.ascii_uppercase else ch for ch in keyword)
    return ascii_lower(c).like("%" + folded.replace("\\", "\\\\") + "%")


# Alphanumeric neighbours that make a keyword hit part of a longer word. (?u) folds the same
# four non-ASCII letters into a-z as Python's IGNORECASE.
_BEFORE, _AFTER = "(?iu)(?<![a-z0-9])(?:", ")(?![a-z0-9])"


def contains_keyword(c: Column | str, keywords: Sequence[str] = DEFAULT_KEYWORDS) -> Column:
    """True where any keyword stands on alphanumeric boundaries. One regex for the whole list."""
    if not keywords:
        return F.lit(False)
    return as_col(c).rlike(_BEFORE + "|".join(re.escape(k) for k in keywords) + _AFTER)


def keyword_pattern(keywords: Column | str) -> Column:
    """The pattern of :func:`contains_keyword` from an array column; NULL for an empty list."""
    kws = as_col(keywords)
    escaped = F.transform(kws, lambda k: F.regexp_replace(k, r"([^\p{L}\p{N}_])", r"\\$1"))
    pattern = F.concat(F.lit(_BEFORE), F.array_join(escaped, "|"), F.lit(_AFTER))
    return F.when(F.size(kws) > 0, pattern)


def matches_pattern(c: Column | str, pattern: Column | str) -> Column:
    """Per-row pattern of :func:`keyword_pattern`; a NULL pattern matches nothing."""
    return F.coalesce(F.rlike(as_col(c), as_col(pattern)), F.lit(False))


def matches_location(c: Column | str, locations: Sequence[str] | Column | None) -> Column:
    """Any allow-listed substring, case-blind; no list means everything passes."""
    lowered = F.lower(as_col(c))
    if isinstance(locations, Column):
        hit = F.exists(locations, lambda place: F.contains(lowered, F.lower(place)))
        return F.coalesce(F.size(locations) <= 0, F.lit(True)) | F.coalesce(hit, F.lit(True))
    if not locations:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(p.lower())) for p in locations))


def plausible_location(c: Column | str, limit: int = 80) -> Column:
    col = as_col(c)
    return F.when(F.length(col) <= limit, col).otherwise(F.lit(EMPTY))


def first_nonempty(*cols: Column | str) -> Column:
    """First value that is neither NULL nor ''; the last one is taken as it is."""
    *head, last = [as_col(c) for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit(EMPTY)) for c in head], last)


def count_substring(c: Column | str, sub: str) -> Column:
    col = as_col(c)
    removed = F.length(col) - F.length(F.replace(col, F.lit(sub), F.lit(EMPTY)))
    return F.floor(removed / len(sub)).cast("int")


def title_case(c: Column | str) -> Column:
    """Capitalise every run of letters; digits and punctuation separate runs."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(as_col(c), F.lit(f"([{cased}]+|[^{cased}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), EMPTY)


def html_escape(c: Column | str) -> Column:
    out = F.coalesce(as_col(c).cast("string"), F.lit(EMPTY))
    # The five escaped characters, ampersand first.
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def string_or_blank(v: Column | str) -> Column:
    """Trimmed text of a variant string; '' for numbers, objects, lists and null."""
    value = as_col(v)
    is_text = F.schema_of_variant(value) == "STRING"
    text = F.when(is_text, strip(F.try_variant_get(value, "$", "string")))
    return F.coalesce(text, F.lit(EMPTY))
