"""Date and instant parsing (Column -> Column). Nothing here raises on bad text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import UNCLEAN, as_col, let

# Accepted formats per source family, first match wins.
TABLE_ROW_FORMATS = ("MMM d, yyyy", "d.M.yyyy", "yyyy-M-d")
LONG_MONTH_FORMATS = ("MMMM d, yyyy",)
LISTING_FORMATS = ("d.M.yyyy", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy")

# The digits-and-separators shape of each format letter run, used to skip hopeless parses.
_SHAPES = {"yyyy": "[0-9]{4}", "MMMM": r"\p{L}+", "MMM": r"\p{L}+", "M": "[0-9]{1,2}", "d": "[0-9]{1,2}"}


def _shape(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        run = fmt[i]
        while i + len(run) < len(fmt) and fmt[i + len(run)] == run[0]:
            run += run[0]
        out += _SHAPES.get(run, "\\" + run)
        i += len(run)
    return f"^{out}$"


def parse_date_any(c: Column | str, formats: tuple[str, ...]) -> Column:
    """Date by the first matching format, else NULL.

    The text's shape chooses the parse, since a failed parse raises and catches inside the JVM,
    which costs far more than a test. Formats of one shape are tried in turn.
    """
    shapes: dict[str, list[str]] = {}
    for f in formats:
        shapes.setdefault(_shape(f), []).append(f)

    def parsed(text: Column) -> Column:
        found = F.lit(None).cast("date")
        for shape, fitting in reversed(shapes.items()):
            found = F.when(text.rlike(shape), F.coalesce(*[F.try_to_date(text, f) for f in fitting])).otherwise(found)
        return found

    return let(F.regexp_replace(as_col(c), UNCLEAN, " "), parsed)


def iso_date(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def epoch_ms_to_date(c: Column | str) -> Column:
    """UTC calendar date of epoch milliseconds; 0 and NULL give NULL. Independent of the session zone."""
    ms = F.nullif(as_col(c).cast("long"), F.lit(0).cast("long"))
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86400000).cast("int"))


def date_prefix(c: Column | str) -> Column:
    """First ten characters, NULL when empty."""
    return F.substring(F.nullif(as_col(c), F.lit("")), 1, 10)


def posted_on(c: Column | str) -> Column:
    """Typed date of a posting's date text, from its first ten characters.

    Calendar dates with or without dashes and ISO week dates count; anything else is NULL. The
    undashed forms may be followed by two more characters, such as the start of a time.
    """
    text = F.substring(as_col(c), 1, 10)
    dashed = F.when(text.rlike("^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))
    compact = F.when(
        text.rlike("(?s)^(?!0000)[0-9]{8}(?:..)?$"),
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("date"),
    )
    return F.coalesce(dashed, F.when(F.contains(text, F.lit("W")), _week_date(text)), compact)


def _week_date(text: Column) -> Column:
    shape = r"(?s)^((?!0000)[0-9]{4})(?:-W([0-9]{2})(?:-([0-9]))?|W([0-9]{2})(?:([0-9])(?:..)?)?)$"
    year = F.regexp_extract(text, shape, 1)
    week = F.concat(F.regexp_extract(text, shape, 2), F.regexp_extract(text, shape, 4)).try_cast("int")
    day = F.concat(F.regexp_extract(text, shape, 3), F.regexp_extract(text, shape, 5)).try_cast("int")
    day = F.when(text.rlike(shape), F.coalesce(day, F.lit(1)))
    # 4 January always lies in week 1.
    anchor = F.concat(year, F.lit("-01-04")).try_cast("date")
    found = F.date_add(anchor, (week - 1) * 7 + (day - 1) - F.weekday(anchor))
    same_year = F.extract(F.lit("YEAROFWEEK"), found) == year.try_cast("int")
    return F.when((day >= 1) & (day <= 7) & (week >= 1) & same_year, found)


def has_parseable_date(c: Column | str) -> Column:
    return posted_on(c).isNotNull()


def parse_instant(c: Column | str) -> Column:
    """UTC instant of ISO text; offsets are honoured, text without one is UTC, bad text is NULL."""
    text = as_col(c)
    day, clock, zone = "[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}", r"[zZ]|[+-][0-9]{2}:[0-9]{2}"
    shape = rf"^({day})(?:[T ]({clock})(:[0-9]{{2}}(?:\.[0-9]+)?)?({zone})?)?$"
    part = [F.regexp_extract(text, shape, i) for i in range(5)]
    clock_text = F.concat(part[2], F.when(part[3] == "", F.lit(":00")).otherwise(part[3]))
    zone_text = F.when(part[4] == "", F.lit("Z")).otherwise(F.upper(part[4]))
    full = F.when(part[2] == "", F.concat(part[1], F.lit("T00:00:00Z"))).otherwise(
        F.concat(part[1], F.lit("T"), clock_text, zone_text)
    )
    return F.when(part[0] != "", full.try_cast("timestamp"))


def format_instant(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def days_before(as_of: Column, days: int | Column) -> Column:
    """Midnight-free day arithmetic on an instant: as_of minus whole 24-hour days."""
    amount = days if isinstance(days, Column) else F.lit(days)
    return as_of - F.make_interval(days=amount)


def instant(value) -> Column:
    """A literal instant from text, datetime or Column, so every operator takes an explicit 'now'."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")
