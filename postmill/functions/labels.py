"""Labelled values inside text, job-link tests and display strings (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import as_col, clean_text, let, plausible_location, strip

# Fixed values, in order of precedence.
LOCATION_LABELS = ("location:", "standort:", "city:", "ort:", "country/region:", "office:")
LOCATION_TOKENS = (
    "Munich", "Muenchen", "Berlin", "Hamburg", "Frankfurt",
    "Stuttgart", "Walldorf", "Germany", "Deutschland",
)
DATE_LABELS = ("date posted:", "posted:", "publication date:", "published:", "posting date:")
COUNTRIES = (
    "Germany|United States of America|United Kingdom|India|China|Thailand|Singapore|Japan|South Korea|Korea|"
    "France|Spain|Italy|Austria|Switzerland|Netherlands|Belgium|Portugal|Poland|Czechia|Hungary|Romania|Brazil|"
    "Mexico|Canada|Australia|Turkiye|Turkey|Denmark|Sweden|Norway|Finland"
)
STATUS_ICONS = {"ok": "🟢", "warning": "🟡", "error": "🔴", "running": "⏳"}


def _first_of(branches: list[tuple[Column, Column]], default: Column) -> Column:
    head, *tail = branches
    return reduce(lambda case, b: case.when(*b), tail, F.when(*head)).otherwise(default)


def _up_to(c: Column, *stops: str) -> Column:
    return reduce(lambda out, s: F.substring_index(out, s, 1), stops, c)


def _after_label(labels: tuple[str, ...], x: Column, cut: Callable[[Column], Column]) -> list[tuple[Column, Column]]:
    return [
        (F.contains(x["lowered"], F.lit(label)), cut(F.substr(x["text"], F.locate(label, x["lowered"]) + len(label))))
        for label in labels
    ]


def _with_lowered(text: Column | str) -> Column:
    return F.struct(as_col(text).alias("text"), F.lower(as_col(text)).alias("lowered"))


def extract_location(text: Column | str) -> Column:
    """Text after the first location label, else from the first known city or country on."""

    def find(x: Column) -> Column:
        labelled = _after_label(LOCATION_LABELS, x, lambda rest: _up_to(rest, "|", "\n"))
        named = [
            (x["text"].rlike(f"(?iu){token}"), _up_to(F.regexp_extract(x["text"], f"(?isu){token}.*", 0), "|", "\n", ","))
            for token in LOCATION_TOKENS
        ]
        return _first_of(labelled + named, F.lit(""))

    return let(strip(let(_with_lowered(text), find)), lambda place: plausible_location(place))


def extract_date_posted(text: Column | str) -> Column:
    """The word after the first date label; NULL when there is none."""
    rest = let(_with_lowered(text), lambda x: _first_of(_after_label(DATE_LABELS, x, lambda rest: rest), F.lit("")))
    return F.nullif(F.substring_index(strip(rest), " ", 1), F.lit(""))


def location_after_label(text: Column | str, title: Column | str) -> Column:
    """Location of a detail page: up to 120 characters after the label, cut at the repeated
    title and after the first country name."""
    after = F.regexp_extract(as_col(text), r"Location\(?s?\)?\s*:?\s*(.{0,120})", 1)
    start = F.substring(as_col(title), 1, 15)

    def cut_at_title(x: Column) -> Column:
        at = F.when(x["start"] != "", F.instr(x["after"], x["start"])).otherwise(0)
        return F.when(at > 1, F.substr(x["after"], F.lit(1), at - 1)).otherwise(x["after"])

    def cut_at_country(place: Column) -> Column:
        to_country = F.regexp_extract(place, rf"(?U)^(.*?\b(?:{COUNTRIES})\b)", 1)
        return F.coalesce(F.nullif(to_country, F.lit("")), place)

    place = let(let(F.struct(after.alias("after"), start.alias("start")), cut_at_title), cut_at_country)
    return F.btrim(F.substring(clean_text(place), 1, 80), F.lit(" -"))


def combined_location(primary: Column, others: Column, remote: Column | None = None) -> Column:
    """Primary and further places, then 'Remote', joined with '; ' skipping blanks."""
    places = F.concat(
        F.array(clean_text(primary)),
        F.coalesce(F.transform(others, clean_text), F.array().cast("array<string>")),
    )
    if remote is not None:
        extra = F.when(remote, F.array(F.lit("Remote"))).otherwise(F.array().cast("array<string>"))
        places = F.concat(places, extra)
    return F.array_join(F.filter(places, lambda p: p != ""), "; ")


def city_country(places: Column) -> Column:
    """'City, Country' of the first place, skipping blanks."""
    first = F.get(places, F.lit(0))
    parts = F.filter(F.array(first["CityName"], first["CountryName"]), lambda p: p != "")
    return clean_text(F.array_join(parts, ", "))


@dataclass(frozen=True)
class LinkRules:
    """What makes a link of a rendered page a posting."""

    domains: tuple[str, ...] = ()
    # Defaults shared by the rendered-page sources.
    markers: tuple[str, ...] = ("job", "career", "position", "vacancy", "requisition")
    skip: tuple[str, ...] = ("login", "linkedin", "instagram", "youtube", "privacy", "terms")
    blocked_titles: tuple[str, ...] = (
        "search", "job search", "jobs", "careers", "back", "next", "previous", "apply now",
    )
    # On the first domain, links must also hold this path.
    own_domain_path: str = ""


def _any_in(haystack: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(haystack, F.lit(n)) for n in needles), F.lit(False))


def is_job_url(url: Column | str, title: Column | str, rules: LinkRules) -> Column:
    u, t = F.lower(as_col(url)), as_col(title)
    ok = (F.length(t) >= 4) & ~_any_in(u, rules.skip) & ~F.lower(t).isin(*rules.blocked_titles)
    ok = ok & _any_in(u, rules.markers)
    if rules.domains:
        ok = ok & _any_in(u, rules.domains)
    if rules.own_domain_path:
        own = F.contains(u, F.lit(rules.domains[0]))
        ok = ok & (~own | F.contains(u, F.lit(rules.own_domain_path)))
    return F.coalesce(ok, F.lit(False))


def source_kind(name: Column | str) -> Column:
    return F.split_part(as_col(name), F.lit("_"), F.lit(1))


def status_label(status: Column | str) -> Column:
    s = as_col(status)
    icon = _first_of([(s == k, F.lit(v)) for k, v in STATUS_ICONS.items()], F.lit("?"))
    return F.concat_ws(" ", icon, s)


def scoring_prompt(title="title", company="company", location="location", description="description") -> Column:
    parts = (("Title: ", title), ("\nCompany: ", company), ("\nLocation: ", location), ("\nDescription:\n", description))
    return F.concat(*[x for label, c in parts for x in (F.lit(label), F.coalesce(as_col(c), F.lit("")))])


def connection_label(contacts: Column | str, notes: Column | str) -> Column:
    """'name (relationship - notes), …' and company notes; a hint if the company has neither."""

    def one(p: Column) -> Column:
        details = F.array_join(F.filter(F.array(p["relationship"], p["notes"]), lambda d: d != ""), " - ")
        return F.when(details != "", F.concat(p["name"], F.lit(" ("), details, F.lit(")"))).otherwise(p["name"])

    names = F.array_join(F.transform(as_col(contacts), one), ", ")
    note = as_col(notes)
    return (
        F.when((F.size(as_col(contacts)) > 0) & (note != ""), F.concat(names, F.lit(" | "), note))
        .when(F.size(as_col(contacts)) > 0, names)
        .when(note != "", note)
        .otherwise(F.lit("company is on your local list; no contacts yet"))
    )
