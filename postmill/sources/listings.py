"""Sources read from HTML result pages, with detail pages joined by URL."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions import dates, html, labels, text
from postmill.functions.labels import LinkRules
from postmill.operators.aggregates import longest_text_per_url
from postmill.operators.dedupe import cap_per_source, dedupe_by_url
from postmill.operators.filters import is_recent_local
from postmill.operators.joins import attach_details
from postmill.sources.common import emit
from postmill.sources.searches import _with_details

# Site addresses and German location markers.
SUCCESSFACTORS_BASES = {"sap": "https://jobs.sap.com", "volkswagen": "https://jobs.volkswagen-group.com"}
GERMANY_MARKERS = (", de", "germany", "deutschland")
SIEMENS_BASE = "https://jobs.siemens.com"


def _base_url(bases: dict[str, str]) -> Column:
    """Configured site of a source, else the address of its search page."""
    case = F.lit(None).cast("string")
    for source, base in bases.items():
        case = F.when(F.col("source") == source, F.lit(base)).otherwise(case)
    return F.coalesce(case, F.col("page_url"))


def from_successfactors(
    raw: DataFrame,
    details: DataFrame | None = None,
    max_detail: int | None = None,
    markers: tuple[str, ...] = GERMANY_MARKERS,
) -> DataFrame:
    """Table rows with a title link, a location and a date; first row per URL.

    All rows count. A caller that asks for ``max_detail`` keeps that many URLs per source, in discovery order;
    ``left_out(successfactors_rows(raw), max_detail)`` says how many go.
    """
    full = _with_details(cap_per_source(successfactors_rows(raw, markers), max_detail), details)
    return emit(
        full,
        title=F.col("title"),
        location=F.col("location"),
        url=F.col("url"),
        description=_detail_text(F.col("detail_html")),
        date_posted=dates.iso_date(dates.parse_date_any("date", dates.TABLE_ROW_FORMATS)),
    )


def successfactors_rows(raw: DataFrame, markers: tuple[str, ...] = GERMANY_MARKERS) -> DataFrame:
    """The linked table rows of result pages, first row per source and URL."""
    pages = raw.withColumnRenamed("url", "page_url")
    chunks = F.split(html.without_scripts("body"), r"(?i)(?=<tr\b)")
    rows = pages.select("*", F.posexplode(chunks).alias("_row", "_html")).drop("body")

    def cell(row: Column, name: str) -> Column:
        return html.element_inner(row, html.opening("span", html.class_token(name)))

    def links(x: Column) -> Column:
        def link_of(a: Column) -> Column:
            inside = F.contains(x["row"], a)
            return F.struct(
                html.absolutize_url(x["base"], html.attribute(a, "href")).alias("url"),
                a.alias("_anchor"),
                F.when(inside, x["location"]).otherwise(F.lit("")).alias("location"),
                F.when(inside, x["date"]).alias("_date"),
            )

        return F.transform(html.anchors("_html", link), link_of)

    link = rf"""(?is)<a\b[^>]*?{html.class_token("jobTitle-link")}[^>]*>.*?(?=</a\s*>|\z)"""
    # Links outside a table row have neither location nor date.
    row = F.regexp_extract("_html", r"(?is)^(<tr\b.*?)(?:</tr\s*>|\z)", 1)
    in_row = F.struct(
        row.alias("row"), html.strip_html(cell(row, "jobLocation")).alias("location"), cell(row, "jobDate").alias("date"), _base_url(SUCCESSFACTORS_BASES).alias("base")
    )
    # Position in the page: row first, then link in the row.
    listed = (
        rows.select("*", F.posexplode(text.let(in_row, links)).alias("_n", "_link"))
        .select("*", _position("_row", "_n").alias("pos"), "_link.*")
        .drop("_html", "_link")
        .filter((F.col("url") != "") & text.matches_location("location", markers))
    )
    # Many pages link a posting twice; titles and dates are read from the links that stay.
    kept = dedupe_by_url(listed)
    return kept.withColumns({"title": html.strip_html("_anchor"), "date": html.strip_html("_date")}).drop("_anchor", "_date")


def _position(piece: str, n: str) -> Column:
    """Order of a link in its page: its piece of the page, then its place there. Both are 32-bit numbers."""
    return F.shiftleft(F.col(piece).cast("long"), 32) + F.col(n)


def _detail_text(page: Column) -> Column:
    """Text of the description element, the job element, or the body, in that order."""
    item = r"""\bitemprop\s*=\s*(?:"description"|'description')"""
    choices = (html.opening("span", item), html.opening(attribute=html.class_token("jobdescription")),
               html.opening(attribute=html.class_token("job")), html.opening("body"))
    return html.strip_html(html.first_element(html.without_scripts(page), choices))


def from_siemens(raw: DataFrame, details: DataFrame | None = None, max_detail: int | None = None) -> DataFrame:
    """Detail links of result pages; each URL keeps its longest link text. Location and
    description come from the detail page; there is no date. All links count, unless the caller
    asks for ``max_detail`` per source; ``left_out(siemens_links(raw), max_detail)`` counts the rest."""
    listed = cap_per_source(siemens_links(raw), max_detail).filter(F.lower("text") != "learn more")
    full = _with_details(listed, details)
    content = html.first_element(html.without_scripts("detail_html"), [html.opening("main"), html.opening("body")])
    return emit(
        full.withColumn("_text", html.strip_html(content)),
        title=F.col("text"),
        location=F.coalesce(labels.location_after_label("_text", "text"), F.lit("")),
        url=F.col("url"),
        description=F.col("_text"),
    )


def siemens_links(raw: DataFrame) -> DataFrame:
    found = page_links(raw, F.lit(SIEMENS_BASE)).filter(F.contains("href", F.lit("/JobDetail/")))
    return longest_text_per_url(found, carry=("company", "keyword_pattern", "rank", "fetched_at"))


def page_links(raw: DataFrame, base: Column | None = None) -> DataFrame:
    """Every link of a page: resolved ``url``, raw ``href``, ``text`` and ``pos``."""
    pages = raw.withColumnRenamed("url", "page_url")
    origin = F.col("page_url") if base is None else base

    def link(anchor: Column) -> Column:
        return F.struct(html.attribute(anchor, "href").alias("href"), html.strip_html(anchor).alias("text"))

    found = F.transform(html.anchors(html.without_scripts("body")), link)
    links = pages.select("*", F.posexplode(found).alias("pos", "_link")).drop("body")
    return links.select("*", "_link.*").drop("_link").withColumn("url", html.absolutize_url(origin, "href"))


# --- rendered pages -----------------------------------------------------------------------


@dataclass(frozen=True)
class RenderedSpec:
    """How one site's captured pages are read."""

    rules: LinkRules = field(default_factory=LinkRules)
    max_age_days: int | None = None
    locations: tuple[str, ...] = ()


# The rendered sites, their domains, path markers and listing conditions.
RENDERED_SPECS = {
    "bmw": RenderedSpec(
        LinkRules(
            domains=("bmwgroup.jobs", "successfactors"),
            blocked_titles=("all jobs", "favourite jobs", "job finder"),
            own_domain_path="/jobfinder/job-description",
        ),
        max_age_days=2,
        locations=("germany", "deutschland", "münchen", "munich", "berlin", "frankfurt"),
    ),
    "mercedes_benz": RenderedSpec(LinkRules(domains=("mercedes-benz.com", "jobs.mercedes-benz.com"))),
    "microsoft_germany": RenderedSpec(LinkRules(domains=("careers.microsoft.com",), markers=("/job/",))),
    "google": RenderedSpec(LinkRules(domains=("google.com",), markers=("jobs/results",))),
    "meta": RenderedSpec(LinkRules(domains=("metacareers.com",))),
}

# A card is a list item, row or article, or an element whose class or role says so.
_CARD = (
    r"<(?:article|li|tr)\b|<[a-zA-Z][a-zA-Z0-9]*\b[^>]*?\b(?:class\s*=\s*[\"'][^\"']*(?:job|result|card)"
    r"|data-testid\s*=\s*[\"'][^\"']*job|role\s*=\s*[\"']listitem)"
)


_OPENS_CARD = rf"(?i)^(?:{_CARD})"
_OPENS_LINK = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|'[^']*')[^>]*>"""


def rendered_links(pages: DataFrame) -> DataFrame:
    """Links of captured pages with the first line of their text and the text of their card.

    A link's card is the smallest one that holds it, which may hold other cards before or behind the link; a link that is a card itself, or that has none,
    has its own text.
    """
    raw = pages.withColumnRenamed("url", "page_url")

    def text_of(x: Column) -> Column:
        return text.clean_text(html.rendered_text(x))

    def tagged(parts: Column) -> Column:
        return F.struct(parts.alias("parts"), html.tag_names(parts).alias("names"), F.transform(parts, lambda p: p.rlike(_OPENS_CARD)).alias("opens"))

    def with_cards(x: Column) -> Column:
        of_cards = F.filter(x["names"], lambda n, i: F.get(x["opens"], i) & (n != "a"))
        spans = F.flatten(F.transform(F.array_distinct(of_cards), lambda n: html.element_spans(x["names"], n)))
        places = F.filter(F.transform(x["names"], lambda n, i: F.when(F.array_contains(F.array(F.lit("a"), F.lit("/a")), n), i)), lambda i: i.isNotNull())
        # Bound, since the step from one place to the next would seek them all again.
        upto = lambda at: F.transform(at, lambda p, k: F.struct(p.alias("s"), F.coalesce(F.get(at, k + 1), F.size(x["parts"])).alias("e")))
        ends = text.let(places, upto)
        anchors = F.filter(ends, lambda a: F.get(x["parts"], a["s"]).rlike(_OPENS_LINK))
        return F.struct(x["parts"].alias("parts"), x["opens"].alias("opens"), F.filter(spans, lambda c: F.get(x["opens"], c["s"])).alias("cards"), anchors.alias("anchors"))

    def with_links(x: Column) -> Column:
        def card(a: Column) -> Column:  # the one that opens last before the link and ends behind it
            inside = F.filter(x["cards"], lambda c: (c["s"] < a["s"]) & (a["s"] < c["e"]))
            return F.when(F.get(x["opens"], a["s"]), None).otherwise(F.array_max(inside))

        links = F.transform(x["anchors"], lambda a: F.struct(html.joined(x["parts"], a["s"], a["e"]).alias("source"), card(a).alias("card")))
        return F.struct(x["parts"].alias("parts"), links.alias("links"))

    def with_text(x: Column) -> Column:
        # A card's text is made once, however many links it has.
        used = F.array_distinct(F.filter(F.transform(x["links"], lambda a: a["card"]), lambda c: c.isNotNull()))
        texts = F.map_from_entries(F.transform(used, lambda c: F.struct(c["s"], text_of(html.joined(x["parts"], c["s"], c["e"])))))
        return F.struct(x["links"].alias("links"), texts.alias("texts"))

    def links(x: Column) -> Column:
        return F.transform(
            x["links"],
            lambda a: F.struct(
                html.absolutize_url("page_url", html.attribute(a["source"], "href")).alias("url"),
                text.clean_text(F.substring_index(html.rendered_text(a["source"]), "\n", 1)).alias("title"),
                F.coalesce(F.try_element_at(x["texts"], a["card"]["s"]), text_of(a["source"])).alias("card_text"),
            ),
        )

    found = html.pieces(html.without_scripts("body", ("noscript",)))
    for step in (tagged, with_cards, with_links, with_text, links):
        found = text.let(found, step)
    return raw.select("*", F.posexplode(found).alias("pos", "_link")).drop("body").select("*", "_link.*").withColumn("pos", F.col("pos").cast("long")).drop("_link")


def detail_fields(page: Column) -> Column:
    """(title, text) of a captured detail page: the best content element and its heading."""
    # Content elements in order of preference.
    classes = ("jobdetail", "job-detail", "jobDescription", "job-description")
    choices = [html.opening(attribute=html.attr_contains("class", c)) for c in classes]
    choices += [html.opening(attribute=html.attr_contains("data-testid", "job")), html.opening("main"),
                html.opening("article"), html.opening("body")]
    heading = html.opening("h[12]")

    def read(x: Column) -> Column:
        title = F.coalesce(html.element_inner(x["content"], heading), html.element_inner(x["page"], heading))
        return F.struct(
            text.clean_text(html.rendered_text(title)).alias("title"),
            text.clean_text(html.rendered_text(x["content"])).alias("text"),
        )

    def parts(clean: Column) -> Column:
        content = F.coalesce(html.first_element(clean, choices), clean)
        return F.struct(clean.alias("page"), content.alias("content"))

    return text.let(text.let(html.without_scripts(page, ("noscript",)), parts), read)


def from_rendered_listings(
    raw: DataFrame,
    details: DataFrame,
    specs: RenderedSpec | Mapping[str, RenderedSpec] = RENDERED_SPECS,
    as_of_date: Column | None = None,
) -> DataFrame:
    """Listings of captured pages joined with their captured detail pages.

    One spec may serve all sources, or each source has its own; either way all pages go through
    one plan. A listing without a detail page is dropped. Keywords are looked for in the detail
    page only; its values win over those of the listing.
    """

    def by_source(test: Callable[[RenderedSpec], Column]) -> Column:
        if isinstance(specs, RenderedSpec):
            return test(specs)
        case = F.lit(False)
        for source, spec in specs.items():
            case = F.when(F.col("source") == source, test(spec)).otherwise(case)
        return case

    links = rendered_links(raw).filter(by_source(lambda spec: labels.is_job_url("url", "title", spec.rules)))
    listed = dedupe_by_url(links).withColumns(
        {"location": labels.extract_location("card_text"), "date_posted": labels.extract_date_posted("card_text")}
    )
    today = F.to_date(dates.parse_instant("fetched_at")) if as_of_date is None else as_of_date

    def accepted(spec: RenderedSpec) -> Column:
        return F.lit(True) if spec.max_age_days is None else is_recent_local(spec.max_age_days, spec.locations, today)

    listed = listed.filter(by_source(accepted))
    full = attach_details(listed, details, "inner").withColumn("_detail", detail_fields(F.col("detail_html")))
    full = full.drop("detail_html").withColumns({"detail_title": F.col("_detail.title"), "detail_text": F.col("_detail.text")})
    place = labels.extract_location("detail_text")
    return emit(
        full.withColumn("_place", place),
        title=text.first_nonempty("detail_title", F.coalesce("title", F.lit(""))),
        location=text.first_nonempty("_place", F.coalesce("location", F.lit(""))),
        url=F.col("url"),
        description=F.col("detail_text"),
        date_posted=text.first_nonempty(labels.extract_date_posted("detail_text"), "date_posted"),
        keyword_text=F.concat_ws(" ", "detail_title", "_place", "detail_text"),
    )
