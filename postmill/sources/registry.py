"""Source configuration: which sources run, how each kind is read, what is searched for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import keyword_pattern, title_case
from postmill.schema import DEFAULT_KEYWORDS, SOURCE_CONFIG
from postmill.sources import boards, listings, searches

# Single sources in their running order, with the company of each. register_source adds to them.
SINGLE_SOURCES = {
    "bmw": "BMW Group",
    "porsche": "Porsche",
    "mercedes_benz": "Mercedes-Benz",
    "volkswagen": "Volkswagen",
    "siemens": "Siemens",
    "sap": "SAP",
    "allianz": "Allianz",
    "microsoft_germany": "Microsoft Germany",
    "google": "Google",
    "meta": "Meta",
    "apple": "Apple",
    "amazon": "Amazon",
}
BOARD_PLATFORMS = ("greenhouse", "lever", "ashby")
# Search templates of the sites searched once per keyword, and precise stand-ins for terms that
# match inside longer words.
SEARCH_TEMPLATES = {
    "mercedes_benz": ("https://jobs.mercedes-benz.com/en?search={keyword}",),
    "microsoft_germany": ("https://jobs.careers.microsoft.com/global/en/search?q={keyword}&lc=Germany",),
    "google": ("https://www.google.com/about/careers/applications/jobs/results?q={keyword}&location=Germany",),
    "meta": ("https://www.metacareers.com/jobs?q={keyword}&offices[0]=Germany",),
}
TERM_STAND_INS = {"rag": ("retrieval", "generative")}

Reader = Callable[[DataFrame, DataFrame | None], DataFrame]
READERS: dict[str, Reader] = {}


def register_source(kind: str, reader: Reader, company: str | None = None, shape: str | None = None, needs_details: bool = False) -> None:
    """Add or replace the reader of a source kind. Kinds with the same reader are read together.

    With ``company`` the kind can be configured as a source of its own, and runs behind those known before. ``shape`` names the JSON
    shape (a key of JSON_SHAPES) without which a response fails its source's run; ``needs_details`` says that it reads detail pages only.
    """
    READERS[kind] = reader
    if company is not None:
        SINGLE_SOURCES.setdefault(kind, company)
    if shape is not None:
        JSON_KINDS[kind] = shape
    if needs_details:
        RENDERED_KINDS.add(kind)


def unregister_source(kind: str) -> None:
    READERS.pop(kind, None)
    SINGLE_SOURCES.pop(kind, None)
    JSON_KINDS.pop(kind, None)
    RENDERED_KINDS.discard(kind)


def _is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _is_object(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "map<string,variant>").isNotNull()


def _jobs_list(v: Column, null_is_empty: bool) -> Column:
    jobs = F.try_variant_get(v, "$.jobs", "variant")
    fine = jobs.isNull() | F.try_variant_get(v, "$.jobs", "array<variant>").isNotNull()
    return _is_object(v) & ((fine | F.coalesce(F.is_variant_null(jobs), F.lit(False))) if null_is_empty else fine)


def _search_result(v: Column) -> Column:
    return _is_object(v) & (F.try_variant_get(v, "$.SearchResult", "variant").isNull() | _is_object(v, "$.SearchResult"))


# What the parsed body of a kind must be; the test of each gets a variant.
JSON_SHAPES: dict[str, Callable[[Column], Column]] = {
    "list": _is_list,
    "jobs": lambda v: _jobs_list(v, False),
    "jobs or null": lambda v: _jobs_list(v, True),
    "search result": _search_result,
}
# Kinds whose response body must be JSON of a shape; anything else fails the source's run.
JSON_KINDS: dict[str, str] = {}
# Kinds that only yield postings together with captured detail pages.
RENDERED_KINDS: set[str] = set()


for _kind, _reader, _shape in (
    ("greenhouse", boards.from_greenhouse, "jobs"),
    ("lever", boards.from_lever, "list"),
    ("ashby", boards.from_ashby, "jobs"),
    ("porsche", searches.from_porsche, "search result"),
    ("volkswagen", listings.from_successfactors, None),
    ("siemens", listings.from_siemens, None),
    ("sap", listings.from_successfactors, None),
    ("allianz", searches.from_allianz, None),
    ("apple", searches.from_apple, None),
    ("amazon", searches.from_amazon, "jobs or null"),
):
    register_source(_kind, _reader, shape=_shape)
for _kind in listings.RENDERED_SPECS:
    register_source(_kind, listings.from_rendered_listings, needs_details=True)


def config_frame(spark: SparkSession, config: Mapping) -> DataFrame:
    """The ``collectors`` part of a configuration document as rows (name, enabled, keywords, boards)."""
    rows = [
        (name, bool(entry.get("enabled", False)), entry.get("keywords"), [
            (b.get("slug"), b.get("company"), b.get("locations"), b.get("keywords")) for b in entry.get("boards") or []
        ])
        for name, entry in config.get("collectors", {}).items()
    ]
    return spark.createDataFrame(rows, SOURCE_CONFIG)


def _literal_case(c: Column, values: Mapping[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c)


def expand_sources(config: DataFrame, keywords: Sequence[str] | None = None) -> DataFrame:
    """Enabled sources in running order: singles, then one source per configured board.

    Keywords: the board's or source's own list if it has one, else ``keywords``, else the defaults.
    """
    shared = F.array(*[F.lit(k) for k in (keywords or DEFAULT_KEYWORDS)])
    enabled = config.filter("enabled")
    order = {name: i for i, name in enumerate((*SINGLE_SOURCES, *BOARD_PLATFORMS))}
    place = _literal_case(F.col("name"), order)
    no_list = F.lit(None).cast("array<string>")

    single = enabled.filter(F.col("name").isin(*SINGLE_SOURCES)).select(
        F.col("name").alias("source"),
        F.col("name").alias("kind"),
        _literal_case(F.col("name"), SINGLE_SOURCES).alias("company"),
        F.coalesce("keywords", shared).alias("keywords"),
        no_list.alias("locations"),
        F.struct(place.alias("place"), F.lit(0).alias("board")).alias("rank"),
    )
    board = enabled.filter(F.col("name").isin(*BOARD_PLATFORMS)).select("name", place.alias("_place"), F.posexplode("boards").alias("_n", "b"))
    boards_ = board.select(
        F.concat_ws("_", "name", "b.slug").alias("source"),
        F.col("name").alias("kind"),
        F.coalesce("b.company", title_case("b.slug")).alias("company"),
        F.coalesce("b.keywords", shared).alias("keywords"),
        F.transform("b.locations", F.lower).alias("locations"),
        F.struct(F.col("_place").alias("place"), F.col("_n").alias("board")).alias("rank"),
    )
    return single.unionByName(boards_).withColumn("keyword_pattern", keyword_pattern("keywords"))


def search_terms(keywords: Column | str) -> Column:
    """Keywords with their stand-ins in place, each term once, first occurrence kept."""
    stand_ins = F.create_map(*[x for k, v in TERM_STAND_INS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    replaced = F.transform(keywords, lambda k: F.coalesce(F.try_element_at(stand_ins, k), F.array(k)))
    return F.array_distinct(F.flatten(replaced))


def search_requests(sources: DataFrame, templates: DataFrame) -> DataFrame:
    """(source, template_no, term_no, url): each source's templates filled with each of its keywords.

    ``templates`` has rows (source, template_no, template).
    """
    terms = sources.select("source", F.posexplode("keywords").alias("term_no", "term"))
    return templates.join(terms, "source").select(
        "source", "template_no", "term_no", F.replace("template", F.lit("{keyword}"), F.col("term")).alias("url")
    )


def template_frame(spark: SparkSession) -> DataFrame:
    rows = [(s, i, t) for s, many in SEARCH_TEMPLATES.items() for i, t in enumerate(many)]
    return spark.createDataFrame(rows, "source string, template_no int, template string")
