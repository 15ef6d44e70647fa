"""Queries that render the test postings as landed payloads and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.functions.dates import instant
from postmill.functions import text
from postmill.functions.labels import LinkRules
from postmill.operators import filters
from postmill.plans import bindings as b
from postmill.plans.catalog import AS_OF, P, R, query
from postmill.plans.collection import collect_all
from postmill.sources import boards, listings, searches
from postmill.sources.registry import expand_sources

OUT = ("title", "company", "location", "source", "url", "description", "date_posted", "keyword_hit")
HIT = "regexp_matches({0}, '(?i)(^|[^a-z0-9])(high|urgent)([^a-z0-9]|$)')"
HIT_ALL = HIT.format("title || ' ' || location || ' ' || description") + " AS keyword_hit"
SELECT = f" SELECT title, company, location, source, url, description, date_posted, {HIT_ALL} FROM x"


def _id():
    return F.col("id").cast("string")


def _dated(spark, sf):
    """Postings with the order date and clean company text."""
    day = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    keep = ("id", "title", "location", "source", "description", "status")
    return b.postings(spark, sf).select(*keep).join(day, "id")


def _jobs(entries):
    return F.to_json(F.struct(entries.alias("jobs")))


ISO_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query(
    "json_payload_greenhouse",
    P
    + f""", x AS (SELECT title, 'Acme' AS company, location, source, 'https://g.example/' || id AS url,
      description || ' R&D < all' AS description, {ISO_DAY} AS date_posted FROM p)"""
    + SELECT,
)
def greenhouse(spark, sf):
    stamp = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T10:00:00-04:00"))
    odd = F.col("id") % 2 == 1
    entry = F.struct(
        F.concat(F.lit("  "), "title", F.lit("\n\t")).alias("title"),
        F.concat(F.lit("https://g.example/"), _id()).alias("absolute_url"),
        F.struct(F.concat("location", F.lit(" ")).alias("name")).alias("location"),
        F.when(odd, "").otherwise(stamp).alias("updated_at"),
        F.when(odd, stamp).alias("first_published"),
        F.concat(F.lit("&lt;p&gt;"), "description", F.lit("&lt;script&gt;x()&lt;/script&gt; &lt;b&gt;R&amp;amp;D&lt;/b&gt;&lt;/p&gt; &amp;lt; all")).alias("content"),
    )
    return boards.from_greenhouse(b.landed(_dated(spark, sf), entry, _jobs)).select(*OUT)


@query(
    "json_payload_lever",
    P
    + f""", x AS (SELECT title, 'Acme' AS company, location, source, 'https://l.example/' || id AS url, description,
      CASE WHEN id % 7 <> 0 THEN {ISO_DAY} END AS date_posted FROM p)"""
    + SELECT,
)
def lever(spark, sf):
    millis = F.unix_date("day").cast("long") * 86400000 + F.col("id") % 86400000
    entry = F.struct(
        F.col("title").alias("text"),
        F.concat(F.lit("https://l.example/"), _id()).alias("hostedUrl"),
        F.struct("location").alias("categories"),
        F.when(F.col("id") % 7 == 0, 0).otherwise(millis).alias("createdAt"),
        F.concat_ws("\n", F.split("description", " ")).alias("descriptionPlain"),
    )
    return boards.from_lever(b.landed(_dated(spark, sf), entry, F.to_json)).select(*OUT)


@query(
    "json_payload_ashby",
    P
    + f""", x AS (SELECT title, 'Acme' AS company, location || CASE WHEN id % 2 = 0 THEN '; ' || source ELSE '' END || CASE WHEN id % 3 = 0 THEN '; Remote' ELSE '' END AS location,
      source, 'https://a.example/' || id AS url, description, {ISO_DAY} AS date_posted FROM p)"""
    + SELECT,
)
def ashby(spark, sf):
    second = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.col("source").alias("location")), F.struct(F.lit("  ").alias("location"))))
    url = F.concat(F.lit("https://a.example/"), _id())
    entry = F.struct(
        "title",
        F.when(F.col("id") % 5 != 0, url).otherwise("").alias("jobUrl"),
        url.alias("applyUrl"),
        "location",
        second.alias("secondaryLocations"),
        (F.col("id") % 3 == 0).alias("isRemote"),
        F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("publishedAt"),
        F.col("description").alias("descriptionPlain"),
    )
    return boards.from_ashby(b.landed(_dated(spark, sf), entry, _jobs)).select(*OUT)


@query(
    "json_payload_amazon",
    P
    + f""", x AS (SELECT title, 'Acme' AS company, location, source, 'https://www.amazon.jobs/en/' || id AS url,
      description || ' basics of ' || title AS description, CASE WHEN id % 6 <> 0 THEN {ISO_DAY} END AS date_posted FROM p)"""
    + SELECT,
)
def amazon(spark, sf):
    entry = F.struct(
        "title",
        F.when(F.col("id") % 2 == 0, F.col("location")).otherwise("").alias("normalized_location"),
        F.concat(F.lit(" "), "location").alias("location"),
        F.concat(F.lit("/en/"), _id()).alias("job_path"),
        "description",
        F.lit(None).cast("string").alias("basic_qualifications"),
        F.concat(F.lit("basics of  "), "title").alias("preferred_qualifications"),
        F.when(F.col("id") % 6 == 0, "soon").otherwise(F.date_format("day", "MMMM  d, yyyy")).alias("posted_date"),
    )
    return searches.from_amazon(b.landed(_dated(spark, sf), entry, _jobs)).select(*OUT)


def _porsche_body(entries):
    items = F.transform(entries, lambda e: F.struct(e.alias("MatchedObjectDescriptor")))
    total = F.when(F.exists(entries, lambda e: F.contains(e["ID"], F.lit("00"))), 201).otherwise(200)
    return F.to_json(F.struct(F.struct(total.alias("SearchResultCountAll"), items.alias("SearchResultItems")).alias("SearchResult")))


@query(
    "json_payload_porsche",
    P
    + f""", q AS (SELECT *, row_number() OVER (PARTITION BY source, id // 2 ORDER BY id) AS k FROM p
    WHERE id % 9 <> 0),
  x AS (SELECT title, 'Acme' AS company, location || CASE WHEN id % 2 = 0 THEN ', Germany' ELSE '' END AS location, source,
    'https://o.example/' || id AS url, CASE WHEN id % 4 = 0 THEN '' ELSE 'About ' || description END AS description, {ISO_DAY} AS date_posted FROM q WHERE k = 1)"""
    + SELECT,
)
def porsche(spark, sf):
    return searches.from_porsche(*_porsche(spark, sf)).select(*OUT)


def _porsche(spark, sf):
    """Responses, and detail pages."""
    rows = _dated(spark, sf)
    url = F.concat(F.lit("https://o.example/"), _id())
    entry = F.struct(
        F.floor(F.col("id") / 2).cast("string").alias("ID"),
        F.col("title").alias("PositionTitle"),
        F.when(F.col("id") % 9 == 0, "").otherwise(url).alias("PositionURI"),
        F.array(
            F.struct(F.col("location").alias("CityName"), F.when(F.col("id") % 2 == 0, "Germany").otherwise("").alias("CountryName")),
            F.struct(F.lit("Elsewhere").alias("CityName"), F.lit("").alias("CountryName")),
        ).alias("PositionLocation"),
        F.date_format("day", "yyyy-MM-dd").alias("PublicationStartDate"),
    )
    page = F.concat(F.lit("<body><noscript>no</noscript><style>p{}</style><p>About <i>"), "description", F.lit("</i></p></body>"))
    details = b.detail_pages(rows, url, F.when(F.col("id") % 4 != 0, page))
    return b.landed(rows, entry, _porsche_body), details


@query(
    "porsche_precise_terms",
    P
    + f""", t AS (SELECT source, id // 50 AS response, bool_or(contains(CAST(id // 2 AS VARCHAR), '00')) AS noisy FROM p GROUP BY 1, 2),
  q AS (SELECT p.*, row_number() OVER (PARTITION BY p.source, id // 2 ORDER BY id) AS k FROM p JOIN t ON t.source = p.source AND response = id // 50
    WHERE id % 9 <> 0 AND NOT noisy),
  x AS (SELECT title, 'Acme' AS company, location || CASE WHEN id % 2 = 0 THEN ', Germany' ELSE '' END AS location, source,
    'https://o.example/' || id AS url, CASE WHEN id % 4 = 0 THEN '' ELSE 'About ' || description END AS description, {ISO_DAY} AS date_posted FROM q WHERE k = 1)"""
    + SELECT,
)
def porsche_precise_terms(spark, sf):
    """As json_payload_porsche, without the terms that matched over 200 postings."""
    return searches.from_porsche(*_porsche(spark, sf), max_results=200).select(*OUT)


@query(
    "porsche_noisy_terms",
    P
    + """, t AS (SELECT source, id // 50 AS response FROM p GROUP BY 1, 2 HAVING bool_or(contains(CAST(id // 2 AS VARCHAR), '00')))
  SELECT source, count(*) AS responses, CAST(201 * count(*) AS BIGINT) AS rows FROM t GROUP BY 1""",
)
def porsche_noisy_terms(spark, sf):
    """What that leaves out of each source."""
    result = _porsche(spark, sf)[0].select("source", F.from_json("body", searches.PORSCHE)["SearchResult"]["SearchResultCountAll"].cast("long").alias("total"))
    return filters.noisy_terms(result, 200)


def _apple_body(entries):
    state = F.to_json(F.struct(F.struct(F.struct(entries.alias("searchResults")).alias("search")).alias("loaderData")))
    escaped = F.replace(F.replace(state, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('<html><script>window.__staticRouterHydrationData = JSON.parse("'), escaped, F.lit('");</script></html>'))


@query(
    "embedded_json_apple",
    P
    + f""", x AS (SELECT title || ' "lead"' AS title, 'Acme' AS company, location || '; ' || source AS location, source,
      'https://jobs.apple.com/en-us/details/' || id AS url, description, {ISO_DAY} AS date_posted FROM p WHERE id % 8 <> 0)"""
    + SELECT,
)
def apple(spark, sf):
    odd = F.col("id") % 2 == 1
    title = F.concat("title", F.lit(' "lead"'))
    job_id = F.when(F.col("id") % 8 == 0, "").otherwise(F.concat(_id(), F.lit("-0836")))
    entry = F.struct(
        F.when(odd, job_id).alias("positionId"),
        job_id.alias("id"),
        F.array(F.struct(F.col("location").alias("name")), F.struct(F.lit("").alias("name")), F.struct(F.col("source").alias("name"))).alias("locations"),
        F.when(odd, F.date_format("day", "yyyy-MM-dd'T'00:00:00")).alias("postDateInGMT"),
        F.date_format("day", "yyyy-MM-dd").alias("postingDate"),
        F.when(odd, title).otherwise("").alias("postingTitle"),
        title.alias("transformedPostingTitle"),
        F.col("description").alias("jobSummary"),
    )
    return searches.from_apple(b.landed(_dated(spark, sf), entry, _apple_body)).select(*OUT)


def _allianz_body(entries):
    state = F.to_json(F.struct(F.struct(F.struct(entries.alias("jobs")).alias("data")).alias("eagerLoadRefineSearch")))
    return F.concat(F.lit("<html><script>var phApp = {}; phApp.ddo = "), state, F.lit("; phApp.x = {};</script></html>"))


@query(
    "embedded_json_allianz",
    P
    + f""", x AS (SELECT title, 'Acme' AS company, location, source, CASE WHEN id % 2 = 0 THEN 'https://apply.example/' || id
      ELSE 'https://careers.allianz.com/global/en/job/' || id END AS url, description, {ISO_DAY} AS date_posted FROM p WHERE id % 8 <> 0)"""
    + SELECT,
)
def allianz(spark, sf):
    even = F.col("id") % 2 == 0
    job_id = F.when(F.col("id") % 8 != 0, _id())
    entry = F.struct(
        F.when(even, job_id).alias("jobId"),
        job_id.alias("reqId"),
        "title",
        F.when(even, F.col("location")).alias("cityStateCountry"),
        "location",
        F.when(even, F.concat(F.lit("https://apply.example/"), _id())).alias("applyUrl"),
        F.col("description").alias("descriptionTeaser"),
        F.when(even, F.date_format("day", "yyyy-MM-dd")).alias("postedDate"),
        F.date_format("day", "yyyy-MM-dd'T'08:00").alias("dateCreated"),
    )
    return searches.from_allianz(b.landed(_dated(spark, sf), entry, _allianz_body)).select(*OUT)


@query(
    "table_rows_html",
    P
    + f""", x AS (SELECT title, 'Acme' AS company, location || CASE WHEN id % 5 = 0 THEN ', FR' ELSE ', DE' END AS location, source,
      'https://site.example/job/' || id AS url, CASE id % 4 WHEN 0 THEN 'All about ' || description WHEN 1 THEN 'Job ' || description
        WHEN 2 THEN 'menu Body ' || description ELSE '' END AS description,
      CASE WHEN id % 3 <> 2 THEN {ISO_DAY} END AS date_posted FROM p WHERE id % 5 <> 0 OR contains(lower(location), 'germany'))"""
    + SELECT,
)
def successfactors(spark, sf):
    rows = _dated(spark, sf)
    k = F.col("id") % 3
    shown = F.when(k == 0, F.date_format("day", "MMM d, yyyy")).when(k == 1, F.date_format("day", "dd.MM.yyyy")).otherwise("recently")
    entry = F.concat(
        F.lit('<tr class="row"><td><a href="/job/'), _id(), F.lit('" class="x jobTitle-link">'), "title", F.lit("</a>"),
        F.lit('<a class="jobTitle-link" href="/job/'), _id(), F.lit('">again</a></td><td><span class="jobLocation"><span>'), "location",
        F.when(F.col("id") % 5 == 0, ", FR").otherwise(", DE"), F.lit('</span></span></td><td><span class="jobDate">'), shown, F.lit("</span></td></tr>"),
    )

    def body(entries):
        return F.concat(F.lit("<html><body><table><!-- <tr> -->"), F.array_join(entries, "\n"), F.lit("</table></body></html>"))

    url = F.concat(F.lit("https://site.example/job/"), _id())
    d = F.col("description")
    n = F.col("id") % 4
    page = (
        F.when(n == 0, F.concat(F.lit('<body><div class="job">no</div><span itemprop="description">All <span>about</span> '), d, F.lit("</span> x</body>")))
        .when(n == 1, F.concat(F.lit('<body><div class="jobs">no</div><div class="big job"><div>Job</div> '), d, F.lit("</div> x</body>")))
        .when(n == 2, F.concat(F.lit("<body><nav>menu</nav>Body "), d, F.lit("</body>")))
    )
    details = b.detail_pages(rows, url, page)
    return listings.from_successfactors(b.landed(rows, entry, body), details).select(*OUT)


@query(
    "detail_links_html",
    P
    + """, q AS (SELECT *, title || ' ' || left(location, 4) AS t FROM p),
  x AS (SELECT t AS title, 'Acme' AS company, CASE WHEN id % 3 = 0 THEN '' ELSE location || ' - Germany' END AS location, source,
    'https://jobs.siemens.com/JobDetail/' || id AS url, CASE WHEN id % 3 = 0 THEN '' ELSE 'Location(s): ' || location || ' - Germany now ' || t || ' ' || description END AS description,
    CAST(NULL AS VARCHAR) AS date_posted FROM q WHERE length(t) >= 10)"""
    + SELECT,
)
def siemens(spark, sf):
    rows = _dated(spark, sf).withColumn("t", F.concat_ws(" ", "title", F.substring("location", 1, 4)))
    link = F.concat(F.lit('<a href="/JobDetail/'), _id(), F.lit('">'))
    entry = F.concat(link, F.lit("<b>"), "t", F.lit("</b></a> "), link, F.lit('Learn more</a><a href="/other/1">A much longer text than any</a>'))

    def body(entries):
        return F.concat(F.lit("<html><body>"), F.array_join(entries, "\n"), F.lit("</body></html>"))

    page = F.concat(F.lit("<body>head<main><p>Location(s): "), "location", F.lit(" - Germany now</p><h1>"), "t", F.lit("</h1>"), "description", F.lit("</main>foot</body>"))
    url = F.concat(F.lit("https://jobs.siemens.com/JobDetail/"), _id())
    details = b.detail_pages(rows, url, F.when(F.col("id") % 3 != 0, page))
    return listings.from_siemens(b.landed(rows, entry, body), details).select(*OUT)


@query(
    "rendered_listings",
    P
    + f""", x AS (SELECT CASE WHEN id % 2 = 0 THEN 'Lead ' || title ELSE title || ' card' END AS title, 'Acme' AS company,
      CASE WHEN id % 2 = 0 THEN 'Detail ' || source ELSE location END AS location, source, 'https://site.example/jobs/' || id AS url,
      CASE WHEN id % 2 = 0 THEN 'Lead ' || title || ' City: Detail ' || source || ' | Published: 2001-01-01 text ' || description ELSE 'text ' || c_mktsegment END AS description,
      CASE WHEN id % 2 = 0 THEN '2001-01-01' ELSE strftime(o_orderdate, '%d.%m.%Y') END AS date_posted,
      {HIT.format("CASE WHEN id % 2 = 0 THEN title ELSE c_mktsegment END")} AS keyword_hit FROM p WHERE id % 7 <> 0 AND id % 10 <> 9)
  SELECT * FROM x""",
)
def rendered(spark, sf):
    """Cards with a linked title, location and date, some of which hold other cards before or behind the link; some links are not postings, some details
    are missing, some details state no title, location or date."""
    rows = _dated(spark, sf)
    path = F.when(F.col("id") % 10 == 9, "/login/jobs/").otherwise("/jobs/")
    # Every third card is a list item, the others are divisions that foreign text follows.
    item = F.col("id") % 3 == 0
    note = F.lit('<ul class="notes"><li>note<li class="result">a note that no end tag closes</ul>')
    entry = F.concat(
        F.when(item, '<li class="card">').otherwise('<div class="job-card"><div>'),
        F.when(F.col("id") % 5 == 0, F.concat(F.lit('<article class="x">inner <div class="result">card</div></article>'), note)).otherwise(""),
        F.lit('<a href="'), path, _id(), F.lit('"><h3>'), "title", F.lit(" card</h3><p>second line</p></a>"),
        F.when(F.col("id") % 5 == 1, note).otherwise(""), F.lit("<p>Standort: "),
        "location", F.lit(" | Posted: "), F.date_format("day", "dd.MM.yyyy"), F.lit(" by us</p>"),
        F.when(item, "</li>").otherwise("</div></div><footer>Location: Oslo | Posted: 01.02.1990</footer>"),
    )

    def body(entries):
        return F.concat(F.lit('<html><body><a href="/jobs/">Jobs</a><ul>'), F.array_join(entries, ""), F.lit("</ul></body></html>"))

    even = F.col("id") % 2 == 0
    full = F.concat(
        F.lit('<body><h1>Site</h1><div class="x job-detail"><h2>Lead '), "title", F.lit("</h2><div>City: Detail "), "source",
        F.lit(" | Published: 2001-01-01 text</div><span>"), "description", F.lit("</span></div><p>foot</p></body>"),
    )
    bare = F.concat(F.lit("<body><script>var s='<main>';</script><main>text "), F.regexp_replace("description", "^.* ", ""), F.lit("</main></body>"))
    url = F.concat(F.lit("https://site.example/jobs/"), _id())
    details = b.detail_pages(rows, url, F.when(F.col("id") % 7 != 0, F.when(even, full).otherwise(bare)))
    spec = listings.RenderedSpec(LinkRules(domains=("site.example",)))
    return listings.from_rendered_listings(b.landed(rows, entry, body), details, spec).select(*OUT)


def _norm(c):
    return f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"


# Every posting lands at one of eleven sources of three kinds; four boards more found nothing or failed. Keys of one company's roles in places before J
# are stored already.
COLLECTED = (
    P
    + f""", {R.removeprefix("WITH ")}, seg AS (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer),
  src AS (SELECT 'amazon' AS source UNION ALL SELECT 'greenhouse_' || s FROM seg UNION ALL SELECT 'lever_' || s FROM seg
    UNION ALL SELECT unnest(['lever_empty', 'lever_broken', 'lever_object', 'greenhouse_wrong'])),
  hist AS (SELECT bool_or(jobs_found > 0) AS had FROM (SELECT * FROM r WHERE status <> 'running' ORDER BY started_at DESC, id DESC LIMIT 7) t),
  placed AS (SELECT *, CASE id % 3 WHEN 0 THEN 'lever_' || source WHEN 1 THEN 'greenhouse_' || source ELSE 'amazon' END AS src,
      CASE id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS place, CASE WHEN id % 3 = 2 THEN 'Amazon' ELSE 'Acme' END AS firm,
      CASE id % 3 WHEN 0 THEN 'https://l.example/' WHEN 1 THEN 'https://g.example/' ELSE 'https://www.amazon.jobs/en/' END || id AS link,
      CASE WHEN id % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day
    FROM p WHERE {HIT.format("title || ' ' || location || ' ' || description")}),
  hit AS (SELECT *, {_norm("firm")} || '::' || {_norm("title")} || '::' || {_norm("location")} AS k FROM placed),
  old AS (SELECT DISTINCT 'acme::' || {_norm("title")} || '::' || {_norm("location")} AS k FROM p WHERE location < 'J'),
  recent AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place, src, id) AS n FROM hit WHERE day IS NULL OR day >= DATE '2001-06-01' - 1000),
  added AS (SELECT * FROM recent WHERE n = 1 AND k NOT IN (SELECT k FROM old)),
  f AS (SELECT src AS source, count(*) AS n, count(*) FILTER (day < DATE '2001-06-01' - 1000) AS skipped, count(*) FILTER (day IS NULL) AS undated FROM hit GROUP BY 1),
  i AS (SELECT src AS source, count(*) AS n FROM added GROUP BY 1)"""
)


def _collected(spark, sf):
    """The whole collection job over boards of two platforms and a company search, against a table that holds some of the keys. One board found
    nothing but has the events as its history, one could not be fetched, and two sent JSON of another shape."""
    rows = _dated(spark, sf)
    kind, undated = F.col("id") % 3, F.col("id") % 7 == 0
    lever = F.struct(
        F.col("title").alias("text"),
        F.concat(F.lit("https://l.example/"), _id()).alias("hostedUrl"),
        F.struct("location").alias("categories"),
        F.when(undated, 0).otherwise(F.unix_date("day").cast("long") * 86400000).alias("createdAt"),
        F.col("description").alias("descriptionPlain"),
    )
    greenhouse_ = F.struct(
        "title",
        F.concat(F.lit("https://g.example/"), _id()).alias("absolute_url"),
        F.struct(F.col("location").alias("name")).alias("location"),
        F.when(~undated, F.date_format("day", "yyyy-MM-dd'T'10:00:00")).alias("updated_at"),
        F.concat(F.lit("<p>"), "description", F.lit("</p>")).alias("content"),
    )
    amazon_ = F.struct(
        "title",
        "location",
        F.concat(F.lit("/en/"), _id()).alias("job_path"),
        "description",
        F.when(undated, "soon").otherwise(F.date_format("day", "MMMM d, yyyy")).alias("posted_date"),
    )
    columns = ("source", "url", "term", "fetched_at", "seq", "body", "error")
    good = [
        b.landed(rows.filter(kind == 0), lever, F.to_json, F.concat(F.lit("lever_"), "source")),
        b.landed(rows.filter(kind == 1), greenhouse_, _jobs, F.concat(F.lit("greenhouse_"), "source")),
        b.landed(rows.filter(kind == 2), amazon_, _jobs, F.lit("amazon")),
    ]
    raw = good[0].select(*columns).unionByName(good[1].select(*columns)).unionByName(good[2].select(*columns))
    for source, body, error in (
        ("lever_broken", None, "RuntimeError: site changed"),
        ("lever_object", '{"ok": false, "error": "not found"}', None),
        ("greenhouse_wrong", '{"jobs": "none"}', None),
    ):
        raw = raw.unionByName(good[0].limit(1).withColumns({"source": F.lit(source), "body": F.lit(body), "error": F.lit(error)}).select(*columns))

    segments = b.table(spark, sf, "customer").agg(F.array_sort(F.collect_set(F.lower("c_mktsegment"))).alias("slugs"))
    no_list = F.lit(None).cast("array<string>")

    def platform(name, *more):
        slugs = F.concat("slugs", F.array(*[F.lit(m) for m in more]))
        board = F.transform(slugs, lambda s: F.struct(s.alias("slug"), F.lit("Acme").alias("company"), no_list.alias("locations"), no_list.alias("keywords")))
        return segments.select(F.lit(name).alias("name"), F.lit(True).alias("enabled"), no_list.alias("keywords"), board.alias("boards"))

    config = platform("lever", "empty", "broken", "object").unionByName(platform("greenhouse", "wrong"))
    config = config.unionByName(segments.select(F.lit("amazon").alias("name"), F.lit(True).alias("enabled"), no_list.alias("keywords"), F.lit(None).cast(config.schema["boards"].dataType).alias("boards")))
    sources = expand_sources(config, ["high", "urgent"])
    past = b.runs(spark, sf).withColumn("source", F.lit("lever_empty"))
    stored = b.postings(spark, sf).filter("location < 'J'").withColumn("dedupe_key", text.dedupe_key(F.lit("Acme"), "title", "location"))
    return collect_all(raw, sources, stored, past, instant(AS_OF), 1000, kinds=["lever", "greenhouse", "amazon"])


@query(
    "collect_all",
    COLLECTED
    + """ SELECT src.source, CASE WHEN src.source IN ('lever_broken', 'lever_object', 'greenhouse_wrong') THEN 'error'
      WHEN coalesce(f.n, 0) = 0 AND src.source = 'lever_empty' AND (SELECT had FROM hist) THEN 'warning' ELSE 'ok' END AS status,
    coalesce(f.n, 0) AS jobs_found, coalesce(i.n, 0) AS jobs_inserted,
    CASE src.source WHEN 'lever_broken' THEN 'RuntimeError: site changed' WHEN 'lever_object' THEN 'TypeError: response has another shape'
      WHEN 'greenhouse_wrong' THEN 'TypeError: response has another shape' END AS error_message
  FROM src LEFT JOIN f ON src.source = f.source LEFT JOIN i ON src.source = i.source""",
)
def collection(spark, sf):
    return _collected(spark, sf).runs.select("source", "status", "jobs_found", "jobs_inserted", "error_message")


@query(
    "collect_postings",
    COLLECTED
    + """ SELECT title, firm AS company, location, src AS source, link AS url, description, strftime(day, '%Y-%m-%d') AS date_posted, k AS dedupe_key, 'new' AS status
  FROM added""",
)
def collected_postings(spark, sf):
    return _collected(spark, sf).postings.select("title", "company", "location", "source", "url", "description", "date_posted", "dedupe_key", "status")


@query(
    "collect_summary",
    COLLECTED
    + """, each AS (SELECT src.source, coalesce(f.n, 0) AS collected, coalesce(skipped, 0) AS skipped, coalesce(undated, 0) AS undated, coalesce(i.n, 0) AS new
    FROM src LEFT JOIN f ON src.source = f.source LEFT JOIN i ON src.source = i.source)
  SELECT source, 0 AS is_total, collected, skipped, undated, new FROM each
  UNION ALL SELECT NULL, 1, CAST(sum(collected) AS BIGINT), CAST(sum(skipped) AS BIGINT), CAST(sum(undated) AS BIGINT), CAST(sum(new) AS BIGINT) FROM each""",
)
def collected_summary(spark, sf):
    return _collected(spark, sf).summary
