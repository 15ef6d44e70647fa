import json

from pyspark.sql import functions as F

from postmill.functions import text
from postmill.operators import aggregates
from postmill.operators.dedupe import left_out
from postmill.schema import RAW
from postmill.sources import boards, listings, registry, searches


def landed(spark, source, *bodies, url="https://site.example/search/"):
    rows = [(source, url, None, "2026-07-10T08:00:00Z", i, body, None) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, RAW).withColumns(
        {"company": F.lit("Acme"), "locations": F.lit(None).cast("array<string>"), "keyword_pattern": text.keyword_pattern(F.array(F.lit("llm"))), "rank": F.lit(0)}
    )


def details(spark, source, pages):
    return spark.createDataFrame([(source, u, 0, b) for u, b in pages.items()], "source string, url string, seq long, body string")


def test_greenhouse_falls_back_and_fills_blanks(spark):
    body = json.dumps({"jobs": [{"title": None, "updated_at": "", "first_published": "2026-01-02T00:00:00Z", "content": None}, {}]})
    first, second = boards.from_greenhouse(landed(spark, "greenhouse_x", body)).orderBy("pos").collect()
    assert (first.title, first.location, first.url, first.description, first.date_posted) == ("", "", "", "", "2026-01-02")
    assert second.date_posted is None


def test_missing_lists_give_no_rows(spark):
    assert boards.from_greenhouse(landed(spark, "g", "{}", '{"jobs": null}')).count() == 0
    assert boards.from_lever(landed(spark, "l", "[]")).count() == 0
    assert searches.from_amazon(landed(spark, "amazon", "{}")).count() == 0


def test_apple_pages_without_readable_state(spark):
    state = json.dumps(json.dumps({"loaderData": {"search": {"searchResults": [{"id": "42-1", "postingTitle": "LLM ä", "locations": [{"name": "Munich"}, {}]}]}}}))
    good = f"<script>window.__staticRouterHydrationData = JSON.parse({state});</script>"
    broken = '<script>window.__staticRouterHydrationData = JSON.parse("{oops");</script>'
    (row,) = searches.from_apple(landed(spark, "apple", "<html>none</html>", broken, good)).collect()
    assert (row.title, row.location, row.url, row.seq) == ("LLM ä", "Munich", "https://jobs.apple.com/en-us/details/42", 2)


def test_porsche_noise_and_first_id(spark):
    def term(total, *items):
        found = [{"MatchedObjectDescriptor": i} for i in items]
        return json.dumps({"SearchResult": {"SearchResultCountAll": total, "SearchResultItems": found}})

    a = {"ID": 1, "PositionURI": "https://p/1", "PositionTitle": "First", "PositionLocation": [{"CityName": "Stuttgart", "CountryName": "Germany"}]}
    raw = landed(spark, "porsche", term(201, a), term(200, a, {**a, "ID": 2, "PositionURI": ""}), term(1, {**a, "PositionTitle": "Again"}))
    (row,) = searches.from_porsche(raw, None, max_results=200).collect()
    assert (row.title, row.location, row.description, row.seq) == ("First", "Stuttgart, Germany", "", 1)


def test_successfactors_cap_and_markers(spark):
    row = '<tr><td><a class="jobTitle-link" href="/job/{0}">Dev {0}</a></td><td><span class="jobLocation">{1}</span><span class="jobDate">Jul {0}, 2026</span></td></tr>'
    page = "<table>" + "".join(row.format(i, "Walldorf, DE, 69190" if i != 2 else "Paris, FR") for i in range(1, 6)) + '</table><a class="jobTitle-link" href="/job/9">loose</a>'
    raw = landed(spark, "sap", page, page)
    rows = listings.from_successfactors(raw, None, max_detail=3).orderBy("pos").collect()
    assert [r.url for r in rows] == [f"https://jobs.sap.com/job/{i}" for i in (1, 3, 4)]
    assert (rows[0].date_posted, rows[0].location, rows[0].title) == ("2026-07-01", "Walldorf, DE, 69190", "Dev 1")
    everything = listings.from_successfactors(raw, None, markers=())
    assert everything.count() == 6
    assert [tuple(r) for r in left_out(listings.successfactors_rows(raw), 3).collect()] == [("sap", 1)]


def test_no_default_cap(spark):
    row = '<tr><td><a class="jobTitle-link" href="/job/{0}">Dev {0}</a></td><td><span class="jobLocation">Bonn, DE</span></td></tr>'
    assert listings.from_successfactors(landed(spark, "sap", "".join(row.format(i) for i in range(300)))).count() == 300
    links = "".join(f'<a href="/JobDetail/{i}">Engineer {i}</a>' for i in range(300))
    assert listings.from_siemens(landed(spark, "siemens", links)).count() == 300
    items = [{"MatchedObjectDescriptor": {"ID": i, "PositionURI": f"https://p/{i}", "PositionTitle": "T"}} for i in range(300)]
    raw = landed(spark, "porsche", json.dumps({"SearchResult": {"SearchResultCountAll": 300, "SearchResultItems": items}}))
    assert searches.from_porsche(raw).count() == 300


def test_positions_on_a_page_of_very_many_pieces(spark):
    page = "<tr></tr>" * 300_000 + '<tr><td><a class="jobTitle-link" href="/job/1">Dev</a></td><td><span class="jobLocation">Bonn, DE</span></td></tr>'
    (row,) = listings.from_successfactors(landed(spark, "sap", page)).collect()
    assert row.pos == 300_000 << 32


def test_text_behind_a_card_is_not_its_text(spark):
    page = (
        '<div class="job-title"><div><a href="/jobs/view/1">LLM Engineer</a></div></div><footer>Location: Oslo | Posted: 01.02.2020</footer>'
        '<section class="result"><a href="/jobs/view/2">RAG Engineer</a> Location: Bonn | Posted: 03.04.2021</section>'
    )
    found = listings.rendered_links(landed(spark, "meta", page)).orderBy("pos").select("card_text").collect()
    assert [r.card_text for r in found] == ["LLM Engineer", "RAG Engineer Location: Bonn | Posted: 03.04.2021"]


def test_a_link_has_the_smallest_card_around_it(spark):
    page = (
        '<div class="job-results">All<ul><li>One <ul class="x"><li class="card">inner <a href="/jobs/view/1">A</a></li></ul> after <a href="/jobs/view/2">B</a> end</li>'
        '<li>Two <a href="/jobs/view/3">C</a> open<li>Three <a href="/jobs/view/4">D</a> list ends</ul> tail <a href="/jobs/view/5">E</a>'
        '<a class="job-card" href="/jobs/view/6"><b>F</b> own</a><div>plain <div class="result"><div>deep</div> <a href="/jobs/view/7">G</a></div> rest</div></div>'
        '<p>outside <a href="/jobs/view/8">H</a></p><TABLE><TR><td><a href="/jobs/view/9">I</a><td>cell<tr><td>next <a href="/jobs/view/10">J</a></table> behind'
    )
    found = {r.title: r.card_text for r in listings.rendered_links(landed(spark, "meta", page)).collect()}
    every = "All One inner A after B end Two C open Three D list ends tail E F own plain deep G rest"
    assert {k: " ".join(v.split()) for k, v in found.items()} == {
        "A": "inner A", "B": "One inner A after B end", "C": "Two C open", "D": "Three D list ends", "E": every.replace("E F", "EF"), "F own": "F own", "G": "deep G", "H": "H", "I": "I cell", "J": "next J",
    }


def test_cards_on_a_page_of_many_tags(spark):
    page = "<div class='result'>" * 30 + "".join(f"<li>n{i} <a href='/jobs/view/{i}'>T{i}</a></li>" for i in range(1500)) + "</div>" * 30
    rows = listings.rendered_links(landed(spark, "meta", page)).collect()
    assert len(rows) == 1500 and all(r.card_text == f"n{r.title[1:]} {r.title}" for r in rows)


def test_siemens_longest_text_and_cap(spark):
    page = "".join(f'<a href="/JobDetail/{i}">LLM Engineer {i}</a><a href="/JobDetail/{i}">Learn more</a>' for i in range(3)) + '<a href="/JobDetail/x">Learn more</a>'
    url = "https://jobs.siemens.com/JobDetail/0"
    pages = details(spark, "siemens", {url: "<main>Location(s): Munich - Bavaria - Germany LLM Engineer 0 text</main>"})
    rows = {r.url: r for r in listings.from_siemens(landed(spark, "siemens", page), pages, max_detail=None).collect()}
    assert len(rows) == 3 and rows[url].location == "Munich - Bavaria - Germany" and rows[url].keyword_hit
    assert rows["https://jobs.siemens.com/JobDetail/1"].location == ""
    assert listings.from_siemens(landed(spark, "siemens", page), pages, max_detail=2).count() == 2


def test_rendered_bmw_needs_a_recent_local_listing(spark):
    card = '<li><a href="https://www.bmwgroup.jobs/jobfinder/job-description/{0}">LLM Engineer {0}</a> Location: {1} | Posted: {2}</li>'
    page = card.format(1, "Munich", "09.07.2026") + card.format(2, "Munich", "01.07.2026") + card.format(3, "Oslo", "10.07.2026") + card.format(4, "Berlin", "10.07.2026")
    base = "https://www.bmwgroup.jobs/jobfinder/job-description/"
    pages = details(spark, "bmw", {base + str(i): "<main><h1>Agents</h1>We use LLM tools</main>" for i in (1, 2, 3)})
    rows = listings.from_rendered_listings(landed(spark, "bmw", page), pages).collect()
    assert [(r.url, r.title, r.location, r.date_posted, r.keyword_hit) for r in rows] == [(base + "1", "Agents", "Munich", "09.07.2026", True)]


def test_longest_text_prefers_the_first_on_ties(spark):
    rows = spark.createDataFrame([("s", "u", "ab", 0, 1), ("s", "u", "cd", 0, 2), ("s", "u", "", 0, 0), ("s", "v", "", 0, 3)], "source string, url string, text string, seq int, pos int")
    assert [(r.url, r.text, r.pos) for r in aggregates.longest_text_per_url(rows).collect()] == [("u", "ab", 1)]


def test_search_terms_and_registry(spark, one):
    words = F.array(*[F.lit(w) for w in ("rag", "llm", "generative")])
    assert one(registry.search_terms(words)) == ["retrieval", "generative", "llm"]
    sources = spark.createDataFrame([("meta", ["llm", "rag"])], "source string, keywords array<string>")
    urls = [r.url for r in registry.search_requests(sources, registry.template_frame(spark)).orderBy("term_no").collect()]
    assert urls == [f"https://www.metacareers.com/jobs?q={k}&offices[0]=Germany" for k in ("llm", "rag")]
    reader = lambda raw, pages: raw
    registry.register_source("custom", reader)
    assert registry.READERS.pop("custom") is reader
    assert set(registry.READERS) == set(registry.SINGLE_SOURCES) | set(registry.BOARD_PLATFORMS)


def test_all_kinds_read_together(spark):
    """One plan over every kind of source; unreadable pages of one leave the others alone."""
    from postmill.plans.collection import parse_sources

    config = {"collectors": {name: {"enabled": True} for name in registry.SINGLE_SOURCES}}
    sources = registry.expand_sources(registry.config_frame(spark, config), ["llm"])
    amazon = json.dumps({"jobs": [{"title": "LLM Scientist", "location": "Berlin", "job_path": "/en/1"}]})
    raw = landed(spark, "amazon", amazon).select(*RAW.names).union(landed(spark, "meta", "<p>x").select(*RAW.names))
    pages = spark.createDataFrame([], RAW)
    found = parse_sources(raw, sources, pages).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in found} == {"amazon": 1}


def test_places_of_links_are_sought_once_a_page(spark):
    plan = listings.rendered_links(landed(spark, "bmw", "<p>x</p>"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("/a)") == 1


def test_titles_and_dates_of_table_rows_are_read_behind_the_dedupe(spark):
    cell = '<span class="jobLocation">Bonn, DE</span><span class="jobDate"><span>1.2.2001</span> at <span>noon</span></span>'
    page = f'<table><tr><a class="jobTitle-link" href="/j/1"><b>One</b></a><a class="jobTitle-link" href="/j/1">again</a>{cell}</table>'
    rows = listings.successfactors_rows(landed(spark, "sap", page))
    assert [(r.title, r.date, r.location) for r in rows.collect()] == [("One", "1.2.2001 at noon", "Bonn, DE")]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert "_anchor" in plan[: plan.index("Window")]
