import html as stdlib_html
import re
from datetime import date, datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, html, labels, text

SPACES = "  hello\n\tworld  ", "a b　c", "x\x1cy\x85z", "", None, " edge ", "plain words"


def test_clean_text_collapses_python_whitespace(evaluate):
    assert evaluate(SPACES, text.clean_text) == [" ".join((s or "").split()) for s in SPACES]


def test_strip_trims_python_whitespace(evaluate):
    given = [s for s in SPACES if s is not None]
    assert evaluate(given, text.strip) == [s.strip() for s in given]


def test_normalized_text_and_keys(evaluate, one):
    assert evaluate(["  Senior LLM-Engineer (m/w/d)! ", "München"], text.normalize_text) == ["senior llm engineer m w d", "m nchen"]
    lit = F.lit
    assert one(text.dedupe_key(lit("SAP"), lit("AI Engineer"), lit("Berlin, DE"))) == "sap::ai engineer::berlin de"
    assert one(text.dedupe_key(lit("SAP"), lit("AI Engineer"))) == "sap::ai engineer::"
    assert one(text.dedupe_key(lit("SAP"), lit(None).cast("string"), lit("x"))) is None


def test_company_names_fold_like_python(evaluate):
    # Every code point below 0x2200 and the ligatures, one at a time.
    given = [chr(c) for c in (*range(0x20, 0xD800, 1),) if c < 0x2200 or 0xFB00 <= c < 0xFB10] + ["ﬁﬆ Straße, Inc."]
    want = [re.sub("[^a-z0-9]+", "", s.casefold()) for s in given]
    assert evaluate(given, text.normalize_company) == want


KEYWORD_CASES = [
    "Building a RAG pipeline", "Senior LLM Engineer", "multi-agent systems", "cloud storage engineer", "Werbeagentur Berlin",
    "Fullmetal Alchemist", "_rag_", "ſrag", "Krag", "ragı", "ürag", "c++ dev", "axb", "a.b", "",
]


@pytest.mark.parametrize("keywords", [("rag", "llm", "agent"), ("genai",), ("c++", "a.b"), ("x y", "#"), ()])
def test_keywords_match_on_boundaries(evaluate, keywords):
    want = [any(re.search(rf"(?<![a-z0-9]){re.escape(k)}(?![a-z0-9])", t, re.IGNORECASE) for k in keywords) for t in KEYWORD_CASES]
    assert evaluate(KEYWORD_CASES, lambda c: text.contains_keyword(c, keywords)) == want
    array = F.array(*[F.lit(k) for k in keywords]).cast("array<string>")
    assert evaluate(KEYWORD_CASES, lambda c: text.matches_pattern(c, text.keyword_pattern(array))) == want


def test_like_is_ascii_case_blind_without_escapes(evaluate):
    given = ["100% sure", "a_b", "axb", r"a\%b", "MÜNCHEN", "münchen", "xMNCHEN"]
    assert evaluate(given, lambda c: text.like_anywhere(c, "A_B")) == [False, True, True, False, False, False, False]
    assert evaluate(given, lambda c: text.like_anywhere(c, "\\%B")) == [False, False, False, True, False, False, False]
    assert evaluate(given, lambda c: text.like_anywhere(c, "mün")) == [False] * 5 + [True, False]


def test_small_text_helpers(evaluate, one):
    given = ["n8n-io", "they're bill", "ALEPH alpha", "a1b2", "über-chef"]
    assert evaluate(given, text.title_case) == [s.title() for s in given]
    assert evaluate(["a::b", "a::b::c", "", ":::"], lambda c: text.count_substring(c, "::")) == [1, 2, 0, 1]
    assert evaluate(["<a & 'b' \"c\">", None], text.html_escape) == [stdlib_html.escape("<a & 'b' \"c\">"), ""]
    assert evaluate(["x" * 80, "x" * 81], text.plausible_location) == ["x" * 80, ""]
    assert one(text.first_nonempty(F.lit(""), F.lit(None).cast("string"), F.lit("c"))) == "c"
    assert evaluate(["Berlin, Germany", "Paris"], lambda c: text.matches_location(c, ["BERLIN"])) == [True, False]
    assert evaluate(["Paris"], lambda c: text.matches_location(c, [])) == [True]


def test_string_or_blank_only_takes_strings(evaluate):
    given = ['" a "', "5", "true", "null", '{"a": 1}', '["a"]']
    assert evaluate(given, lambda c: text.string_or_blank(F.parse_json(c))) == ["a", "", "", "", "", ""]


ISO = [
    "2026-07-01", "20260701", "2026-7-1", "2026-W27-3", "2026W273", "2026-W27", "2026W27", "01.07.2026", "2026-W53-1", "2027-W53-1",
    "2020-W53-7", "2026-W00-1", "2026-W10-8", "2026-02-30", "2026-07-01T10:00:00Z", "not-a-date", "", "2026W27-3", "2026-W273",
    "0000-01-01", "20260701T10", "2025-W01-1", "2026W273T1", "2026-07-1", "20260230",
]


def test_posted_on_reads_what_fromisoformat_reads(evaluate):
    def python(s):
        try:
            return date.fromisoformat(s[:10])
        except ValueError:
            return None

    assert evaluate(ISO, dates.posted_on) == [python(s) for s in ISO]


@pytest.mark.parametrize(
    "ours, theirs",
    [
        (dates.TABLE_ROW_FORMATS, ("%b %d, %Y", "%d.%m.%Y", "%Y-%m-%d")),
        (dates.LONG_MONTH_FORMATS, ("%B %d, %Y",)),
        (dates.LISTING_FORMATS, ("%d.%m.%Y", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y")),
    ],
)
def test_date_formats_agree_with_strptime(evaluate, ours, theirs):
    given = [
        "Jul 1, 2026", "July 1, 2026", "1.7.2026", "01.07.2026", "2026-07-01", "2026-7-1", "07/13/2026", "13/07/2026", "03/04/2026",
        "1.7.26", "jul 01, 2026", "December  3, 2024", "Feb 30, 2026", "31.02.2026", "", "x",
    ]

    def python(value):
        for fmt in theirs:
            try:
                return datetime.strptime(value, fmt).date()
            except ValueError:
                pass

    assert evaluate(given, lambda c: dates.parse_date_any(c, ours)) == [python(v) for v in given]


def test_instants(evaluate, one):
    given = ["2026-01-01T00:00:00Z", "2026-01-01T10:00:00-04:00", "2026-01-01 10:00:00", "2026-01-01", "2026-01-01T10:00", "x", None]
    want = ["2026-01-01T00:00:00Z", "2026-01-01T14:00:00Z", "2026-01-01T10:00:00Z", "2026-01-01T00:00:00Z", "2026-01-01T10:00:00Z", None, None]
    assert evaluate(given, lambda c: dates.format_instant(dates.parse_instant(c))) == want
    assert one(dates.epoch_ms_to_date(F.lit(1751328000000))) == date(2025, 7, 1)
    assert one(dates.epoch_ms_to_date(F.lit(-1))) == date(1969, 12, 31)
    assert one(dates.epoch_ms_to_date(F.lit(0))) is None


ENTITIES = [
    "a &amp;lt; b", "&notit; x", "&rarr;&eacute;&#8364;&#x20AC;&#150;&#0;&#xD800;&unknown; & c", "x&lt", "&#38;lt;", "&#1;z", "&copy2026",
    "a&", "no amp", "&#99999999999;", "&nbsp;&apos;&quot;", "&#xfdd0;x", "&#x81;", "&AMP;&hArr;&fjlig;",
]


def test_entities_decode_like_the_standard_library(evaluate):
    assert evaluate(ENTITIES, html.decode_entities) == [stdlib_html.unescape(s) for s in ENTITIES]


def test_strip_html(evaluate):
    given = [
        "&lt;p&gt;Build &lt;b&gt;RAG&lt;/b&gt; systems.&lt;/p&gt;",
    ]
    assert evaluate(given, lambda c: html.strip_html(c, decode_first=True)) == ["Build RAG systems."]
    given = ["<p>a<!-- <b>x</b> -->b<script>var t='</p>';</script> 1 < 2 &amp;amp; <STYLE>q{}</STYLE><br/>end", None, "<noscript>n</noscript>k"]
    assert evaluate(given, html.strip_html) == ["a b 1 < 2 &amp; end", "", "n k"]
    assert evaluate(given[2:], lambda c: html.strip_html(c, drop=("noscript",))) == ["k"]


def test_element_and_anchor_extraction(evaluate):
    page = '<body><div class="x"><div class="jobdetail main"><div>in</div> t<div>u</div></div> after</div></body>'
    opening = html.opening(attribute=html.attr_contains("class", "jobdetail"))
    assert evaluate([page, "<p>none"], lambda c: html.element_inner(c, opening)) == ["<div>in</div> t<div>u</div>", None]
    assert evaluate(["<main>hello <main>x</main></main> y", "<main>open"], lambda c: html.element_inner(c, html.opening("main"))) == ["hello <main>x</main>", "open"]
    exact = html.opening(attribute=html.class_token("job"))
    assert evaluate(['<i class="jobs">a</i><i class="a job b">c</i>'], lambda c: html.element_inner(c, exact)) == ["c"]
    links = "<a href=\"/x\">t</a> <a class='q' href='/y?a=1&amp;b=2'>u <b>v</b></a>"
    assert evaluate([links], lambda c: F.transform(html.anchors(c), lambda a: html.attribute(a, "href"))) == [["/x", "/y?a=1&b=2"]]


@pytest.mark.parametrize("base", ["https://h.example/a/b/c?q=1#f", "https://h.example", "https://h.example/x"])
def test_urls_resolve_like_urljoin(evaluate, base):
    given = [
        "https://o/x", "//o/p", "/root", "rel", "../up", "../../../z", "./same", "?q=2", "#frag", "", "g/../h", "mailto:a@b", "/a/./b/../c",
        "..", ".", "x?y=/../z", "/..", "a//b",
    ]
    assert evaluate(given, lambda c: html.absolutize_url(F.lit(base), c)) == [urljoin(base, h) for h in given]


def test_labels(evaluate, one):
    given = [
        "Title Location: Munich, DE | x", "Office: far City: near", "In berlin, Germany | y", "Antwort: 42", "zip", "Location: " + "x" * 90 + " Berlin",
    ]
    assert evaluate(given, labels.extract_location) == ["Munich, DE", "near", "berlin", "42", "", ""]
    given = ["Posted: 01.07.2026 x Date Posted: 02.07.2026 y", "posted: ", "Published:  soon", "no"]
    assert evaluate(given, labels.extract_date_posted) == ["02.07.2026", None, "soon", None]
    detail = F.lit("Jobs Location(s): Munich - Bavaria - Germany LLM Engineer wanted")
    assert one(labels.location_after_label(detail, F.lit("LLM Engineer"))) == "Munich - Bavaria - Germany"
    assert one(labels.location_after_label(F.lit("Location Foo - LLM Engineer x"), F.lit("LLM Engineer"))) == "Foo"
    assert evaluate(["ok", "zz"], labels.status_label) == ["🟢 ok", "? zz"]
    assert evaluate(["greenhouse_acme", "sap"], labels.source_kind) == ["greenhouse", "sap"]


def test_job_links(spark):
    rules = labels.LinkRules(domains=("acme.example", "ats"), own_domain_path="/detail")
    cases = [
        ("https://acme.example/job/detail/1", "Engineer", True),
        ("https://acme.example/job/1", "Engineer", False),
        ("https://ats.example/job/1", "Engineer", True),
        ("https://other.example/job/1", "Engineer", False),
        ("https://ats.example/job/login", "Engineer", False),
        ("https://ats.example/job/1", "Job Search", False),
        ("https://ats.example/job/1", "abc", False),
        ("https://ats.example/x", "Engineer", False),
    ]
    rows = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases)], "i int, u string, t string")
    found = {r.i: r.ok for r in rows.select("i", labels.is_job_url("u", "t", rules).alias("ok")).collect()}
    assert [found[i] for i in range(len(cases))] == [want for *_, want in cases]
