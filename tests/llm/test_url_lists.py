import random
from datetime import datetime, timedelta

from postmill.llm import url_lists
from postmill.llm.url_lists import intervals, judge

DAY = datetime(2024, 3, 1)


def covering(url):
    url = (url or "").strip()
    if not url.lower().startswith(("http://", "https://")):
        return None, set()
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c)[0]
    name, _, path = rest.partition("/")
    host = name.split("@")[-1].split(":")[0].lower().rstrip(".")
    labels, parts = host.split("."), [p for p in path.split("/") if p]
    return host, {".".join(labels[i:]) for i in range(len(labels))} | {host + "/" + "/".join(parts[: i + 1]) for i in range(len(parts))}


def brute(captures, log):
    out = set()
    for page, url, at in captures:
        host, entries = covering(url)
        active = []
        for entry in entries if at else ():
            past = [(t, seq, kind) for e, kind, t, seq in log if e and t and e.lower() == entry and t <= at]
            if past:
                kind = max(past, key=lambda x: (x[0], x[1], x[2] or ""))[2]
                if kind:
                    active.append((len(entry), entry, kind))
        best = max(active, default=(0, None, None))
        out.add((page, url, at, captures.count((page, url, at)), host, len(active), best[1], best[2], best[2] is not None and best[2] != "allow"))
    return out


def test_query_equals_brute_force(spark):
    rng = random.Random(8)
    hosts = ["example.com", "a.example.com", "b.a.example.com", "other.org", "Shop.Other.org"]
    entries = ["example.com", "A.example.com", "com", "other.org", "other.org/x", "shop.other.org/x/y", "b.a.example.com/x", "nowhere.net"]
    log = [(rng.choice(entries), rng.choice(["block", "allow", None]), DAY + timedelta(days=rng.randrange(60), hours=rng.randrange(2) * 12), i % 40) for i in range(160)]
    log += log[:5] + [(None, "block", DAY, 1), ("example.com", "block", None, 1)]
    captures = [(i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y/z?q=/w', '/xy#f', ':80/x/'])}", DAY + timedelta(hours=6 * rng.randrange(240))) for i in range(200)]
    captures += [(1000, None, DAY), (1001, "example.com/x", DAY), (1002, "http://example.com/", None), (None, "http://u:p@example.com./", DAY + timedelta(days=20)), captures[0], captures[0]]
    c = spark.createDataFrame([(*r, "x", 1) for r in captures], "page_id long, url string, fetched_at timestamp, entry string, piece int")
    lists = spark.createDataFrame([(*r, 1) for r in log], "entry string, list string, at timestamp, seq long, valid_to int")
    for slice_seconds in (7 * 86_400, 3600 * 5):
        assert {tuple(r) for r in judge(c, lists, slice_seconds=slice_seconds).collect()} == brute(captures, log)


def test_odd_dates_and_unlisted_hosts_make_no_rows(spark, monkeypatch):
    log = [(f"h{i}.com", "block", DAY + timedelta(days=i), 1) for i in range(30)] + [("x.org", "allow", datetime(1970, 1, 2), 1)]
    captures = [(i, f"http://a.h{i % 40}.com/p", DAY + timedelta(days=9)) for i in range(80)] + [(900, "http://h3.com/", datetime(9990, 1, 1)), (901, "http://h3.com/", datetime(1903, 1, 1)), (902, "http://x.org/", datetime(1971, 1, 1))]
    staged = {}
    monkeypatch.setattr(url_lists, "stage", lambda df, name: staged.setdefault(name, df))
    rows = judge(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(log, "entry string, list string, at timestamp, seq long")).collect()
    assert {tuple(r) for r in rows} == brute(captures, log)
    # Of each capture's two domains and path only listed entries are asked.
    assert staged["asked"].count() == sum(i % 40 < 30 for i in range(80)) + 3


def test_intervals_follow_each_other(spark):
    log = [("a", "block", DAY, 1), ("a", "block", DAY, 1), ("a", None, DAY + timedelta(1), 2), ("A", "allow", DAY + timedelta(2), 3)]
    rows = intervals(spark.createDataFrame(log, "entry string, list string, at timestamp, seq long")).orderBy("valid_from").collect()
    assert [tuple(r) for r in rows] == [("a", "block", DAY, DAY + timedelta(1)), ("a", "allow", DAY + timedelta(2), None)]


def test_empty(spark):
    c = spark.createDataFrame([(1, "http://a.b/", DAY)], "page_id long, url string, fetched_at timestamp")
    log = spark.createDataFrame([("b", "block", DAY, 1)], "entry string, list string, at timestamp, seq long")
    assert judge(c.limit(0), log).count() == 0
    assert [(r.n_active, r.rejected) for r in judge(c, log.limit(0)).collect()] == [(0, False)]
    assert [(r.n_active, r.rejected) for r in judge(c, log).collect()] == [(1, True)]


def test_paths_keep_their_case(spark):
    log = [("Example.COM/Private", "block", DAY, 1), ("example.com/private/Open", "allow", DAY, 2), ("example.com/Private/Open", "allow", DAY, 3), ("EXAMPLE.com/Private/Open", None, DAY + timedelta(5), 4), ("other.org/É/X", "block", DAY, 5)]
    assert {r.entry for r in intervals(spark.createDataFrame(log, "entry string, list string, at timestamp, seq long")).collect()} == {"example.com/Private", "example.com/private/Open", "example.com/Private/Open", "other.org/É/X"}
    urls = ["http://example.com/Private/x", "http://EXAMPLE.com/private/x", "http://example.com/Private/Open/y", "http://example.com/private/Open", "http://Example.com/PRIVATE", "http://other.org/É/X/z", "http://other.org/é/x"]
    captures = [(10 * d + i, url, DAY + timedelta(days=d)) for d in (1, 9) for i, url in enumerate(urls)]
    rows = judge(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(log, "entry string, list string, at timestamp, seq long")).collect()
    found = {r.page_id: (r.n_active, r.entry, r.rejected) for r in rows}
    assert found[10] == (1, "example.com/Private", True) and found[11] == found[14] == found[16] == (0, None, False) and found[15] == (1, "other.org/É/X", True)
    assert found[12] == (2, "example.com/Private/Open", False) and found[92] == (1, "example.com/Private", True) and found[13] == (1, "example.com/private/Open", False)
