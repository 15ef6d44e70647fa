"""URL filters with dated lists: each capture is judged by the entries that were active when it was fetched.

A list is a log: an entry (a host with all its subdomains, or a host and a path prefix) is put on a list or taken off it at a time. The log becomes validity
intervals, and an as-of join finds, for each capture, the interval of each of its keys that holds the fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.llm.shared import columns
from postmill.operators.skew import is_small
from postmill.session import stage

#: Intervals and fetch times meet in slices of time of this many seconds.
SLICE = 7 * 86_400


def host(url: Column) -> Column:
    """The host of an http or https URL, in lower case, without user, port and a dot at its end; null if there is none."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def path(url: Column) -> Column:
    """The path of a URL, with its first slash and without query and fragment."""
    return F.regexp_extract(F.trim(url), r"^[A-Za-z]+://[^/?#]*(/[^?#]*)?", 1)


def keys(url: Column) -> Column:
    """All entries that cover a URL, as an array: its host and every parent domain, and its host with every prefix of whole path parts."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))))
    return F.concat(F.coalesce(domains, F.array()), F.coalesce(prefixes, F.array()))


def intervals(log: DataFrame) -> DataFrame:
    """(entry, list, valid_from, valid_to) from ``log(entry, list, at, seq)``: each row holds from ``at`` until the entry's next row; a null list takes
    the entry off. ``valid_to`` is null for the last. Of rows of one time the last by ``seq`` (then by list) counts. Hosts are alike in
    any case, paths are not: an entry's host is lower-cased and its path is kept. Rows without entry or time are no rows. Repeated rows change nothing. A log row's successor is found within its entry, whose rows are as many as its changes."""
    rows = columns(log, "entry", "list", "at", "seq").filter("entry is not null and at is not null")
    name = F.substring_index("entry", "/", 1)
    rows = rows.withColumn("entry", F.concat(F.lower(name), F.substr("entry", F.length(name) + 1)))
    rows = rows.groupBy("entry", "at").agg(F.max(F.struct("seq", F.coalesce(F.col("list"), F.lit("")).alias("list"))).alias("last"))
    rows = rows.select("entry", "at", F.nullif(F.col("last.list"), F.lit("")).alias("list"))
    until = F.lead("at").over(Window.partitionBy("entry").orderBy("at"))
    return rows.withColumn("valid_to", until).filter("list is not null").select("entry", "list", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, log: DataFrame, allow: str = "allow", slice_seconds: int = SLICE) -> DataFrame:
    """(page_id, url, fetched_at, n_captures, host, n_active, entry, list, rejected) for every distinct row of ``captures(page_id, url, fetched_at)``.

    ``n_active`` counts the entries in force for the URL at the fetch time (from <= fetched < to), ``entry`` and ``list`` are those of the longest, which
    decides: the capture is rejected unless there is none or its list is ``allow``. n_captures counts equal rows. A null or unreadable URL has no host and
    no entries, and so has a null fetch time; extra columns are left out; empty tables give no rows, or captures without entries.

    Only keys that some list has an entry for are asked: the entries are broadcast if their counted number allows, else met in a semi join. Captures and
    intervals meet by entry and slice of time; an interval is put into those slices in which its entry has captures, so neither a long log nor a single
    capture of an odd date makes more rows than there are such slices. When one host has very many captures, its side can be split by adaptive execution.
    """
    rows = columns(captures, "page_id", "url", "fetched_at").groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("n_captures"))
    piece = lambda at: F.floor(F.unix_micros(at) / F.lit(slice_seconds * 1_000_000))
    valid = stage(intervals(log), "intervals")
    listed = valid.select("entry").distinct()
    asked = rows.filter("fetched_at is not null").select("page_id", "url", "fetched_at", F.explode(keys(F.col("url"))).alias("entry")).withColumn("piece", piece(F.col("fetched_at")))
    asked = stage(asked.join(F.broadcast(listed) if is_small(listed) else listed, "entry", "left_semi"), "asked")
    begins, ends = piece(F.col("valid_from")), piece(F.col("valid_to"))
    # Entries with very many captures are few slices here.
    met = asked.select("entry", "piece").distinct().join(valid, "entry").filter((F.col("piece") >= begins) & (F.col("valid_to").isNull() | (F.col("piece") <= ends)))
    active = asked.join(met, ["entry", "piece"]).filter("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    best = F.max_by(F.struct("entry", "list"), F.struct(F.length("entry"), F.col("entry"))).alias("best")
    active = active.groupBy("page_id", "url", "fetched_at").agg(F.count(F.lit(1)).alias("n_active"), best)
    found = active.toDF("_page_id", "_url", "_fetched_at", "n_active", "best")
    joined = rows.join(found, rows["page_id"].eqNullSafe(found["_page_id"]) & (rows["url"] == found["_url"]) & (rows["fetched_at"] == found["_fetched_at"]), "left")
    chosen = F.col("best.list")
    return joined.select(
        "page_id", "url", "fetched_at", "n_captures", host(F.col("url")).alias("host"), F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("best.entry").alias("entry"), chosen.alias("list"), F.coalesce(chosen != allow, F.lit(False)).alias("rejected"),
    )
