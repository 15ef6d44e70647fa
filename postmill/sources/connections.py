"""The personal-contacts document as a lookup by normalised company name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import normalize_company, string_or_blank
from postmill.operators.dedupe import last_wins

# Leaves are variants, because a number must read as blank and not as its digits.
DOCUMENT = """companies array<struct<company:variant, aliases:array<variant>,
    connections:array<struct<name:variant, relationship:variant, notes:variant>>, notes:variant>>"""
LOOKUP = """company_key string, company string, aliases array<string>,
    contacts array<struct<name:string, relationship:string, notes:string>>, notes string"""


def connections_lookup(companies: DataFrame) -> DataFrame:
    """One row per company name or alias from rows (seq, entry); the last entry of a name wins."""
    blank_free = F.filter(F.transform("entry.aliases", string_or_blank), lambda a: a != "")
    contacts = F.transform(
        "entry.connections",
        lambda c: F.struct(*[string_or_blank(c[f]).alias(f) for f in ("name", "relationship", "notes")]),
    )
    read = companies.select(
        "seq",
        string_or_blank("entry.company").alias("company"),
        F.coalesce(blank_free, F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(
            F.filter(contacts, lambda c: c["name"] != ""),
            F.array().cast("array<struct<name:string,relationship:string,notes:string>>"),
        ).alias("contacts"),
        string_or_blank("entry.notes").alias("notes"),
    ).filter(F.col("company") != "")
    names = F.concat(F.array("company"), "aliases")
    keyed = read.select("*", F.posexplode(names).alias("_n", "_name")).withColumn("company_key", normalize_company("_name"))
    return last_wins(keyed, ["company_key"], ["seq", "_n"]).select("company_key", "company", "aliases", "contacts", "notes")


def load_connections(spark: SparkSession, path: str) -> DataFrame:
    """Read the document; a missing file is an empty lookup, malformed JSON raises when read."""
    try:
        document = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOOKUP)
    return connections_lookup(document.select(F.posexplode("companies").alias("seq", "entry")))
