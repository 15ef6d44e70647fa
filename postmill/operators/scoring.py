"""Scoring of unscored postings with an injected scorer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.labels import scoring_prompt
from postmill.functions.text import as_col, strip
from postmill.operators.filters import unscored
from postmill.operators.skew import lookup_join
from postmill.session import stage


def parse_score_response(c: Column | str) -> Column:
    """(score, reason) of a JSON reply, NULL unless the score is 1..10 and the reason not blank.

    Numbers are truncated, text must be a whole number, true counts as 1, a null reason is the
    text 'None'.
    """
    reply = F.try_parse_json(as_col(c))
    score, reason = (F.try_variant_get(reply, f"$.{k}", "variant") for k in ("score", "reason"))
    kind = F.schema_of_variant(score)
    text = F.try_variant_get(reply, "$.score", "string")
    number = (
        F.when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
        .when(kind == "STRING", F.when(text.rlike(r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*$"), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("int")))
        .when(kind.isin("VOID", "NULL") | kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(None).cast("int"))
        .otherwise(text.try_cast("double").try_cast("int"))
    )
    words = F.try_variant_get(reply, "$.reason", "string")
    reason_kind = F.schema_of_variant(reason)
    said = (
        F.when(reason_kind == "VOID", F.lit("None"))
        .when(reason_kind == "BOOLEAN", F.initcap(words))
        .when(reason_kind.startswith("OBJECT") | reason_kind.startswith("ARRAY"), F.to_json(reason))
        .otherwise(words)
    )
    said = strip(said)
    return F.when(number.between(1, 10) & (said != ""), F.struct(number.alias("score"), said.alias("reason")))


def score_batch(df: DataFrame, scorer: Callable[[str], str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, reason, source) for every unscored posting.

    ``scorer`` maps one prompt to one JSON reply and runs in Arrow batches on the executors. An
    exception or an invalid reply leaves score and reason NULL, to be retried by a later run.
    """

    def reply_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str | None:
            try:
                return scorer(prompt)
            except Exception:
                return None

        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "reply": [one(p) for p in batch["prompt"]]})

    prompts = unscored(df).select("id", scoring_prompt().alias("prompt"))
    parsed = prompts.mapInPandas(reply_all, "id long, reply string").withColumn("_parsed", parse_score_response("reply"))
    return parsed.select("id", "_parsed.score", "_parsed.reason", F.lit("ai").alias("source"))


def score_prompts(
    df: DataFrame, scorer: Callable[[list[str]], list[str | None]], group: int = 16, concurrency: int = 4, tries: int = 3
) -> DataFrame:
    """As score_batch, with a scorer that takes many prompts at a time, and asks equal prompts once.

    ``scorer`` gets up to ``group`` prompts and returns a reply or None for each; a task has at most ``concurrency`` calls open. Prompts of a call that
    raised, or was answered short, and prompts without a valid reply are asked again, ``tries`` times in all. Replies are written before they are joined
    back to the postings, by a hash of the prompt.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(prompts: list[str]) -> list[str | None]:
            try:
                replies = list(scorer(prompts))
            except Exception:
                replies = []
            return replies[: len(prompts)] + [None] * (len(prompts) - len(replies))

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                prompts, replies = batch["prompt"].tolist(), [None] * len(batch)
                for _ in range(tries):
                    open_ = [i for i, reply in enumerate(replies) if not _usable(reply)]
                    groups = [open_[i : i + group] for i in range(0, len(open_), group)]
                    for own, found in zip(groups, pool.map(call, [[prompts[i] for i in own] for own in groups])):
                        for i, reply in zip(own, found):
                            replies[i] = reply
                yield pd.DataFrame({"key": batch["key"], "reply": replies})

    prompts = stage(unscored(df).select("id", scoring_prompt().alias("prompt")).withColumn("key", F.sha2("prompt", 256)), "prompts")
    unique = prompts.groupBy("key").agg(F.first("prompt").alias("prompt"))
    replies = stage(unique.mapInPandas(ask, "key string, reply string").withColumn("_parsed", parse_score_response("reply")).select("key", "_parsed"), "replies")
    found = lookup_join(prompts.select("id", "key"), replies, ["key"], "id")
    return found.select("id", "_parsed.score", "_parsed.reason", F.lit("ai").alias("source"))


def _usable(reply: str | None) -> bool:
    """Whether a reply is worth no further call: JSON with a score and a reason. parse_score_response judges them."""
    try:
        return {"score", "reason"} <= set(json.loads(reply or ""))
    except (ValueError, TypeError):
        return False
