"""Run health as runs arrive: each run is judged by its source's latest finished runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from postmill.operators.dedupe import first_rows
from postmill.operators.runs import run_status, settled, status_of
from postmill.schema import RUNS
from postmill.session import stage
from postmill.sources.tables import StoredTable

# A failed run is judged as having found nothing; what it did find, which counts as history, is kept as ``landed_found``.
JUDGED = T.StructType([*RUNS.fields, T.StructField("landed_found", T.LongType()), T.StructField("had_postings", T.BooleanType()), T.StructField("derived_status", T.StringType())])
TAIL = T.StructType([f for f in RUNS.fields if f.name in ("id", "source", "started_at", "jobs_found", "status")])


def run_health_stream(
    runs: DataFrame, judged: StoredTable, tail: StoredTable, checkpoint: str, n: int = 7, chunk: str = "hour"
) -> StreamingQuery:
    """Judge each batch's runs with the batch operator, given the last ``n`` runs per source.

    The state is that tail, a stored table of at most ``n`` rows per source. A source with very
    many runs in one batch is still split by time there, which a keyed state function could not
    do: it would get all of a source's rows in one call. Runs that come late, before runs already
    judged, are judged with their source's stored history instead of its tail.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        token = f"health:{batch_id}"
        new = stage(batch, "runs-batch")
        before = tail.read()
        ends = before.groupBy("source").agg(F.max("started_at").alias("_end"), F.count(F.lit(1)).alias("_kept")).filter(F.col("_kept") >= n)
        late = stage(new.join(ends, "source").filter("started_at <= _end").select("source").distinct(), "late-sources")
        history = before
        if not late.isEmpty():
            stored = judged.read().withColumn("jobs_found", F.col("landed_found")).select(*TAIL.names).join(late, "source", "left_semi")
            history = before.join(late, "source", "left_anti").unionByName(stored)
        carried = history.withColumn("_old", F.lit(True))
        both = new.withColumns({"_old": F.lit(False), "landed_found": F.col("jobs_found")}).unionByName(carried, allowMissingColumns=True)
        verdicts = run_status(both, n, chunk).filter(~F.col("_old")).drop("_old")
        judged.append(verdicts, token)
        rows = settled(new).select(*TAIL.names).unionByName(before)
        tail.replace(first_rows(rows, ["source"], [F.desc("started_at"), F.desc("id")], n), token)

    return (
        runs.writeStream.queryName("health")
        .foreachBatch(judge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# What the keyed state says of a run: the verdict, if ``sure``, and whether it is a row of its chunk's edges.
_SAID = T.StructType(
    [
        *TAIL.fields,
        T.StructField("chunk_end", T.TimestampType()),
        T.StructField("had_postings", T.BooleanType()),
        T.StructField("sure", T.BooleanType()),
        T.StructField("edge", T.BooleanType()),
    ]
)
EDGES = T.StructType([*TAIL.fields, T.StructField("chunk_end", T.TimestampType()), T.StructField("batch_id", T.LongType())])
VERDICTS = T.StructType([*TAIL.fields, T.StructField("had_postings", T.BooleanType()), T.StructField("derived_status", T.StringType())])


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype(np.int64).to_numpy()


def _judge_chunk(n: int):
    """The state function of one source and chunk of time. Its state is the chunk's finished runs, as (start, id, found) in that order."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        source, end = key
        new = pd.concat(list(batches), ignore_index=True)
        known = np.frombuffer(state.get[0], np.int64).reshape(-1, 3) if state.exists else np.zeros((0, 3), np.int64)
        own = np.stack((_micros(new["started_at"]), new["id"].to_numpy(np.int64), new["jobs_found"].to_numpy(np.int64)), axis=1)
        every = np.concatenate((known, own))
        order = np.lexsort((every[:, 1], every[:, 0]))
        every, place = every[order], np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # Runs with postings before each place; of the n before it.
        before = np.concatenate(([0], np.cumsum(every[:, 2] > 0)))
        at = place[len(known) :]
        had = before[at] > before[np.maximum(at - n, 0)]
        yield new.assign(chunk_end=end, had_postings=had, sure=had | (at >= n), edge=False)[_SAID.names]
        state.update((every.tobytes(),))
        state.setTimeoutTimestamp(int(pd.Timestamp(end).as_unit("ms").value))
        edge = every[np.unique(np.concatenate((np.arange(min(n, len(every))), np.arange(max(0, len(every) - n), len(every)))))]
        yield pd.DataFrame(
            {
                "id": edge[:, 1], "source": source, "started_at": pd.to_datetime(edge[:, 0], unit="us"), "status": "ok", "jobs_found": edge[:, 2],
                "chunk_end": end, "had_postings": False, "sure": False, "edge": True,
            }
        )[_SAID.names]

    return judge


def _chunk_end(chunk: str) -> Column:
    return F.window("started_at", chunk)["end"]


def _told(history: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(id, _had) of the asked runs, by the batch operator over their sources' history."""
    told = run_status(history.withColumn("jobs_inserted", F.lit(0).cast("long")), n).select("id", F.col("had_postings").alias("_had"))
    return told.join(asked.select("id"), "id", "left_semi")


def _verdicts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("derived_status", status_of(F.col("jobs_found"), F.col("had_postings"), F.col("status") == "error"))


def run_health_states(
    runs: DataFrame, judged: StoredTable, edges: StoredTable, checkpoint: str, n: int = 7, chunk: str = "1 hour", delay: str = "1 hour"
) -> StreamingQuery:
    """Judge finished runs as they arrive, with keyed state.

    The key is a source and a chunk of time, so a source with very many runs is many keys. A chunk's state knows its runs, and judges each new one that has
    ``n`` runs before it there, or one with postings among fewer. An event-time timer lets the state go when the watermark (``delay`` behind the latest
    start) passes the chunk's end. What a chunk cannot tell alone, of its first ``n`` runs, is told by the batch operator from the edges of the source's
    chunks: the first and the last ``n`` runs of each, which ``edges`` keeps. A run is judged once, by what has come when it comes. Runs behind the
    watermark don't reach the state; :func:`late_runs_stream` judges them.
    """
    done = settled(runs).withWatermark("started_at", delay)
    said = (
        done.select(*TAIL.names, _chunk_end(chunk).alias("chunk_end"))
        .groupBy("source", "chunk_end")
        .applyInPandasWithState(_judge_chunk(n), _SAID, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        token = f"health-states:{batch_id}"
        said = stage(batch, "said")
        own = said.filter(~F.col("edge"))
        renewed = said.filter("edge").select(*TAIL.names, "chunk_end", F.lit(2 * batch_id).cast("long").alias("batch_id"))
        doubtful = own.filter("not sure").select("id", "source")
        asked = doubtful.select("source").distinct()
        stored = edges.read().select(*EDGES.names).unionByName(renewed).join(asked, "source", "left_semi")
        newest = stored.groupBy("source", "chunk_end").agg(F.max("batch_id").alias("batch_id"))
        history = stored.join(newest, ["source", "chunk_end", "batch_id"], "left_semi").select(*TAIL.names)
        verdicts = own.join(_told(history, doubtful, n), "id", "left").withColumn("had_postings", F.coalesce("_had", "had_postings"))
        judged.append(_verdicts(verdicts), token)
        edges.append(renewed, token)

    return (
        said.writeStream.queryName("health-states")
        .outputMode("append")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def late_runs_stream(
    runs: DataFrame, judged: StoredTable, edges: StoredTable, checkpoint: str, n: int = 7, chunk: str = "1 hour"
) -> StreamingQuery:
    """Judge the landed runs that run_health_states has left out, behind it: they are older than its state.

    They are judged with all that is stored of their sources, and renew the edges of the chunks that they fell into, so that runs behind them see them.
    What is judged already is looked for among the stored verdicts of the batch's span of time.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        token = f"late-runs:{batch_id}"
        landed = stage(settled(batch).select(*TAIL.names), "landed")
        first, last = landed.agg(F.min("started_at"), F.max("started_at")).first()
        known = judged.read().filter(F.col("started_at").between(F.lit(first), F.lit(last))).select("id")
        late = stage(landed.join(known, "id", "left_anti"), "late")
        if late.isEmpty():
            return
        every = stage(judged.read().select(*TAIL.names).join(late.select("source").distinct(), "source", "left_semi").unionByName(late), "late-history")
        verdicts = late.join(_told(every, late, n), "id").withColumnRenamed("_had", "had_postings")
        inside = every.withColumn("chunk_end", _chunk_end(chunk))
        inside = inside.join(late.select("source", _chunk_end(chunk).alias("chunk_end")).distinct(), ["source", "chunk_end"], "left_semi")
        ends = [first_rows(inside, ["source", "chunk_end"], [direction("started_at"), direction("id")], n) for direction in (F.asc, F.desc)]
        newest = edges.read().agg(F.max("batch_id")).first()[0] or 0
        renewed = ends[0].unionByName(ends[1]).distinct().withColumn("batch_id", F.lit(newest + 1).cast("long"))
        judged.append(_verdicts(verdicts), token)
        edges.append(stage(renewed.select(*EDGES.names), "renewed"), token)

    return runs.writeStream.queryName("late-runs").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
