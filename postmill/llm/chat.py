"""Chat formatting by token-level assembly.

Every turn is a row and is encoded alone: role and text are separate segments, and the ids of the control tokens, which no text can produce, are put
between them. Lengths of the parts add up to places: within a turn by a running sum over its parts, within a conversation by one over its turns, which
are range-sorted, so that a conversation of very many turns is many tasks and one number is carried from each to the next.

    <|im_start|> role \\n text <|im_end|> \\n

Control strings inside a role or text are escaped: ``<|`` with any number of backslashes between its two characters gets one more. Reading takes it away.
A line end in a role, which would end it, becomes ``<|newline|>``; no escaped text holds that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.encoder import VOCABULARY, encoder
from postmill.llm.shared import columns, tidy
from postmill.llm.textbatch import slices
from postmill.session import stage

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|newline|>"
#: Turns of this role are learned from.
LEARNED = "assistant"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role).replace("\n", NEWLINE)


def _assemble(parts: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in order, and whether each is learned: the mask turns on and off at the running sums of the parts' lengths."""
    sizes = np.array([len(ids) for ids, _ in parts])
    ends = np.cumsum(sizes)
    turn = np.zeros(ends[-1] + 1, np.int8)
    for end, size, (_, learned) in zip(ends, sizes, parts):
        if learned:
            turn[end - size] += 1
            turn[end] -= 1
    return np.concatenate([ids for ids, _ in parts]), np.cumsum(turn[:-1]) > 0


def format_turns(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, turn, role, place, ids, mask) for every row of ``turns(conv_id, turn, role, text)``.

    ``ids`` are the turn's tokens, ``place`` is that of the first of them among the conversation's, ``mask`` says which of them are learned: the text of
    an assistant's turn. Turns go by turn, null first; of equal turn by role and a hash of the text; equal rows follow each other. A null role or text is
    an empty one; null conv_ids are one conversation; extra columns are left out. Each turn is encoded whole and alone. The result is stored.
    """
    rows = columns(turns, "conv_id", "turn", "role", "text").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = rows.withColumn("_text", F.md5("text")).orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "_text", F.monotonically_increasing_id()).drop("_text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        start, end = np.array([codec.size], np.int32), np.array([codec.size + 1], np.int32)
        line = codec.encode(["\n"])[0][0]
        task, now, place, first = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            for part in slices(batch):
                roles, texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                ids, masks, places, firsts = [], [], [], []
                said = zip(part.column(0).to_pylist(), roles, codec.encode([_role(r) for r in roles]), codec.encode([escape(t) for t in texts]))
                for conv, role, (named,), (text,) in said:
                    if now != (conv,):
                        now, place, first = (conv,), 0, now is None
                    own, mask = _assemble([(start, False), (named, False), (line, False), (text, role == LEARNED), (end, False), (line, False)])
                    ids.append(own.astype(np.int32))
                    masks.append(mask)
                    places.append(place)
                    firsts.append(first)
                    place += len(own)
                yield pa.record_batch(
                    [*part.columns[:3], pa.array(places, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array([task] * len(ids), pa.int32()), pa.array(firsts)],
                    ["conv_id", "turn", "role", "place", "ids", "mask", "_task", "_first"],
                )

    made = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, place long, ids array<int>, mask array<boolean>, _task int, _first boolean"
    found = stage(parts.mapInArrow(run, made), "chat")
    found = found.join(F.broadcast(_carried(found)), "_task", "left")
    return found.withColumn("place", F.col("place") + F.when(F.col("_first"), F.coalesce("_carried", F.lit(0))).otherwise(0)).drop("_task", "_first", "_carried")


def _carried(found: DataFrame) -> DataFrame:
    """(_task, _carried): how many tokens a task's first conversation has in the tasks before. One short row a task goes through the driver."""
    ends = found.groupBy("_task").agg(
        F.max(F.when(F.col("_first"), F.struct("conv_id"))).alias("first"), F.max(F.when(F.col("_first"), F.col("place") + F.size("ids"))).alias("n"), F.bool_and("_first").alias("one"),
        F.max(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id", (F.col("place") + F.size("ids")).alias("n"))).alias("last"),
    )
    carried, before, running = [], None, 0
    for row in sorted(ends.collect(), key=lambda r: r["_task"]):
        own = running if before is not None and before[0] == row.first.conv_id else 0
        carried.append((row["_task"], own))
        before, running = (row.last.conv_id,), own + row.n if row.one else row.last.n
    return found.sparkSession.createDataFrame(carried, "_task int, _carried long")


def read_turn(ids: np.ndarray, mask: np.ndarray, vocabulary: str = VOCABULARY) -> tuple[str, str, str, str]:
    """(role, text, learned text, formatted text) of one turn's tokens. Tokens that are no turn raise ValueError."""
    codec = encoder(vocabulary)
    control = np.flatnonzero(ids >= codec.size)
    if len(control) != 2 or control[0] != 0 or ids[0] != codec.size or ids[control[1]] != codec.size + 1 or codec.decode(ids[control[1] + 1 :]) != "\n":
        raise ValueError("no turn")
    inner = codec.decode(ids[1 : control[1]])
    role, _, text = inner.partition("\n")
    return unescape(role.replace(NEWLINE, "\n")), unescape(text), unescape(codec.decode(ids[mask])), f"{START}{inner}{END}\n"


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens) of every conversation of :func:`format_turns`.

    Turns are decoded where they lie. Decoded turns go to their conversation's task in order of their places, and hashes go on from turn to turn, so a
    conversation of any length needs the memory of one batch there; a hash over a conversation is one running computation, and nothing else is left to
    that task. Turns whose places leave a gap raise ValueError.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    @tidy
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                turns, sizes = [], []
                for ids, mask in zip(part.column(2), part.column(3)):
                    own = ids.values.to_numpy(zero_copy_only=False)
                    role, text, learned, whole = read_turn(own, mask.values.to_numpy(zero_copy_only=False).astype(bool), vocabulary)
                    turns.append((f"{role}\n{text}\n", learned, len(whole)))
                    sizes.append(len(own))
                said, learned, chars = zip(*turns)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(said), pa.array(learned), pa.array(chars, pa.int64()), pa.array(sizes, pa.int64())], ["conv_id", "place", "said", "learned", "chars", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close():
            done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

        for batch in batches:
            for conv, place, said, learned, chars, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv,):
                    if state:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if place != state[5]:
                    raise ValueError(f"conversation {conv}: no turn at {state[5]}")
                state[0] += 1
                state[1].update(said.encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += chars
                state[5] += n
            if done:
                yield _rows(done)
                done.clear()
        if state:
            close()
            yield _rows(done)

    def _rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found]) for i in range(7)], ["conv_id", *names])

    decoded = formatted.select("conv_id", "place", "ids", "mask").mapInArrow(decode, f"conv_id {kind}, place long, said string, learned string, chars long, n long")
    ordered = decoded.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


def conversations(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Format all turns, store the formatted turns, and return what can be read back from them; an empty table gives no rows."""
    return read_back(format_turns(turns, vocabulary), vocabulary)
