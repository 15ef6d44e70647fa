"""Packing documents into sequences of bounded length by bulk-synchronous best-fit.

Documents are range-sorted by length, longest first, which gives each its place; no task sees them all. Documents of one length are interchangeable,
and so are sequences with one free room, so the rounds work on runs: a run of documents is a length and a span of places, a gap is a room and a span of
sequence numbers. One round matches a whole run: a sweep goes from its successor, the smallest room that holds it, up through larger rooms;
documents that want the same gap are told apart by their place, the first taking the first sequences; then the gaps are updated, and the next round takes
the next shorter run. There are at most as many runs, and rooms, as a sequence has tokens, whatever the corpus. That is best-fit decreasing, exactly.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.encoder import VOCABULARY, encoder
from postmill.llm.shared import columns, tidy
from postmill.llm.textbatch import slices
from postmill.operators.ordering import numbered
from postmill.session import stage

#: Longest sequence: there may be so many runs and rooms.
MOST = 1 << 17
PLAN = "length long, since long, until long, sequence long, each long, offset long"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; if it is too long, all but the first have ``size`` tokens."""
    first = n if n <= size else n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def pieces(docs: DataFrame, size: int, vocabulary: str = VOCABULARY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the tokens of every text of ``docs(doc_id, text)``, ended with ``end_id``, and cut if too long.

    ``with_ids`` adds ``ids``, four bytes each, little-endian.
    """
    docs = columns(docs, "doc_id", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                codec, out = encoder(vocabulary), []
                for doc_id, (found,) in zip(part.column(0).to_pylist(), codec.encode(part.column(1).fill_null("").to_pylist())):
                    data = np.append(found, end_id).astype("<u4").tobytes()
                    for k, (at, n) in enumerate(cuts(len(data) // 4, size)):
                        own = data[4 * at : 4 * (at + n)]
                        out.append((doc_id, k, at, n, zlib.crc32(own), own))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array(values, kind) for values, kind, _ in zip(zip(*out), kinds, names)], names)

    own = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.mapInArrow(run, own + (", ids binary" if with_ids else ""))


def sweeps(runs: Iterable[tuple[int, int]], size: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """One round for each run (length, documents) in falling order of length. Yields (length, since, until, sequence, each, offset): the documents at
    the places since to until - 1 go to the sequences from ``sequence`` on, ``each`` to a sequence, the first of them at ``offset``."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, number of sequences), ...
    rooms: list[int] = []  # those in gaps, rising
    opened, place = 0, 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in gaps:
                insort(rooms, room)
            gaps.setdefault(room, []).append((first, n))

    for length, left in runs:
        at, changed = bisect_left(rooms, length), []
        while left:
            if at == len(rooms):  # no gap is left that holds one
                need = -(-left // (size // length))
                put(size, opened, need)
                opened += need
                at = len(rooms) - 1
            room = rooms[at]
            each = room // length
            while left and gaps[room]:
                first, n = gaps[room].pop()
                placed = min(left, n * each)
                full, rest = divmod(placed, each)
                yield length, place, place + placed, first, each, size - room
                changed.append((room - each * length, first, full))
                if rest:
                    changed.append((room - rest * length, first + full, 1))
                used = full + (rest > 0)
                if used < n:
                    gaps[room].append((first + used, n - used))
                place, left = place + placed, left - placed
            if not gaps[room]:
                del gaps[room], rooms[at]
            else:
                at += 1
        for gap in changed:
            put(*gap)


def plan(lengths: DataFrame, size: int) -> DataFrame:
    """The rounds' result (see :func:`sweeps`) for ``lengths(length, n)``, which has at most ``size`` rows: one task runs them."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [(length, n) for batch in batches for length, n in zip(*(c.to_pylist() for c in batch.columns))]
        found = list(sweeps(runs, size))
        if found:
            yield pa.record_batch([pa.array(values, pa.int64()) for values in zip(*found)], ["length", "since", "until", "sequence", "each", "offset"])

    return lengths.select("length", "n").coalesce(1).sortWithinPartitions(F.desc("length")).mapInArrow(run, PLAN)


def pack(parts: DataFrame, size: int) -> DataFrame:
    """``parts(length, ...)``, lengths 1 to ``size``, with ``sequence_id`` and ``offset``: where each goes, without gaps from offset 0 on.

    As few sequences as best-fit decreasing needs. Rows are ordered by length and then by their other columns, so the result doesn't follow how the
    input is split; equal rows may change places. An empty table gives no rows.
    """
    if not 0 < size <= MOST:
        raise ValueError(f"sequences of 1 to {MOST} tokens")
    others = [c for c, kind in parts.dtypes if c != "length" and kind != "binary"]
    placed = numbered(parts.orderBy(F.desc("length"), *others, F.monotonically_increasing_id()), "_place")
    rounds = stage(plan(stage(placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "lengths"), size), "rounds")
    # At most a few rows for each length: the table's size is bounded by the sequence's, not by the corpus.
    rounds = F.broadcast(rounds.withColumnRenamed("length", "_length"))
    place = F.col("_place") - 1
    found = placed.join(rounds, (F.col("length") == F.col("_length")) & (place >= F.col("since")) & (place < F.col("until")))
    k = place - F.col("since")
    sequence, offset = F.col("sequence") + F.floor(k / F.col("each")), F.col("offset") + k % F.col("each") * F.col("length")
    return found.select(*parts.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def packed(docs: DataFrame, size: int = 2048, vocabulary: str = VOCABULARY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs(doc_id, text)``.

    A null or empty text is its end id alone; a repeated row is a document of its own; a null doc_id is a value like any other; extra columns are
    left out; an empty table gives no rows. ``with_ids`` adds the pieces' ids, for :func:`sequences`.
    """
    return pack(stage(pieces(docs, size, vocabulary, end_id, with_ids), "pieces"), size)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from packed rows with ids: the token ids of each sequence. A group has at most one sequence's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda out, part: F.concat(out, part["ids"]))
    whole = rows.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    return whole.select("sequence_id", "n_tokens", joined.alias("ids"))
