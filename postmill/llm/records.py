"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard ``<n>.rec`` is a run of frames, about SHARD_BYTES at most:

    length     8 bytes, unsigned
    check      4 bytes, masked CRC-32 of the length's bytes
    payload    ``length`` bytes
    check      4 bytes, masked CRC-32 of the payload

and a payload is one flag byte (1: there is no doc_id; 2: ids have four bytes, else two), the doc_id in 8 bytes, signed, and the ids. All
numbers are little-endian. A CRC is masked (rotated by 15 bits, a constant added) so that data which holds CRCs of its own checks well.
``<n>.idx`` has 16 bytes for each record and once more for the end: its byte offset, and the ids before it in the shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.llm.encoder import VOCABULARY, encoder
from postmill.llm.shared import columns, filesystem, fresh_dir, tidy, whole_file
from postmill.llm.textbatch import slices
from postmill.session import stage

NO_ID, WIDE = 1, 2
#: Records that a reading task takes at a time, and bytes that it reads at a time (or one longer record).
READ, READ_BYTES = 2_000, 1 << 21
#: A shard that has as many bytes is ended.
SHARD_BYTES = 1 << 28


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(head).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the frame at an offset, and the offset behind it. A damaged frame raises ValueError."""
    head = data[at : at + 8]
    size = int.from_bytes(head, "little")
    if len(head) < 8 or int.from_bytes(data[at + 8 : at + 12], "little") != masked(head):
        raise ValueError(f"damaged length at byte {at}")
    payload = data[at + 12 : at + 12 + size]
    if len(payload) < size or int.from_bytes(data[at + 12 + size : at + 16 + size], "little") != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + 16 + size


def pack(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = (NO_ID if doc_id is None else 0) | (WIDE if wide else 0)
    return bytes((flags,)) + (doc_id or 0).to_bytes(8, "little", signed=True) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    ids = np.frombuffer(payload, "<u4" if payload[0] & WIDE else "<u2", offset=9)
    return None if payload[0] & NO_ID else int.from_bytes(payload[1:9], "little", signed=True), ids


def write_records(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text of ``docs(doc_id, text)``, end it with ``end_id``, and write shards below ``path`` in ascending order of doc_id.

    Returns the manifest (shard, file, records, tokens), one row a shard, which is written as a table beside the shards. Texts are dealt out by
    ranges of doc_id before they are encoded, so sampling the ranges encodes nothing; a range is as many shards as its bytes need. A repeated doc_id is
    ordered by its text, and its rows may fall in several shards. A null doc_id comes first; a null text is empty and has the end id alone; an empty
    table writes no shard. Whole texts are encoded; a shard and its index are streamed to their files.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, int]]]:
        codec = encoder(vocabulary)
        wide = max(codec.size, end_id + 1) > 1 << 16
        for batch in batches:
            for part in slices(batch):
                texts = codec.encode(part.column(1).fill_null("").to_pylist())
                yield [
                    (frame(pack(doc_id, np.append(ids, end_id), wide)), len(ids) + 1) for doc_id, (ids,) in zip(part.column(0).to_pylist(), texts)
                ]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = encoded(batches)
        part, shard = next(frames, None), TaskContext.get().partitionId() << 20
        while part is not None:
            file, at, tokens, records = f"{path}/{shard:09d}", 0, 0, 0
            with whole_file(file + ".rec") as out, whole_file(file + ".idx") as idx:
                while part is not None and at < shard_bytes:
                    index = []
                    for data, n in part:
                        out.write(data)
                        index.append((at, tokens))
                        at, tokens = at + len(data), tokens + n
                    idx.write(np.array(index, "<u8").tobytes())
                    records += len(index)
                    part = next(frames, None)
                idx.write(np.array([(at, tokens)], "<u8").tobytes())
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([file]), pa.array([records], pa.int64()), pa.array([tokens], pa.int64())], ["shard", "file", "records", "tokens"])
            shard += 1

    rows = columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "_tie", "_row").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    return stage(dealt.mapInArrow(run, "shard long, file string, records long, tokens long"), "manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every record: start counts the ids of all records before it, ids is binary, four bytes each, little-endian.

    Tasks read blocks of records through the index, so one shard may be read by many tasks, in any order. Every check is verified.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, at = filesystem(row["file"])
                with system.open_input_file(at + ".idx") as idx:
                    index = np.frombuffer(idx.read_at(16 * (row["n"] + 1), 16 * row["first"]), "<u8").reshape(-1, 2).astype(np.int64)
                with system.open_input_file(at + ".rec") as rec:
                    k = 0
                    while k < row["n"]:
                        to = max(k + 1, int(np.searchsorted(index[:, 0], index[k, 0] + READ_BYTES, "right")) - 1)
                        data, here = rec.read_at(int(index[to, 0] - index[k, 0]), int(index[k, 0])), int(index[k, 0])
                        found = [unpack(unframe(data, place - here)[0]) for place in index[k:to, 0].tolist()]
                        starts = pa.array(row["before"] + index[k:to, 1], pa.int64())
                        yield pa.record_batch([pa.array([d for d, _ in found], pa.int64()), starts, pa.array([ids.astype("<u4").tobytes() for _, ids in found], pa.binary())], ["doc_id", "start", "ids"])
                        k = to

    # One short row a shard: their running total is a small window.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    blocks = manifest.withColumn("before", before).select("file", "before", "records", F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(READ).cast("long"))).alias("first"))
    blocks = blocks.select("file", "before", "first", F.least(F.lit(READ), F.col("records") - F.col("first")).cast("long").alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(tasks).mapInArrow(run, "doc_id long, start long, ids binary")


def token_records(docs: DataFrame, path: str | None = None, vocabulary: str = VOCABULARY, end_id: int = 0) -> DataFrame:
    """Write the records of ``docs`` and return what the files hold: doc_id, start, n_tokens (with the end id), ids_crc32."""
    spark = docs.sparkSession
    manifest = write_records(docs, path or fresh_dir(spark, "records"), vocabulary, end_id)
    found = read_records(spark, manifest)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
