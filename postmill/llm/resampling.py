"""Importance resampling towards a target distribution over hashed n-grams.

A document is its words with one separator before each. It is scanned once, and the CRC-32 of what stands before and after each word is kept. The CRC
of any run of words follows from those two: the CRC of the longer prefix, xor that of the shorter one moved on by as many zero bytes as the run is
long, which is a linear map over GF(2). So runs of every size cost a few table look-ups each, and no n-gram is ever built as a string.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import columns, tidy
from postmill.llm.textbatch import slices
from postmill.operators.ordering import numbered
from postmill.session import stage

#: For bytes.translate: A-Z in lower case; what is neither letter, digit nor beyond ASCII becomes a space.
_NORMAL = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Most buckets: their gains are sent to every task.
MOST_BUCKETS = 1 << 20


def _one_byte() -> np.ndarray:
    """CRC-32's map of a zero byte, by the value's four bytes."""
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    # A value's low byte goes through the table, the others move down by one.
    return np.stack([values, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(3))])


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return tables[0][crc & low] ^ tables[1][(crc >> 8) & low] ^ tables[2][(crc >> 16) & low] ^ tables[3][crc >> 24]


#: The maps of 1, 2, 4, 8, ... zero bytes.
_moves = [_one_byte()]


def moved(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each CRC moved on by ``size`` zero bytes."""
    bit = 0
    while len(size) and (most := int(size.max()) >> bit):
        if bit == len(_moves):
            _moves.append(_apply(_moves[-1], _moves[-1]))
        if most:
            on = np.flatnonzero(size >> bit & 1)
            crc = crc.copy() if bit == 0 else crc
            crc[on] = _apply(_moves[bit], crc[on])
        bit += 1
    return crc


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Prefixes:
    """Running CRCs of the separator-normalised document ``" " + " ".join(words)``: before and after each word, and where the word starts and ends."""

    def __init__(self, words: list[bytes]):
        self.after = np.fromiter(accumulate(words, lambda crc, word: crc32(word, crc32(b" ", crc)), initial=0), np.uint32, len(words) + 1)[1:]
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        ahead = np.concatenate((np.zeros(min(1, len(words)), np.uint32), self.after[:-1]))
        # One space more: a CRC is kept inverted.
        self.before = ~_apply(_moves[0], ~ahead ^ np.uint32(0x20))
        self.starts = np.concatenate((np.zeros(min(1, len(words)), np.int64), self.ends[:-1])) + 1

    def runs(self, size: int) -> np.ndarray:
        """CRC-32 of each run of ``size`` words joined by one space."""
        n = max(0, len(self.after) - size + 1)
        return self.after[size - 1 :] ^ moved(self.before[:n], self.ends[size - 1 :] - self.starts[:n]) if n else np.zeros(0, np.uint32)


def features(texts: list[str | None], size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a few texts: the buckets of all their features, text by text; each text's number of features; and of words."""
    lists = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    # One scan over all texts: runs that would cross from one into the next are left out.
    found = Prefixes([w for own in lists for w in own])
    owner = np.repeat(np.arange(len(lists)), counts)
    parts, owners = [], []
    for n in range(1, size + 1):
        own = owner[: max(0, len(owner) - n + 1)]
        whole = own == owner[n - 1 :][: len(own)]
        parts.append((found.runs(n)[whole] % np.uint32(buckets)).astype(np.uint32))
        owners.append(own[whole])
    values, of = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(of, kind="stable") if size > 1 else slice(None)
    return values[order], np.bincount(of, minlength=len(lists)), counts


def hashed(df: DataFrame, keys: tuple[str, ...], size: int, buckets: int) -> DataFrame:
    """``keys`` of every row, n_words, n_features, and ``buckets``: those of all features, as little-endian numbers of two or four bytes."""
    rows = columns(df, *keys, "text")
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found, n_features, n_words = features(part.column(len(keys)).to_pylist(), size, buckets)
                data = pa.py_buffer(found.astype(kind).tobytes())
                ends = np.concatenate(([0], np.cumsum(n_features))) * np.dtype(kind).itemsize
                lists = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), data]).cast(pa.binary())
                yield pa.record_batch([*part.columns[: len(keys)], pa.array(n_words), pa.array(n_features), lists], [*keys, "n_words", "n_features", "buckets"])

    own = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return rows.mapInArrow(run, own + "n_words long, n_features long, buckets binary")


def _numbers(column: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2" if buckets <= 1 << 16 else "<u4")


def totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in ``rows(buckets)``. A task sends a row for each bucket at most, and the driver gets ``buckets`` rows at most."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                count += np.bincount(_numbers(batch.column(0).slice(at, 256), buckets), minlength=buckets)
        there = np.flatnonzero(count)
        yield pa.record_batch([pa.array(there), pa.array(count[there])], ["bucket", "n"])

    found = rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: the thousandfold logarithm of its smoothed share in the target over that in the source, floored."""
    n, source_all, target_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (source_all + n) / ((s + 1.0) * (target_all + n)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of ``rows(doc_id, n_words, n_features, buckets)``: the floored mean of a document's gains, none: 0."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(batch.num_rows, np.int64)
            sizes = batch.column(2).to_numpy()
            for at in range(0, batch.num_rows, 256):
                n = sizes[at : at + 256]
                total = np.concatenate(([0], np.cumsum(gain[_numbers(batch.column(3).slice(at, 256), len(gain))])))
                ends = np.cumsum(n)
                weight[at : at + 256] = np.where(n > 0, (total[ends] - total[ends - n]) // np.maximum(n, 1), 0)
            yield pa.record_batch([*batch.columns[:3], pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = rows.select("doc_id", "n_words", "n_features", "buckets")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, size: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs(doc_id, text)``: rank 1, 2, 3, ... for the documents drawn, else null.

    Features are all runs of 1 to ``size`` words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a whole text, A-Z lower-cased. ``score`` is the weight with
    Gumbel noise that depends on the seed and doc_id alone, so the highest scores are a sample without replacement. Of the documents with at least
    ``least_words`` words, ``percent`` percent are drawn; equal scores go to the smaller doc_id, a null one first. Rows that repeat a doc_id are ranked
    each by itself, equal rows in any order. A null or empty text has no features, weight 0, and is never drawn; an empty target makes every gain
    follow from the source alone; extra columns are left out; an empty table gives no rows.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")
    rows = stage(hashed(docs, ("doc_id",), size, buckets), "features")
    gain = gains(totals(rows, buckets), totals(hashed(target, (), size, buckets), buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = stage(weigh(rows, gain).withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    # A global order of narrow rows, in ranges of it; the row's number spreads rows that are equal in all.
    ranked = numbered(scored.filter(enough).orderBy(F.desc("score"), "doc_id", "n_features", "weight", F.monotonically_increasing_id()), "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
