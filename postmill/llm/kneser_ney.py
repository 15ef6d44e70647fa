"""Language-model scores by an interpolated modified Kneser-Ney model of word pairs.

Counting is done in Spark. Each counting task turns its counts into sorted arrays, one piece for each bucket, and the pieces of a bucket meet in one task,
which adds them up and stores a sorted array of hashes with their counts as a file in the shared folder. Scoring tasks map those files into memory.

    p(w | v) = max(c(v w) - D(c), 0) / c(v) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v) * p(w)
    p(w)     = max(N(w) - E(N), 0) / N + (E1 m1 + E2 m2 + E3 m3) / N / (V + 1)

n1, n2, n3 count the words that follow v once, twice, more often; N(w) counts the words that precede w, N is their sum, and m1, m2, m3 count the words
with N(w) of 1, 2, more. The discounts D, E come from the counts of counts. V + 1 stands for the vocabulary and one unknown word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import columns, fresh_dir, map_array, put_array
from postmill.llm.textbatch import Words, mix, slices, sums, unmix
from postmill.session import stage

#: Hash of the token that ends a text. No word has it but by a collision of 64 bits.
END = np.uint64(0x5851F42D4C957F2D)
#: Counts that a task holds before it hands them on, and tokens for one bucket.
HELD, BUCKET_TOKENS = 2_000_000, 1_500_000
#: Words of a bucket of the context table.
BUCKET_WORDS = 1 << 18
#: A context with more occurrences than this is spread over several buckets.
HOT = 1_000_000


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts (words in lower case, then the end), and the bounds of each text among them."""
    words = Words(column, lower=True)
    n = len(words.counts)
    bounds = words.bounds + np.arange(n + 1)
    out = np.empty(len(words.starts) + n, np.uint64)
    ends = bounds[1:] - 1
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = words.hashes(), END
    return out, bounds


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers and their counts, as differences by byte plane, compressed. Counts are of 8 bytes if one needs them, else of 1."""
    wide = len(counts) > 0 and int(counts.max()) > 255
    planes = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    raw = planes + counts.astype("<u8" if wide else "<u1").tobytes()
    return len(keys).to_bytes(4, "little") + bytes((wide,)) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, size = int.from_bytes(data[:4], "little"), data[4], int.from_bytes(data[5:13], "little")
    raw = pa.decompress(data[13:], size, codec="zstd", asbytes=True)
    keys = np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
    return keys, np.frombuffer(raw, "<u8" if wide else "<u1", n, 8 * n).astype(np.int64)


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


def _pieces(kind: int, keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A packed piece for each bucket; keys are sorted within each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    keys, counts = keys[order], counts[order]
    data = [_pack(keys[a:b], counts[a:b]) for a, b in zip(starts, [*starts[1:], len(bucket)])]
    return pa.record_batch([pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), kind, np.int8)), pa.array(data, pa.binary())], ["bucket", "kind", "data"])


_PIECES = "bucket int, kind tinyint, data binary"


def _counted(texts: DataFrame, tokens: Callable[[pa.Array], np.ndarray], bucket: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pieces with the counts of the 64-bit keys that ``tokens`` makes of a slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            return _pieces(0, keys, counts, bucket(keys))

        for batch in batches:
            for part in slices(batch):
                held.append(tokens(part.column(0)))
                many += len(held[-1])
                if many > HELD:
                    yield out()
                    held, many = [], 0
        if many:
            yield out()

    return texts.mapInArrow(run, _PIECES)


def _merged(table: pa.Table, kind: int = 0) -> tuple[np.ndarray, np.ndarray]:
    found = [_unpack(d.as_py()) for d, k in zip(table.column("data"), table.column("kind").to_pylist()) if k == kind]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _add_up(*(np.concatenate(x) for x in zip(*found)))


@dataclass(frozen=True)
class Vocabulary:
    """Sorted word hashes in ``path``, cut into buckets of equal ranges of the hash; a word's id is its place among all."""

    path: str
    before: np.ndarray  # ids before each bucket
    tokens: int

    @property
    def size(self) -> int:
        return int(self.before[-1])

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        unique, back = np.unique(hashes, return_inverse=True)
        own, n = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        for b, a, z in _ranges(_by_range(unique, len(self.before) - 1)):
            if self.before[b + 1] > self.before[b]:
                place, hit = _find(_mapped(f"{self.path}/words-{b}"), unique[a:z])
                own[a:z][hit] = self.before[b] + place[hit]
                n[a:z][hit] = _mapped(f"{self.path}/counts-{b}")[place[hit]]
        ids[:], counts[:] = own[back], n[back]
        return ids, counts


@lru_cache(maxsize=4096)
def _mapped(path: str) -> np.ndarray:
    return map_array(path)


def _by_range(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ranges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, last) of each run of a sorted array."""
    if len(bucket):
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        yield from zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)])


def _find(stored: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.searchsorted(stored, wanted)
    inside = place < len(stored)
    hit = np.zeros(len(wanted), bool)
    hit[inside] = stored[place[inside]] == wanted[inside]
    return place, hit


def _buckets(spark, most: int) -> int:
    return max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), most)


def vocabulary(texts: DataFrame, path: str) -> Vocabulary:
    """Count all tokens of ``texts(text)`` and store the vocabulary."""
    buckets = _buckets(texts.sparkSession, 1)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        words, counts = _merged(table)
        put_array(f"{path}/words-{key[0].as_py()}", words)
        put_array(f"{path}/counts-{key[0].as_py()}", counts)
        return pa.table({"bucket": [key[0].as_py()], "words": [len(words)], "tokens": [int(counts.sum())]}, schema=pa.schema([("bucket", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64())]))

    counted = _counted(texts, lambda column: token_hashes(column)[0], lambda keys: _by_range(keys, buckets))
    found = counted.groupBy("bucket").applyInArrow(run, "bucket int, words long, tokens long").collect()  # one short row a bucket
    sizes = np.zeros(buckets, np.int64)
    for row in found:
        sizes[row["bucket"]] = row["words"]
    return Vocabulary(path, np.concatenate(([0], np.cumsum(sizes))), sum(row["tokens"] for row in found))


@dataclass(frozen=True)
class Model:
    """The stored model: pairs by bucket, contexts by range of word ids, and the discounts."""

    words: Vocabulary
    path: str
    buckets: int
    texts: int
    discounts: tuple[float, float, float]
    lower: tuple[float, float, float]
    preceding: int  # N
    lower_weight: float  # (E1 m1 + E2 m2 + E3 m3) / N

    def logs(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of every token of texts, and its count in training."""
        ids, counts = self.words.ids(hashes)
        first = np.zeros(len(ids), bool)
        first[bounds[:-1]] = True
        before = np.where(first, self.words.size, np.concatenate(([-1], ids[:-1])))
        seen = np.where(first, self.texts, np.concatenate(([0], counts[:-1])))
        low = self._lower(ids)
        known = seen > 0
        weight = np.ones(len(ids))
        follow = self._contexts(before[known])[:, 1:].astype(float)
        weight[known] = follow @ np.array(self.discounts) / seen[known]
        n = self._pairs(before, ids, seen)
        own = np.where(n > 0, n - np.array((0.0, *self.discounts))[np.minimum(n, 3)], 0.0)
        return np.log10(np.divide(np.maximum(own, 0), seen, out=np.zeros(len(ids)), where=known) + weight * low), counts

    def _lower(self, ids: np.ndarray) -> np.ndarray:
        n = np.zeros(len(ids), np.int64)
        n[ids >= 0] = self._contexts(ids[ids >= 0])[:, 0]
        own = np.where(n > 0, n - np.array((0.0, *self.lower))[np.minimum(n, 3)], 0.0)
        return np.maximum(own, 0) / max(1, self.preceding) + (self.lower_weight if self.preceding else 1.0) / (self.words.size + 1)

    def _contexts(self, ids: np.ndarray) -> np.ndarray:
        """Preceding words, and following words seen once, twice, more often, of each word id."""
        unique, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(unique), 4), np.int64)
        for b, a, z in _ranges(unique // BUCKET_WORDS):
            out[a:z] = _mapped(f"{self.path}/contexts-{b}")[unique[a:z] % BUCKET_WORDS]
        return out[back]

    def _pairs(self, before: np.ndarray, ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        real = np.flatnonzero((before >= 0) & (ids >= 0))
        keys = mix(before[real].astype(np.uint64) << np.uint64(32) | ids[real].astype(np.uint64))
        bucket = _pair_bucket(keys, before[real], seen[real], self.buckets)
        order = np.lexsort((keys, bucket))
        keys, found = keys[order], np.zeros(len(real), np.int64)
        for b, a, z in _ranges(bucket[order]):
            place, hit = _find(_mapped(f"{self.path}/pairs-{b}"), keys[a:z])
            found[a:z][hit] = _mapped(f"{self.path}/pair-counts-{b}")[place[hit]]
        out[real[order]] = found
        return out


def _pair_bucket(keys: np.ndarray, before: np.ndarray, seen: np.ndarray, buckets: int) -> np.ndarray:
    """By the context, so that a context's followers are counted in one place; a frequent context is cut into parts by its pairs' hashes."""
    part = (keys >> np.uint64(20)) % (1 + seen // HOT).astype(np.uint64)
    return _by_range(mix(mix(before.astype(np.uint64) + np.uint64(1)) + part), buckets)


def _discounts(counts_of_counts: np.ndarray) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more, from how many have counts 1 to 4. Where a count is missing the formula has no value; then 0.5, 1, 1.5,
    which lie below the counts they are taken from."""
    n1, n2, n3, n4 = (float(x) for x in counts_of_counts[:4])
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < i + 1 else (i + 1) / 2 for i, d in enumerate(found))


def train(texts: DataFrame, path: str | None = None) -> Model:
    """Count ``texts(text)`` and store the model below ``path``. A null text is an empty one: its only token is the end."""
    spark = texts.sparkSession
    path = path or fresh_dir(spark, "language-model")
    words = vocabulary(texts, path)
    n_texts = texts.count()
    buckets, word_buckets = _buckets(spark, words.tokens // BUCKET_TOKENS + 1), words.size // BUCKET_WORDS + 1

    def pairs(column: pa.Array) -> np.ndarray:
        hashes, bounds = token_hashes(column)
        ids = words.ids(hashes)[0].astype(np.uint64)
        before = np.concatenate(([np.uint64(0)], ids[:-1]))
        before[bounds[:-1]] = words.size
        return mix(before << np.uint64(32) | ids)

    def place(keys: np.ndarray) -> np.ndarray:
        before = (unmix(keys) >> np.uint64(32)).astype(np.int64)
        return _pair_bucket(keys, before, _seen(words, before, n_texts), buckets)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        """Store a bucket's pairs; hand on, by range of word ids, how many words precede and follow each word, and the counts of counts."""
        own = key[0].as_py()
        keys, counts = _merged(table)
        put_array(f"{path}/pairs-{own}", keys)
        put_array(f"{path}/pair-counts-{own}", counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint32))
        pair = unmix(keys)
        out = []
        for kind, values, which in ((0, pair & np.uint64(0xFFFFFFFF), counts > 0), *((k, pair >> np.uint64(32), counts == k if k < 3 else counts > 2) for k in (1, 2, 3))):
            ids, n = np.unique(values[which], return_counts=True)
            out.append(_pieces(kind, ids, n, (ids // np.uint64(BUCKET_WORDS)).astype(np.int64)))
        levels = np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.uint64)
        out.append(pa.record_batch([pa.array([-1], pa.int32()), pa.array([4], pa.int8()), pa.array([levels.tobytes()], pa.binary())], ["bucket", "kind", "data"]))
        return pa.Table.from_batches(out)

    spread = stage(_counted(texts, pairs, place).groupBy("bucket").applyInArrow(merge, _PIECES), "pairs")
    levels = sum((np.frombuffer(r["data"], np.uint64) for r in spread.filter("kind = 4").select("data").collect()), np.zeros(4, np.uint64))

    def contexts(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py()
        found = np.zeros((BUCKET_WORDS, 4), np.uint32)
        for kind in range(4):
            ids, n = _merged(table, kind)
            found[(ids % np.uint64(BUCKET_WORDS)).astype(np.int64), kind] = n
        put_array(f"{path}/contexts-{own}", found)
        n = found[:, 0].astype(np.int64)
        many = np.bincount(np.minimum(n, 5), minlength=6)[1:]
        names = [f"n{i}" for i in range(1, 6)]
        return pa.table([pa.array([own], pa.int32()), pa.array([int(n.sum())], pa.int64()), *[pa.array([int(x)], pa.int64()) for x in many]], names=["bucket", "total", *names])

    rows = spread.filter("kind < 4").groupBy("bucket").applyInArrow(contexts, "bucket int, total long, n1 long, n2 long, n3 long, n4 long, n5 long").collect()
    assert len(rows) <= word_buckets + 1
    many = np.array([sum(r[f"n{i}"] for r in rows) for i in range(1, 6)], float) if rows else np.zeros(5)
    total, lower = sum(r["total"] for r in rows), _discounts(many)
    weight = float(np.dot(lower, (many[0], many[1], many[2:].sum()))) / total if total else 1.0
    return Model(words, path, buckets, n_texts, _discounts(levels), lower, total, weight)


def _seen(words: Vocabulary, ids: np.ndarray, texts: int) -> np.ndarray:
    """Occurrences of contexts by id; the id after the last word is the beginning of a text."""
    unique, back = np.unique(ids, return_inverse=True)
    out = np.full(len(unique), texts, np.int64)
    bucket = np.searchsorted(words.before, unique, "right") - 1
    inside = unique < words.size
    for b, a, z in _ranges(bucket[inside]):
        out[:inside.sum()][a:z] = _mapped(f"{words.path}/counts-{b}")[unique[inside][a:z] - words.before[b]]
    return out[back]


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document is kept back from training; one without doc_id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def scores(docs: DataFrame, folds: int = 7, fold: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of ``docs(doc_id, text)``.

    The model learns from the documents whose crc32 of the id as text leaves another remainder than ``fold``. Tokens are the words
    ``[^\\x20\\x09-\\x0D]+`` of the whole text, lower-cased in A-Z, and one end. ``base_score`` is the add-one unigram score, ``score`` the model's,
    both log10 probabilities of the text. Null and empty texts have the end alone. Rows that repeat a document count as often as they occur. If nothing is
    left to learn from, every token has the one probability that is left, 1. Extra columns are left out; an empty table gives no rows.
    """
    rows = columns(docs, "doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    model = train(rows.filter("not held_out").select("text"))
    n, v = model.words.tokens, model.words.size
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = token_hashes(part.column(1))
                logs, counts = model.logs(hashes, bounds)
                base = sums(np.log10((counts + 1) / (n + v + 1)), bounds)
                score, size = sums(logs, bounds), np.diff(bounds)
                out = {"n_tokens": size, "n_known": sums(counts > 0, bounds), "train_tokens": np.full(len(size), n), "base_score": base, "score": score, "perplexity": 10 ** (-score / size)}
                yield pa.record_batch([part.column(0), part.column(2), *map(pa.array, out.values())], ["doc_id", "held_out", *out])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
