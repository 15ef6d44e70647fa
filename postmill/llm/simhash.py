"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints at distance d <= 2h have a value within h bits of both, so each emits every value within h bits of itself, and pairs meet there.
For an odd bound 2h + 1 the 64 bits are cut into four parts and the balls are made once for each part, with that part set to zero: a pair that
differs in exactly one bit of some part is within 2h bits outside it, and pairs at 2h or less have a part without a difference. What is left (for
a bound of 3: three bits in one part and none elsewhere) meets where that part alone is zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.llm.components import components
from postmill.llm.shared import columns, tidy
from postmill.llm.textbatch import LOWER_BYTES
from postmill.operators.skew import lookup_join
from postmill.session import stage

BITS, PARTS, WIDTH = 64, 4, 16
#: Shingles whose bits are counted at a time, so that a long text needs no more memory than a short one.
BLOCK = 1 << 16
#: Up to so many fingerprints at one meeting point are compared with each other directly; more are linked by table look-up.
DIRECT = 256


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[: len(words) - size])).tolist()
    last = (ends[size - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. A null text is an empty one."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([text_fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    docs = columns(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def balls(distance: int) -> list[tuple[int, int, int]]:
    """(part, bits kept, bits flipped) of every value that a fingerprint emits."""
    half, every = distance // 2, (1 << BITS) - 1
    parts = [(0, every)] if distance % 2 == 0 else [(p, every ^ (((1 << WIDTH) - 1) << (p * WIDTH))) for p in range(PARTS)]
    out = []
    for part, keep in parts:
        places = [1 << i for i in range(BITS) if keep >> i & 1]
        out += [(part, _signed(keep), _signed(sum(flips))) for n in range(half + 1) for flips in combinations(places, n)]
    return out


def _propagate(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n, over links a-b."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(fps: np.ndarray, key: np.uint64, part: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints that met at one value, as a star for each component. Exact for every number of fingerprints; there are
    at most 2^16 times the ball's size, whatever the corpus."""
    fps = np.unique(fps)
    n = len(fps)
    if n <= DIRECT:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
        a, b = np.nonzero(np.triu(near, 1))
    elif distance % 2 == 0:  # all are within half the distance of the value
        a, b = np.zeros(n - 1, np.int64), np.arange(1, n)
    else:
        shift = np.uint64(part * WIDTH)
        value = ((fps >> shift) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
        # Outside the part all are within distance - 1 bits of each other: one bit more or none inside it is a link.
        holder = np.full(1 << WIDTH, -1, np.int64)
        holder[value[::-1]] = np.arange(n)[::-1]
        a, b = [np.arange(n)], [holder[value]]
        for bit in range(WIDTH):
            other = holder[value ^ (1 << bit)]
            a.append(np.flatnonzero(other >= 0))
            b.append(other[other >= 0])
        # Those equal outside the part may differ by up to the whole distance inside it.
        own = np.flatnonzero(fps & ~np.uint64(((1 << WIDTH) - 1) << (part * WIDTH)) == key)
        if distance >= 3 and len(own):
            there = np.full(1 << WIDTH, -1, np.int64)
            there[value[own]] = own
            for bits in combinations(range(WIDTH), 3):
                other = there[value[own] ^ sum(1 << i for i in bits)]
                a.append(own[other >= 0])
                b.append(other[other >= 0])
        a, b = np.concatenate(a), np.concatenate(b)
    label = _propagate(n, a, b)
    rest = np.flatnonzero(label != np.arange(n))
    return fps[label[rest]], fps[rest]


def _links(key: np.ndarray, part: np.ndarray, fps: np.ndarray, distance: int) -> np.ndarray:
    """Pairs (rows of 2) that connect, within each run of equal (key, part), what belongs together."""
    edge = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
    starts = np.concatenate(([0], edge))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    found = []
    two = starts[sizes == 2]
    if len(two):
        x, y = fps[two], fps[two + 1]
        ok = (x != y) & (np.bitwise_count(x ^ y) <= distance)
        found.append(np.stack((np.minimum(x, y)[ok], np.maximum(x, y)[ok]), axis=1))
    for at in np.flatnonzero(sizes > 2):
        s = starts[at]
        x, y = _forest(fps[s : s + sizes[at]], key[s], int(part[s]), distance)
        found.append(np.stack((x, y), axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps(fp)`` that connect every pair within ``distance`` bits (at most 4).

    The links span the components: n copies at one value give n - 1 links, not all pairs. A value's fingerprints are read as one sorted run of
    8-byte numbers; how many can meet there is bounded by the ball, not by the corpus.
    """
    if not 0 <= distance <= 4:
        raise ValueError("distance: 0 to 4 bits")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64))

        def out(key, part, fp):
            pairs = _links(key, part, fp, distance).view(np.int64)
            return pa.record_batch([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key, part, fp = (np.concatenate(x) for x in zip(rest, (new[0].view(np.uint64), new[1], new[2].view(np.uint64))))
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield out(key[:cut], part[:cut], fp[:cut])
            rest = key[cut:], part[cut:], fp[cut:]
        if len(rest[0]):
            yield out(*rest)

    if distance == 0:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    offers = F.explode(F.array(*[F.struct(F.lit(p).cast("tinyint").alias("part"), F.lit(k).alias("keep"), F.lit(x).alias("flip")) for p, k, x in balls(distance)]))
    met = fps.select("fp", offers.alias("o")).select(F.col("fp").bitwiseAND(F.col("o.keep")).bitwiseXOR(F.col("o.flip")).alias("key"), "o.part", "fp")
    return met.repartition("key").sortWithinPartitions("key", "part").mapInArrow(run, "a long, b long").distinct()


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    Words are lower-cased in A-Z; a shingle is ``shingle`` words joined by spaces, or all of a shorter text. Documents within ``distance`` bits
    are linked, and component_id is the least doc_id that links lead to. Documents without words have fingerprint zero and are linked like any
    other. Equal fingerprints are one node from the start, so copies cost nothing. Repeated rows come back repeated; a null doc_id is kept and is
    never a component_id unless its component has no other; extra columns are left out; an empty table gives no rows.
    """
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = stage(components(links(nodes.select("fp"), distance)), "roots")
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "least")
    linked = linked.join(linked.groupBy("root").agg(F.min("least").alias("reached")), "root").select("fp", "reached")
    owner = stage(nodes.join(linked, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id")), "owners")
    # Very many documents may have one fingerprint, such as those without words: a counted small table is broadcast, else hot fingerprints are salted.
    return lookup_join(prints, owner, ["fp"], "doc_id", "inner").select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each near-duplicate component, with all columns: that of the least doc_id.

    A doc_id names one document. Of rows that repeat it, the one with the least hash of its text stays; the document goes if all its rows are near a
    smaller doc_id. Rows without doc_id all stay. Texts are not shuffled if the table of ids that go is small enough for Spark to broadcast.
    """
    rows = stage(near_duplicates(docs, shingle, distance).filter("doc_id is not null").groupBy("doc_id").agg(F.max("component_id").alias("least"), F.count(F.lit(1)).alias("rows")), "owners")
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    gone = stage(rows.filter("least < doc_id").select("doc_id"), "gone")
    kept = plain.join(gone, plain[at] == gone["doc_id"], "left_anti")
    again = stage(rows.filter("rows > 1").select("doc_id"), "repeated")
    if not again.isEmpty():
        # Minima are taken before the shuffle, so a document that is repeated very often is no burden to one task.
        least = F.min_by(F.struct(*kept.columns), F.xxhash64(F.coalesce(text, F.lit("")))).alias("row")
        one = kept.join(again, kept[at] == again["doc_id"], "left_semi").groupBy(at).agg(least).select("row.*")
        kept = kept.join(again, kept[at] == again["doc_id"], "left_anti").unionAll(one)
    return kept.toDF(*names)
