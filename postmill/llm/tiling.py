"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds (runs of ``seed`` words). For every pair that shares one, the longest common runs are marked
again and again as tiles that don't overlap, so passages count in whatever order they stand; a document is contaminated if tiles cover enough of an item.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import columns, tidy
from postmill.llm.textbatch import Words, slices, windows
from postmill.session import stage

#: Bits of the seed filter that goes to every worker: 16 MB, however large the benchmark is.
FILTER_BITS = 1 << 27
#: Pairs of equal windows that are looked at together.
PAIRS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MASK = (1 << 64) - 1


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """The Karp-Rabin hash of every run of ``size`` words, rolled along: sums of weighted words, of which each run takes a difference."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    weights = np.full(len(words) + 1, _BASE, np.uint64)
    weights[0] = 1
    weights, back = np.multiply.accumulate(weights), np.full(len(words), _INVERSE, np.uint64)
    back[0] = 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.multiply.accumulate(back), dtype=np.uint64)))
    return (sums[size:] - sums[:n]) * weights[size : size + n]


def _matches(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in item, place in text, length) of all common runs of ``least`` words or more that neither end can be made longer.

    Pairs of equal windows are looked for a block of the text at a time; those that follow each other on a diagonal are one run.
    """
    own, other = _rolled(item, least), _rolled(text, least)
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    low, high = np.searchsorted(ordered, other, "left"), np.searchsorted(ordered, other, "right")
    count = high - low
    upto, found, at = np.cumsum(count), [], 0
    while at < len(count):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        n = count[at:to]
        place = order[np.repeat(low[at:to] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        there = np.repeat(np.arange(at, to), n)
        key = np.lexsort((there, there - place))
        diagonal, there = (there - place)[key], there[key]
        starts = np.flatnonzero(np.concatenate(([True], (diagonal[1:] != diagonal[:-1]) | (there[1:] != there[:-1] + 1)))[: len(there)])
        ends = np.concatenate((starts[1:], [len(there)]))[: len(starts)] - 1
        found.append(np.stack((diagonal[starts], there[starts], there[ends]), axis=1))
        at = to
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    # A run goes on from block to block.
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 2] + 1)
    begins = np.flatnonzero(first)
    ends = np.concatenate((begins[1:], [len(runs)]))[: len(begins)] - 1
    return [(start - diagonal, start, end - start + least) for diagonal, start, end in zip(runs[begins, 0].tolist(), runs[begins, 1].tolist(), runs[ends, 2].tolist())]


def _stretches(free: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of a mask, as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


def tiles(item: list[int], text: list[int | None], least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in text, length) of common runs of at least ``least`` words, the longest unmarked one first, of equals that which
    stands first in the item, then in the text; none overlaps another. A null word of the text equals nothing.

    Longest runs are kept in a heap. One that tiles have taken a part of goes back with what is left of it, so the work follows the number of diagonals
    with a match, not that of equal words.
    """
    gap = np.fromiter((w is None for w in text), bool, len(text))
    a, b = np.array(item, np.uint64), np.array([w or 0 for w in text], np.uint64)
    heap = []
    for start, end in _stretches(~gap):
        heap += [(-n, i, j + start) for i, j, n in _matches(a, b[start:end], least)]
    heapify(heap)
    a_free, b_free, found = np.ones(len(a), bool), np.ones(len(b), bool), []
    while heap:
        n, i, j = heappop(heap)
        n = -n
        # Also equal words, as hashes of other words may be the same.
        free = a_free[i : i + n] & b_free[j : j + n] & (a[i : i + n] == b[j : j + n])
        if free.all():
            a_free[i : i + n] = b_free[j : j + n] = False
            found.append((i, j, n))
        else:
            for start, end in _stretches(free):
                if end - start >= least:
                    heappush(heap, (start - end, i + start, j + start))
    return found


def _runs(column: pa.Array, seed: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Word hashes, and the seeds of the texts whose bit is set: hash, row and place."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    runs, at = windows(hashes, words.text, seed)
    low = (runs >> np.uint64(37)).astype(np.int64)
    hit = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
    return hashes, runs[hit], words.text[at[hit]], at[hit], words


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(values))


def benchmark_items(benchmark: DataFrame, seed: int) -> DataFrame:
    """(item_id, words, seeds) of every item; words and seeds are hashes. An item shorter than a seed has none."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column(1), lower=True)
                hashes = words.hashes()
                runs, at = windows(hashes, words.text, seed)
                yield pa.record_batch(
                    [part.column(0), _lists(hashes.view(np.int64), words.counts), _lists(runs.view(np.int64), np.bincount(words.text[at], minlength=part.num_rows))],
                    ["item_id", "words", "seeds"],
                )

    rows = columns(benchmark, "item_id", "text")
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, words array<long>, seeds array<long>")


def seed_filter(items: DataFrame) -> np.ndarray:
    """A bit for each seed's upper bits. The driver gets at most FILTER_BITS / 64 numbers, whatever the number of items."""
    words = items.select(F.explode("seeds").alias("seed")).select(F.shiftrightunsigned("seed", 37).alias("bit"))
    own = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    found = words.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(own).alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found["at"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint8)


def matching_parts(rows: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """(row, doc_id, words, seeds) of those of ``rows(row, doc_id, text)`` that may share a seed with an item: the words of all their runs of such seeds,
    one null word between runs, and the seeds. A tile is made of seeds, so it lies within a run."""
    bits = rows.sparkSession.sparkContext.broadcast(seed_filter(items))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, runs, row, at, words = _runs(part.column(2), seed, bits.value)
                if not len(runs):
                    continue
                ids, all_words, all_seeds = [], [], []
                own_rows, first = np.unique(row, return_index=True)
                for r, a, b in zip(own_rows.tolist(), first.tolist(), [*first[1:].tolist(), len(row)]):
                    places, own = at[a:b], []
                    for stretch in np.split(places, np.flatnonzero(np.diff(places) >= seed) + 1):
                        own += [*hashes[stretch[0] : stretch[-1] + seed].view(np.int64).tolist(), None]
                    ids.append(r)
                    all_words.append(own[:-1])
                    all_seeds.append(np.unique(runs[a:b]).view(np.int64))
                at_ids = pa.array(ids)
                yield pa.record_batch(
                    [part.column(0).take(at_ids), part.column(1).take(at_ids), pa.array(all_words, pa.list_(pa.int64())), pa.array(all_seeds, pa.list_(pa.int64()))],
                    ["row", "doc_id", "words", "seeds"],
                )

    rows = columns(rows, "row", "doc_id", "text")
    return rows.mapInArrow(run, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, words array<long>, seeds array<long>")


def coverage(pairs: DataFrame, least: int) -> DataFrame:
    """(row, doc_id, item_id, n_tiles, covered, item_words) for ``pairs(row, doc_id, item_id, words, item)``, pair by pair."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tiles, covered, size = [], [], []
            for words, item in zip(batch.column("words").to_pylist(), batch.column("item").to_pylist()):
                # Hashes without sign.
                found = tiles([w & _MASK for w in item], [None if w is None else w & _MASK for w in words], least)
                n_tiles.append(len(found))
                covered.append(sum(n for _, _, n in found))
                size.append(len(item))
            yield pa.record_batch(
                [batch.column("row"), batch.column("doc_id"), batch.column("item_id"), pa.array(n_tiles, pa.int64()), pa.array(covered, pa.int64()), pa.array(size, pa.int64())],
                ["row", "doc_id", "item_id", "n_tiles", "covered", "item_words"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.mapInArrow(run, f"row long, doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_tiles long, covered long, item_words long")


def contamination(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_tiles, covered, item_words, coverage) for every document and item whose tiles cover ``threshold`` of the item or more.

    Words are ``[^\\x20\\x09-\\x0D]+``, lower-cased in A-Z; whole texts are searched. Tiles have at least ``seed`` words. Null and empty texts, and
    items of fewer words than a seed, match nothing; a repeated document or item gives its rows again; a null id comes back null; extra columns are
    left out; empty tables give no rows.

    The filter that goes to the workers has a fixed size and only spares seeds that no item has; the join on seeds is exact and has the distinct seeds
    of one item on one side, which adaptive execution splits when very many documents share a passage.
    """
    rows = columns(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    return _contaminated(rows, benchmark, seed, threshold).drop("row")


def _contaminated(rows: DataFrame, benchmark: DataFrame, seed: int, threshold: float) -> DataFrame:
    """:func:`contamination` of ``rows(row, doc_id, text)``, with the row; ``row`` tells all rows apart."""
    items = stage(benchmark_items(benchmark, seed).withColumn("item", F.monotonically_increasing_id()), "items")
    parts = stage(matching_parts(rows, items, seed), "parts")
    wanted = items.select("item", F.size("words").alias("_size"), F.posexplode("seeds").alias("_place", "seed"))
    shared = parts.select("row", F.explode("seeds").alias("seed")).join(wanted, "seed")
    # Tiles are made of shared seeds, so they cover no more of an item than those seeds do. Only pairs that can reach the threshold are tiled.
    shared = shared.groupBy("row", "item").agg(F.sort_array(F.collect_set("_place")).alias("_places"), F.first("_size").alias("_size"))
    reach = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(seed), F.coalesce(F.get("_places", i + 1), F.lit(1 << 30)) - p)), F.lit(0), lambda a, n: a + n)
    shared = shared.filter(reach >= threshold * F.col("_size")).select("row", "item")
    pairs = shared.join(parts.select("row", "doc_id", "words"), "row").join(items.select("item", "item_id", F.col("words").alias("_item")), "item")
    found = coverage(pairs.select("row", "doc_id", "item_id", "words", F.col("_item").alias("item")), seed)
    return found.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(F.col("coverage") >= threshold)


def clean(docs: DataFrame, benchmark: DataFrame, seed: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows whose own text :func:`contamination` doesn't name, with all columns. Each row is judged alone, whatever rows share its doc_id or have none.

    Rows are numbered once, in a stored copy, so that the numbers are the same when the copy is read for the search and for the join.
    """
    names = docs.columns
    rows = stage(docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id()), "numbered")
    asked = rows.select("row", F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"))
    named = stage(_contaminated(asked, benchmark, seed, threshold).select("row").distinct(), "named")
    return rows.join(named, "row", "left_anti").drop("row").toDF(*names)
