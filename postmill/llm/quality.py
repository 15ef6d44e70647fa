"""Quality rules: counts with fixed limits, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.llm.shared import columns, tidy
from postmill.llm.textbatch import Words, mix, slices, sums, utf8, windows

#: Feature bins: the first half for words and word pairs, the second for runs of three characters.
BINS = 1 << 18
CHARS = 3
#: Frequencies are small numbers; this brings them to the size that the optimiser's steps suit.
SCALE = 16.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules, and the least calibrated probability of good quality."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    min_probability: float = 0.3


@dataclass(frozen=True)
class Model:
    """Logit of good quality = bias + weights . features; probability = 1 / (1 + exp(-(slope * logit + shift)))."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(BINS, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -60, 60)))


def base_counts(column: pa.Array, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text; a null is an empty text."""
    words = Words(column, lower=False)
    whole = (words.data & 0xC0) != 0x80
    found = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": sums(whole & words.is_word, words.offsets),
        "n_symbols": sums(_SYMBOL[words.data], words.offsets),
        "n_dup_lines": np.fromiter(map(_dup_lines, column.to_pylist()), np.int64, len(column)),
    }
    runs, at = windows(words.hashes(), words.text, window)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    if len(runs):
        key = mix(runs ^ mix(words.text[at].astype(np.uint64) + np.uint64(1)))
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        again = at[count[place] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    found["n_repeat_words"] = sums(np.cumsum(covered[:-1]) > 0, words.bounds)
    return found


def _dup_lines(text: str | None) -> int:
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def features(column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The bins of all words and word pairs, and of all character runs, each with the text they belong to."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    pairs, at = windows(hashes, words.text, 2)
    word_bins = (np.concatenate((hashes, pairs)) >> np.uint64(64 - 17)).astype(np.int64)
    word_rows = np.concatenate((words.text, words.text[at]))
    data, offsets = utf8(column)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    rows = np.repeat(np.arange(len(column)), np.diff(before))
    runs, first = windows(mix(chars + np.uint64(1)), rows, CHARS)
    return (word_bins, word_rows), ((runs >> np.uint64(64 - 17)).astype(np.int64) + BINS // 2, rows[first])


def logits(column: pa.Array, model: Model) -> np.ndarray:
    total = np.full(len(column), model.bias)
    for bins, rows in features(column):
        count = np.bincount(rows, minlength=len(column))
        total += SCALE * np.bincount(rows, weights=model.weights[bins], minlength=len(column)) / np.maximum(count, 1)
    return total


def score(column: pa.Array, model: Model, rules: Rules) -> dict[str, np.ndarray]:
    """The base counts, base_failed, the probability of good quality, and kept, of every text."""
    found = base_counts(column, rules.window)
    found["base_failed"] = (found["n_words"] < rules.min_words) | (100 * found["n_repeat_words"] > rules.max_repeat_percent * found["n_words"])
    found["probability"] = model.probability(logits(column, model))
    found["kept"] = ~found["base_failed"] & (found["probability"] >= rules.min_probability)
    return found


def _examples(docs: DataFrame, labels: DataFrame, rows: int) -> pa.Table:
    """(label, bins, values) of at most ``rows`` labelled documents: those whose ids have the least hashes. Repeated labels are one label, and of
    documents of one id that with the least hash of its text stands for all, so that no more than ``rows`` reach the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                parts = []
                for bins, owner in features(part.column(1)):
                    count = np.bincount(owner, minlength=part.num_rows)
                    key, n = np.unique(owner * BINS + bins, return_counts=True)
                    parts.append((key // BINS, key % BINS, SCALE * n / count[key // BINS]))
                own, bins, values = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(own, kind="stable")
                ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=part.num_rows)))).astype(np.int32)
                yield pa.record_batch(
                    [part.column(0), pa.ListArray.from_arrays(ends, pa.array(bins[order].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values[order].astype(np.float32)))],
                    ["quality", "bins", "values"],
                )

    chosen = columns(labels, "doc_id", "quality").filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id", "quality"), "doc_id").limit(rows)
    # The limit bounds what is broadcast: ``rows`` pairs of numbers.
    sample = columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Tasks keep one text a label before the shuffle.
    sample = sample.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return sample.select("quality", "text").mapInArrow(run, "quality int, bins array<int>, values array<float>").toArrow()


def train(docs: DataFrame, labels: DataFrame, rows: int = 2_000, steps: int = 120, penalty: float = 1e-4) -> Model:
    """A model fitted on at most ``rows`` labelled documents (whole texts), with every fifth kept back to calibrate the probability.

    Labels other than 0 and 1 and labels of missing documents are left out. If fewer than two of either kind are found, the model keeps everything.
    """
    found = _examples(docs, labels, rows).combine_chunks()
    labels_, lists = found["quality"].to_numpy(), found["bins"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    # In an order that doesn't depend on how tasks ended: copies of a text may change places.
    sums_ = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=lists.values.to_numpy(), minlength=len(sizes))
    order = np.lexsort((sums_, sizes, labels_))
    y = np.empty(len(order))
    y[:] = labels_[order]
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    held = np.arange(len(order)) % 5 == 4
    if min((y[~held] == k).sum() for k in (0, 1)) < 2:
        return Model(bias=60.0)
    bins, values = lists.values.to_numpy(), found["values"].combine_chunks().values.to_numpy()
    owner = np.repeat(place, sizes)
    learn = (~held)[owner]
    b, v, o = bins[learn], values[learn], owner[learn]
    weights, bias, mean, square = np.zeros(BINS), 0.0, np.zeros(BINS + 1), np.zeros(BINS + 1)
    balance = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    for step in range(1, steps + 1):
        logit = np.bincount(o, weights=weights[b] * v, minlength=len(y)) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y)
        slope = np.append(np.bincount(b, weights=v * error[o], minlength=BINS) + penalty * weights, error.sum())
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    logit = np.bincount(owner, weights=weights[bins] * values, minlength=len(y)) + bias
    slope, shift = _calibrate(logit[held], y[held])
    return Model(weights.astype(np.float32), float(bias), slope, shift)


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's method, by Newton steps on smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    aim = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack((logit, np.ones(len(y))), axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (p - aim) + 1e-4 * (at - [1.0, 0.0]))
        at = at - step / max(1.0, np.abs(step).max())
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def quality(docs: DataFrame, model: Model, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base counts, base_failed, probability and kept for every row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A null, empty or blank text has no words and fails the base rules. Every row is judged alone:
    repeated rows and null ids come back as they are; extra columns are left out; an empty table gives no rows.
    """
    docs = columns(docs, "doc_id", "text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = score(part.column(1), model, rules)
                yield pa.record_batch([part.column(0), *map(pa.array, found.values())], ["doc_id", *found])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep(docs: DataFrame, model: Model, rules: Rules = Rules()) -> DataFrame:
    """The rows that :func:`quality` keeps, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = names.index("text")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{text}"):
                yield part.filter(pa.array(score(part.column(text), model, rules)["kept"]))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
