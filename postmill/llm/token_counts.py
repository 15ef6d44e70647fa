"""Token counts of the sections of documents, from one encoding of each whole document.

Tokens of a section encoded alone differ from those of the whole text. So each document is encoded once with character offsets, and the tokens' spans are
joined to the sections' spans; a token that crosses from one section into another is allocated by a stated rule.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postmill.llm.encoder import VOCABULARY, encoder
from postmill.llm.shared import columns
from postmill.llm.textbatch import slices

RULES = ("largest", "first", "last")
_LINE = re.compile("[^\n]*\n|[^\n]+")


def lines(text: str) -> list[tuple[int, int]]:
    """The lines of a text as spans, each with its line end, so that they cover the text."""
    return [m.span() for m in _LINE.finditer(text)]


def attribute(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """For each of ``sections`` (ascending, not overlapping): its tokens, and how many of them cross a boundary.

    A token belongs to the sections that hold a character of its span. One that meets several goes to the one with most of its characters (``largest``; of
    equals the first), or to the first or last of them. One that meets none counts nowhere. A token of no characters counts where it stands.
    """
    if rule not in RULES:
        raise ValueError(f"rule: one of {', '.join(RULES)}")
    n = len(sections)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, finish = np.array(sections, np.int64).T
    ends = np.maximum(ends, starts + 1)
    first = np.searchsorted(finish, starts, "right")
    last = np.searchsorted(begin, ends, "left") - 1
    met = first <= last
    first, last, starts, ends = first[met], last[met], starts[met], ends[met]
    own = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(last > first)
    if rule == "largest":
        for k in crossing.tolist():
            at = np.arange(first[k], last[k] + 1)
            own[k] = at[np.argmax(np.minimum(ends[k], finish[at]) - np.maximum(starts[k], begin[at]))]
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def section_tokens(docs: DataFrame, sections: Callable[[str], list[tuple[int, int]]] = lines, rule: str = "largest", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens), a row for each section of every row of ``docs(doc_id, text)``.

    ``sections`` gives ascending spans of characters; section counts from 0. Tokens of all sections add up to doc_tokens if the sections cover the text.
    Whole texts are encoded. A null or empty text has one empty section without tokens; repeated rows come back repeated; a null doc_id is kept; extra
    columns are left out; an empty table gives no rows.
    """
    rows = columns(docs, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary, offsets=True)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).fill_null("").to_pylist()
                owner, out = [], [[] for _ in names]
                for row, (text, (ids, starts, ends)) in enumerate(zip(texts, codec.encode(texts))):
                    spans = sections(text) or [(0, 0)]
                    tokens, crossing = attribute(starts, ends, spans, rule)
                    n = len(spans)
                    owner.append(np.full(n, row))
                    for held, values in zip(out, (np.arange(n), [a for a, _ in spans], [b for _, b in spans], tokens, crossing, np.full(n, len(ids)))):
                        held.append(np.asarray(values, np.int64))
                yield pa.record_batch([part.column(0).take(pa.array(np.concatenate(owner))), *[pa.array(np.concatenate(held)) for held in out]], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))
