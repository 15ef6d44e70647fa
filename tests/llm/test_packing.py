"""Packing against serial best-fit decreasing and against plain encoding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postmill.llm.encoder import Encoder
from postmill.llm.packing import cuts, pack, packed, sequences, sweeps

SCHEMA = "doc_id long, text string"


def serial(lengths, size):
    """Rooms left by best-fit decreasing, one document at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        best = min((k for k, room in enumerate(rooms) if room >= n), key=lambda k: rooms[k], default=None)
        if best is None:
            rooms.append(size - n)
        else:
            rooms[best] -= n
    return rooms


def check(places, size):
    """places: (length, sequence, offset). Gapless from 0 and not too long; returns what is left free in each sequence."""
    held = defaultdict(list)
    for n, sequence, offset in places:
        held[sequence].append((offset, n))
    free = []
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
        free.append(size - at)
    return free


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_sweeps_are_best_fit_decreasing(lengths, size):
    runs = sorted(Counter(lengths).items(), reverse=True)
    order = sorted(lengths, reverse=True)
    places, at = [], 0
    for n, since, until, sequence, each, offset in sweeps(runs, size):
        assert since == at and order[since:until] == [n] * (until - since)
        places += [(n, sequence + k // each, offset + k % each * n) for k in range(until - since)]
        at = until
    assert at == len(lengths)
    assert sorted(check(places, size)) == sorted(serial(lengths, size))


def test_cuts():
    assert cuts(1, 8) == [(0, 1)] and cuts(8, 8) == [(0, 8)] and cuts(9, 8) == [(0, 1), (1, 8)] and cuts(16, 8) == [(0, 8), (8, 8)]
    assert cuts(21, 8) == [(0, 5), (5, 8), (13, 8)]


def test_packed_equals_brute_force(spark):
    dice = random.Random(5)
    words = "the of and quick brown jumps naïve 日本 2048 tokens".split()
    docs = [(i, " ".join(dice.choice(words) for _ in range(int(dice.expovariate(1 / 40))))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "word " * 5000), (403, "<|endoftext|> a\n\n  b"), (7, docs[7][1]), (7, "other"), (None, "no id"), (None, "no id"), (-9, "x")]
    frame = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA + ", length int, piece string, Text int").repartition(6)
    rows = packed(frame, 64, with_ids=True)
    got = rows.collect()
    codec, want = Encoder().library, Counter()
    for i, text in docs:
        ids = np.array([*codec.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cuts(len(ids), 64)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert sorted(check([(r.length, r.sequence_id, r.offset) for r in got], 64)) == sorted(serial([r.length for r in got], 64))
    held = defaultdict(dict)
    for r in got:
        held[r.sequence_id][r.offset] = bytes(r.ids)
    for r in sequences(rows).collect():
        assert bytes(r.ids) == b"".join(data for _, data in sorted(held.pop(r.sequence_id).items())) and r.n_tokens == len(r.ids) / 4
    assert not held


def test_reruns_and_splits_agree(spark):
    dice = random.Random(1)
    rows = [(dice.randint(1, 100), i) for i in range(3000)] + [(50, 9999)] * 300
    frame = spark.createDataFrame(rows, "length long, name long")
    found = [Counter(map(tuple, pack(f, 100).collect())) for f in (frame.repartition(3), frame.repartition(11))]
    assert found[0] == found[1]
    free = check([(n, sequence, offset) for n, _, sequence, offset in found[0].elements()], 100)
    assert sorted(free) == sorted(serial([n for n, _ in rows], 100))


def test_one_length_for_all(spark):
    rows = pack(spark.range(5000).selectExpr("3L AS length", "id"), 10).collect()
    assert len({r.sequence_id for r in rows}) == 1667 and Counter(r.offset for r in rows) == {0: 1667, 3: 1667, 6: 1666}


def test_empty(spark):
    assert packed(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "length long"), 0)
