import zlib

import numpy as np
import pytest

from postmill.llm.encoder import Encoder
from postmill.llm.records import frame, masked, pack, read_records, token_records, unframe, unpack, write_records
from postmill.llm.shared import fresh_dir

TEXTS = [(5, "five words are in here"), (2, None), (9, ""), (2, "again two"), (None, "no id"), (-7, "a\nb  c"), (3, "long " * 30_000), (5, "five words are in here"), (11, "é日本 <|endoftext|>")]


def test_frames():
    data = frame(b"abc") + frame(b"") + frame(b"x" * 70_000)
    a, at = unframe(data, 0)
    b, at = unframe(data, at)
    c, at = unframe(data, at)
    assert (a, b, len(c), at) == (b"abc", b"", 70_000, len(data))
    for place in (0, 9, 13, 16):
        broken = bytearray(frame(b"abc"))
        broken[place] ^= 1
        with pytest.raises(ValueError):
            unframe(bytes(broken), 0)
    assert masked(b"") == 0xA282EAD8
    for wide in (False, True):
        for doc_id in (None, 0, -5, 2**62):
            ids = np.array([1, 65_535, 0])
            assert unpack(pack(doc_id, ids, wide))[0] == doc_id and unpack(pack(doc_id, ids, wide))[1].tolist() == ids.tolist()


def test_query_equals_brute_force(spark):
    codec = Encoder().library
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    docs = spark.createDataFrame([(*r, "x", 1) for r in TEXTS], "doc_id long, text string, file string, start int").repartition(3)
    rows = token_records(docs).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [i for i, _ in order]
    at = 0
    want = {}
    for i, t in TEXTS:
        ids = np.array([*codec.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in rows:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(want.values())


def test_files_and_rerun(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(5000)], "doc_id long, text string")
    path = fresh_dir(spark, "records")
    first = write_records(docs, path)
    second = write_records(docs, path)  # as a task that runs again: the same files
    assert first.collect() == second.collect()
    rows = read_records(spark, first).select("doc_id", "start").orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(5000))


def test_empty(spark):
    assert token_records(spark.createDataFrame([], "doc_id long, text string")).count() == 0
