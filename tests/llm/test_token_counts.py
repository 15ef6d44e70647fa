import random

import numpy as np
import pytest

from postmill.llm.encoder import Encoder
from postmill.llm.token_counts import attribute, lines, section_tokens

TEXTS = [
    None, "", "a", "one line", "two\nlines", "a\n\n\nb\n", "\n", "  lead  and   trail  ", "x\n \ny", "tab\t \there \n end ", "<|endoftext|> <|endoftext|>", "日本語のテキスト\n次の行", "é" * 300 + "\nñ", "don't we'll 'S\r\nQ",
    "word " * 5_000 + "\nlast",
]


@pytest.fixture(scope="module")
def codec():
    return Encoder(offsets=True, chunks=50)


def test_encoder_equals_library(codec):
    rng = random.Random(4)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices("ab \n\t.'é日 \x1c\0<|>", k=rng.randint(0, 40))) for _ in range(1500)]
    plain = Encoder()
    for text, (ids, starts, ends), (alone,) in zip(texts, codec.encode(texts), plain.encode(texts)):
        want = codec.library.encode(text, add_special_tokens=False)
        assert ids.tolist() == alone.tolist() == want.ids, repr(text)
        assert list(zip(starts.tolist(), ends.tolist())) == want.offsets, repr(text)
        assert codec.decode(ids) == text
    assert len(codec.encode(["a b c"])[0][0]) == 3


def brute(text, rule, codec):
    sections = lines(text) or [(0, 0)]
    count = [[0, 0] for _ in sections]
    found = codec.library.encode(text, add_special_tokens=False)
    for a, b in found.offsets:
        share = [max(0, min(max(b, a + 1), y) - max(a, x)) for x, y in sections]
        met = [i for i, s in enumerate(share) if s]
        if met:
            own = {"largest": max(met, key=lambda i: (share[i], -i)), "first": met[0], "last": met[-1]}[rule]
            count[own][0] += 1
            count[own][1] += len(met) > 1
    return [(i, x, y, n, c, len(found.ids)) for i, ((x, y), (n, c)) in enumerate(zip(sections, count))]


@pytest.mark.parametrize("rule", ["largest", "first", "last"])
def test_query_equals_brute_force(spark, codec, rule):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "a b", "x", 1)], "doc_id long, text string, section string, start int")
    rows = section_tokens(docs, rule=rule).collect()
    want = [str((i, *r)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3]), (None, "a b")] for r in brute(t or "", rule, codec)]
    assert sorted(str(tuple(r)) for r in rows) == sorted(want)
    for i, t in enumerate(TEXTS):
        own = [r for r in rows if r.doc_id == i]
        assert sum(r.n_tokens for r in own) == sum(r.doc_tokens for r in own) / len(own) * (2 if i == 3 else 1)


def test_crossing_tokens():
    starts, ends = np.array([0, 2, 9]), np.array([2, 9, 12])
    spans = [(0, 3), (3, 4), (4, 8), (10, 12)]
    assert [attribute(starts, ends, spans, r)[0].tolist() for r in ("largest", "first", "last")] == [[1, 0, 1, 1], [2, 0, 0, 1], [1, 0, 1, 1]]
    assert attribute(starts, ends, spans)[1].tolist() == [0, 0, 1, 0]
    with pytest.raises(ValueError):
        attribute(starts, ends, spans, "all")


def test_empty(spark):
    assert section_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
