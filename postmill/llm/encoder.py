"""Byte-level BPE of whole texts with a public vocabulary, many texts at a time, with character offsets.

The vocabulary's pre-tokenizer puts a space with what follows it, and cuts a text between a letter or digit and a sign, and around a single line end, so
a text may be cut at such places and each chunk encoded alone. Chunks repeat: each new one is encoded by the tokenizers library once, and its tokens are
kept in a bounded hash table of arrays, with its bytes, which tell it from others of the same hash. Only where a space stands within or at the end of
longer white space does a cut change the tokens; such a text is given to the library whole.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from postmill.llm.textbatch import span_hashes

VOCABULARY = "byte_bpe_50k.json"
#: Chunks, and bytes of chunks, that are kept; the table is begun anew when either is passed. It then has some 40 MB.
CHUNKS, BYTES = 1 << 20, 1 << 24
#: New chunks are encoded so many at a time.
TOGETHER = 256


_WHITE = np.array([chr(b).isspace() for b in range(128)] + [False] * 128)
_SOLID = np.array([0x20 < b < 0x7F for b in range(256)])
_ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
#: An apostrophe may begin a piece that letters belong to.
_SIGN = _SOLID & ~_ALNUM & (np.arange(256) != ord("'"))


def _begins(data: np.ndarray) -> np.ndarray:
    """Where a chunk begins: at a space, at a sign behind a letter or digit, and at and behind a line end between two others. Beyond ASCII nothing is cut."""
    begins = data == 0x20
    begins[1:] |= _SIGN[data[1:]] & _ALNUM[data[:-1]]
    line = np.flatnonzero(data[1:-1] == 0x0A) + 1
    line = line[_SOLID[data[line - 1]] & _SOLID[data[line + 1]]]
    begins[line] = begins[line + 1] = True
    return begins


class _Grown:
    """An array that rows are added to."""

    def __init__(self, kind: type):
        self.held, self.n = np.zeros(1 << 10, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            held = np.zeros((self.n + len(values)) * 3 // 2, self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at):
        return self.held[at]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of runs of ``count`` values that begin at ``first``, one run after another."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(count.sum())


class Encoder:
    """Token ids of texts without special tokens; strings of special tokens in a text are ordinary text."""

    def __init__(self, vocabulary: str = VOCABULARY, offsets: bool = False, chunks: int = CHUNKS, chunk_bytes: int = BYTES):
        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.size = self.library.get_vocab_size()
        self.offsets, self.most = offsets, (chunks, chunk_bytes)
        #: Which tokens begin with a space.
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[i for token, i in self.library.get_vocab().items() if token.startswith("Ġ")]] = True
        self.line = self.library.token_to_id("Ċ")
        self.clear()

    def clear(self) -> None:
        """Forget the chunks."""
        self.table = np.full(1 << 12, -1, np.int32)
        #: By slot: hash, first byte and token, number of bytes and tokens, length in characters, and whether white space begins or ends the chunk.
        self.key, self.at, self.first = _Grown(np.uint64), _Grown(np.int32), _Grown(np.int32)
        self.bytes, self.count, self.chars = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32)
        self.blank_first, self.blank_last = _Grown(bool), _Grown(bool)
        self.data = _Grown(np.uint8)
        #: By token: id, and span from the chunk's first character.
        self.ids, self.starts, self.ends = _Grown(np.uint16 if self.size <= 1 << 16 else np.int32), _Grown(np.int32), _Grown(np.int32)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        mask = len(self.table) - 1
        found, left, at = np.full(len(key), -1, np.int32), np.arange(len(key)), (key & np.uint64(mask)).astype(np.int64)
        while len(left):
            slot = self.table[at]
            same = (slot >= 0) & (self.key[slot] == key[left])
            found[left[same]] = slot[same]
            on = (slot >= 0) & ~same
            left, at = left[on], (at[on] + 1) & mask
        return found

    def _place(self, key: np.ndarray, slot: np.ndarray) -> None:
        mask = len(self.table) - 1
        at = (key & np.uint64(mask)).astype(np.int64)
        while len(slot):
            free = self.table[at] < 0
            self.table[at[free]] = slot[free]
            lost = self.table[at] != slot  # taken before, or by another of these
            slot, at = slot[lost], (at[lost] + 1) & mask

    def _insert(self, key: np.ndarray) -> None:
        n = self.key.n
        self.key.add(key)
        if 2 * self.key.n > len(self.table):
            while 2 * self.key.n > len(self.table):
                self.table = np.full(2 * len(self.table), -1, np.int32)
            self._place(self.key[: self.key.n], np.arange(self.key.n, dtype=np.int32))
        else:
            self._place(key, np.arange(n, self.key.n, dtype=np.int32))

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, number of tokens of each part, and spans of the tokens; each part encoded by itself."""
        found = (self.library.encode_batch if self.offsets else self.library.encode_batch_fast)(parts, add_special_tokens=False)
        spans = [span for e in found for span in e.offsets] if self.offsets else []
        ids = [np.array(e.ids, self.ids.held.dtype) for e in found]
        return np.concatenate([self.ids[:0], *ids]), np.fromiter(map(len, ids), np.int64, len(ids)), np.array(spans, np.int64).reshape(-1, 2)

    def _together(self, parts: list[str], end: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of parts that are joined: each begins with its only space, or is ended by a line end of which it has none."""
        ids, sizes, spans = self._alone(["".join([p + end for p in parts[i : i + TOGETHER]]) for i in range(0, len(parts), TOGETHER)])
        own = ids != self.line if end else np.ones(len(ids), bool)
        count = np.diff(np.flatnonzero(~own), prepend=-1) - 1 if end else np.diff(np.append(np.flatnonzero(self.spaced[ids]), len(ids)))
        if self.offsets:
            chars = np.fromiter(map(len, parts), np.int64, len(parts)) + len(end)
            before = np.cumsum(chars) - chars
            spans = (spans + np.repeat(before[::TOGETHER], sizes)[:, None])[own] - np.repeat(before, count)[:, None]
        return ids[own], count, spans

    def _learn(self, key: np.ndarray, blob: bytes, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new chunks."""
        chunks = [blob[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        parts, size = [c.decode() for c in chunks], ends - starts
        spaced, second, last = data[starts] == 0x20, np.where(size > 1, data[np.minimum(starts + 1, len(data) - 1)], 0x20), data[ends - 1]
        blank_first, blank_last = spaced & _WHITE[second], _WHITE[last]
        for i in np.flatnonzero(spaced & (second >= 0x80)).tolist():
            blank_first[i] = parts[i][1].isspace()
        for i in np.flatnonzero(last >= 0x80).tolist():
            blank_last[i] = parts[i][-1].isspace()
        # Those of a space and a word, those without white space, and those that stand alone.
        bare = np.zeros(len(parts), bool)
        if self.line is not None:
            bare[~spaced] = [p.isascii() and p.isprintable() for p, s in zip(parts, spaced.tolist()) if not s]
        group = np.where(spaced & (second > 0x20) & ~blank_first, 0, np.where(bare, 1, 2))
        order = np.argsort(group, kind="stable")
        ordered, (a, b) = [parts[i] for i in order.tolist()], np.searchsorted(group[order], (1, 2))
        ids, count, spans = (np.concatenate(x) for x in zip(self._together(ordered[:a], ""), self._together(ordered[a:b], "\n"), self._alone(ordered[b:])))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.first.add((self.ids.n + np.cumsum(count) - count)[back])
        self.count.add(count[back])
        self.ids.add(ids)
        if self.offsets:
            self.starts.add(spans[:, 0])
            self.ends.add(spans[:, 1])
            self.chars.add(np.fromiter(map(len, parts), np.int32, len(parts)))
        self.at.add(self.data.n + np.cumsum(size) - size)
        self.bytes.add(size)
        self.data.add(np.frombuffer(b"".join(chunks), np.uint8))
        self.blank_first.add(blank_first)
        self.blank_last.add(blank_last)
        self._insert(key)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, ...]]:
        """(ids,) of each text, or (ids, starts, ends) with the character span of each token."""
        blobs = [t.encode() for t in texts]
        blob, offsets = b"".join(blobs), np.concatenate(([0], np.cumsum(np.fromiter(map(len, blobs), np.int64, len(blobs)))))
        del blobs
        data = np.frombuffer(blob, np.uint8)
        if not len(data):
            return [tuple(x[:0] for x in ((self.ids, self.starts, self.ends) if self.offsets else (self.ids,)))] * len(texts)
        if self.key.n > self.most[0] or self.data.n > self.most[1]:
            self.clear()
        begins = _begins(data)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        key = span_hashes(data, starts, ends)
        slot = self._find(key)
        missed = np.flatnonzero(slot < 0)
        if len(missed):
            own, at = np.unique(key[missed], return_index=True)
            self._learn(own, blob, data, starts[missed[at]], ends[missed[at]])
            slot[missed] = self._find(key[missed])
        # The chunks of text i are bounds[i] to bounds[i + 1]; its tokens likewise.
        bounds = np.searchsorted(starts, offsets)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        whole = np.zeros(len(texts), bool)
        size = ends - starts
        other = self.bytes[slot] != size
        if other.any():
            whole[owner[other]] = True
        else:
            whole[np.searchsorted(offsets, np.flatnonzero(self.data[_runs(self.at[slot], size)] != data), "right") - 1] = True
        unsafe = np.flatnonzero(self.blank_last[slot[:-1]] & self.blank_first[slot[1:]])
        whole[owner[unsafe[owner[unsafe] == owner[unsafe + 1]]]] = True
        count = self.count[slot]
        pick = _runs(self.first[slot], count)
        upto = np.concatenate(([0], np.cumsum(count)))[bounds]
        found = [self.ids[pick]]
        if self.offsets:
            chars = self.chars[slot].astype(np.int64)
            at = np.cumsum(chars) - chars
            base = np.repeat(at - at[bounds[:-1][owner]], count)
            found += [base + self.starts[pick], base + self.ends[pick]]
        return [self._whole(t) if w else tuple(x[a:b] for x in found) for t, w, a, b in zip(texts, whole.tolist(), upto[:-1].tolist(), upto[1:].tolist())]

    def _whole(self, text: str) -> tuple[np.ndarray, ...]:
        found = self.library.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, self.ids.held.dtype)
        if not self.offsets:
            return (ids,)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        return ids, spans[:, 0], spans[:, 1]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(vocabulary: str = VOCABULARY, offsets: bool = False) -> Encoder:
    """The worker's own encoder, which tasks that follow each other share."""
    if (vocabulary, offsets) not in _encoders:
        _encoders[vocabulary, offsets] = Encoder(vocabulary, offsets)
    return _encoders[vocabulary, offsets]
