"""Tokenizing texts with a public vocabulary, each distinct chunk once.

The vocabulary's normaliser and splitter never join characters across a
space, tab or line end, so the ids of a text are those of its chunks in
order.  A worker keeps the ids of chunks it has seen (bounded, then emptied),
finds a slice's chunks by the hashes of their bytes (128 bits) and gathers
their ids with array operations; only new chunks become Python strings.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words

DEFAULT_VOCABULARY = "word_bpe_49k.json"
CACHE_CHUNKS = 800_000         # chunks a worker keeps; beyond that it starts anew


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Place of a public vocabulary file on the driver (a parameter of every operator)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def vocabulary_json(path: str | None = None) -> str:
    """Text of the vocabulary, read on the driver and shipped to the tasks: a
    public file of fixed size, not data."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return f.read()


# closing ASCII punctuation without the apostrophe (it starts a contraction) and "<" (it may start a special token)
_CLOSING = "!\"#$%&()*+,-./:;=>?@[\\]^`{|}~"


@lru_cache(1 << 16)
def one_letter(c: str) -> bool:
    """Whether a character is one letter or digit to the splitter too, which
    sees it composed (NFC) and lower-cased: İ, for one, becomes a letter and a
    mark, and the splitter cuts in front of the mark."""
    low = normalize("NFC", normalize("NFC", c).lower())
    return len(low) == 1 and c.isalnum() and low.isalnum()


class HashTable:
    """128-bit keys to row numbers, looked up and filled many at a time (open addressing)."""

    def __init__(self, size: int = 1 << 16):
        self.a, self.b = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.row = np.full(size, -1, np.int64)
        self.used = 0

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The keys' rows, -1 for keys that are not there."""
        out = np.full(len(a), -1, np.int64)
        mask = len(self.row) - 1
        slot, open_ = (a & np.uint64(mask)).astype(np.int64), np.arange(len(a))
        while len(open_):
            at = slot[open_]
            row = self.row[at]
            same = (self.a[at] == a[open_]) & (self.b[at] == b[open_]) & (row >= 0)
            out[open_[same]] = row[same]
            open_ = open_[~same & (row >= 0)]
            slot[open_] = (slot[open_] + 1) & mask
        return out

    def add(self, a: np.ndarray, b: np.ndarray, row: np.ndarray) -> None:
        """Keys that are not there yet, all different."""
        if 2 * (self.used + len(a)) > len(self.row):
            old = np.flatnonzero(self.row >= 0)
            size = len(self.row)
            while 2 * (self.used + len(a)) > size:
                size *= 2
            a, b, row = (np.concatenate([x[old], y]) for x, y in ((self.a, a), (self.b, b), (self.row, row)))
            self.__init__(size)
        mask = len(self.row) - 1
        slot, open_ = (a & np.uint64(mask)).astype(np.int64), np.arange(len(a))
        while len(open_):
            free = open_[self.row[slot[open_]] < 0]
            self.row[slot[free]] = row[free]                    # of several for one place the last one wins
            won = free[self.row[slot[free]] == row[free]]
            self.a[slot[won]], self.b[slot[won]] = a[won], b[won]
            left = np.ones(len(a), bool)
            left[won] = False
            open_ = open_[left[open_]]
            slot[open_] = (slot[open_] + 1) & mask
        self.used += len(a)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


class ChunkTokenizer:
    """Ids of texts; ``plain_specials`` treats strings of special tokens as ordinary text."""

    def __init__(self, vocabulary: str, plain_specials: bool = False):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = plain_specials
        self.specials = () if plain_specials else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, bool)
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Drop the chunks seen so far; the vocabulary stays."""
        self.table = HashTable()                        # chunks, by their bytes' hashes
        self.place: dict[str, int] = {"": 0}            # parts of chunks
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used, self.rows = 0, 1
        self.at = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)

    def _append(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows for the given runs of ids."""
        total, n, more = len(ids), self.rows, len(lengths)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + more > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.ids[self.used:self.used + total] = ids
        self.at[n:n + more] = self.used + np.cumsum(lengths) - lengths
        self.length[n:n + more] = lengths
        self.used += total
        self.rows += more
        return np.arange(n, n + more)

    def _learn(self, chunks: list[str]) -> np.ndarray:
        """Encode chunks not seen yet; their rows.  A chunk is its core (lower-cased
        if it is ASCII, as the normaliser does) and a closing run of ASCII
        punctuation, which the splitter cuts off a letter; parts seen before
        are reused, and cores of letters only are encoded as one text."""
        cores, closings = [], []
        for c in chunks:
            # beyond ASCII a mark may compose with a small letter but not with its capital
            low = c.lower() if c.isascii() else c
            core = low.rstrip(_CLOSING)
            n = len(core)
            if n != len(low) and n and one_letter(core[-1]):
                cores.append(core)
                closings.append(low[n:])
            else:
                cores.append(low)
                closings.append("")
        place = self.place
        new = list((set(cores) | set(closings)).difference(place))
        plain = [c for c in new if c.isalpha() and (c.isascii() or c.lower().isalpha())]
        other = list(set(new).difference(plain))
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(plain):
                place.update(zip(plain, self._append(ids, np.diff(ends, prepend=0).astype(np.int32)).tolist()))
            else:                                   # a letter that the splitter counts as something else
                other = new
        if other:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            lengths = np.fromiter(map(len, each), np.int32, len(each))
            rows = self._append(np.fromiter(chain.from_iterable(each), np.uint32, int(lengths.sum())), lengths)
            place.update(zip(other, rows.tolist()))
        out = np.fromiter(map(place.__getitem__, cores), np.int64, len(cores))
        tail = np.fromiter(map(place.__getitem__, closings), np.int64, len(cores))
        both = np.flatnonzero(tail)                 # row 0 is the empty part
        if len(both):
            ids, ends = self._gather(np.stack([out[both], tail[both]], 1).ravel())
            out[both] = self._append(ids, np.diff(ends[1::2], prepend=0).astype(np.int32))
        return out

    def _gather(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[where].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.at[where] - ends + lengths, lengths) + np.arange(total)], ends

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text's ids; null is empty."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.specials):
            each = [e.ids for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
            return np.fromiter(chain.from_iterable(each), np.uint32, int(offsets[-1])), offsets
        words = Words(texts, separator=_BLANK)
        if self.rows > CACHE_CHUNKS:
            self.forget()
        a, b = words.hashes(), words.hashes(1)
        row = self.table.find(a, b)
        while len(missing := np.flatnonzero(row < 0)):
            at = missing[np.unique(a[missing], return_index=True)[1]]
            raw = words.data.tobytes()
            chunks = [raw[s:e].decode() for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]
            self.table.add(a[at], b[at], self._learn(chunks))
            row[missing] = self.table.find(a[missing], b[missing])
        ids, ends = self._gather(row)
        offsets = np.concatenate(([0], ends))[words.first].astype(np.int64)
        return ids, offsets


def sentence_end_ids(vocabulary: str) -> np.ndarray:
    """Ids of tokens made of closing punctuation that end a sentence."""
    import json
    vocab = json.loads(vocabulary)["model"]["vocab"]
    ends = [i for token, i in vocab.items()
            if (core := token.removesuffix("</w>")) and token.endswith("</w>")
            and set(core) <= set(".!?\"')]") and set(core) & set(".!?")]
    return np.array(sorted(ends), np.uint32)


_WORKER: dict = {}


def worker_tokenizer(vocabulary: str, plain_specials: bool = False) -> ChunkTokenizer:
    """The Python worker's tokenizer, built once and reused by its next tasks."""
    key = (hash(vocabulary), plain_specials)
    if key not in _WORKER:
        _WORKER[key] = ChunkTokenizer(vocabulary, plain_specials)
    return _WORKER[key]
