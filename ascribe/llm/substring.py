"""Removal of long repeated word passages by recompression (operator 3).

A window is ``WINDOW`` consecutive words of one document.  Each word covered
by a window that also starts in a document with a smaller ``doc_id`` is
removed; windows are judged on the input.

Recompression rewrites every document's words in rounds.  A run round names
each maximal run of one symbol, a pair round names each pair of a left and a
right symbol (a hashed bit of the symbol says which).  A name is a hash of
what it stands for, so all tasks give equal pieces the same name without
talking to each other.  Each symbol carries the words that its making depended
on; a symbol whose words all lie in a passage is made alike wherever that
passage occurs.  Then, as Spark jobs:

1. every document's symbols after ``SMALL`` rounds, and its long ones (a
   window or more) after later rounds, are dealt by name; names held by two
   documents or more are shared;
2. a shared long symbol whose smallest document comes before this one is a
   verified repeat as it stands (128-bit names): its words are covered;
3. a window is in doubt when all symbols that lie inside it, with the words
   they depend on, are shared, and it is not inside a covered symbol.  Those
   windows alone are named (128 bits), dealt, and compared.  A window without
   an inner symbol counts as in doubt, so nothing is missed;
4. each document drops the words that its repeated windows and symbols cover.

Defined cases: a null or empty text has no words (its kept text is empty);
fewer words than a window are all kept; a null ``doc_id`` neither covers nor
is covered; rows that repeat a ``doc_id`` do not cover each other; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_scratch, materialize
from .common import Words, combine, mix, powers, signed, slices

WINDOW = 50
SMALL = 7                      # rounds after which symbols are a few words long
LONG = (13, 17, 22)            # rounds after which symbols of a window or more are looked up
RUN_ROUNDS = (0, 4, 9, 14, 19)  # rounds that begin by naming runs
FAR = 1 << 40                  # stands for "depends on the document's edge"

_PAIR, _RUN = 0x51ED270B9F, 0x2545F4914F
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


class Symbols:
    """A slice's documents as symbols: two names each, the words [start, end)
    they stand for, and the words [low, high) they depend on."""

    def __init__(self, names: np.ndarray, doc: np.ndarray):
        n = len(names)
        self.a, self.b, self.doc = names, mix(names ^ np.uint64(0xA5A5A5A5A5A5A5A5)), doc
        self.start = np.arange(n)
        self.end = self.start + 1
        self.low, self.high = self.start.copy(), self.end.copy()

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What the left and right neighbours depend on; FAR beyond a document's edge."""
        left, right = np.full(len(self.a), -FAR), np.full(len(self.a), FAR)
        same = self.doc[1:] == self.doc[:-1]
        left[1:][same] = self.low[:-1][same]
        right[:-1][same] = self.high[1:][same]
        return left, right

    def _keep(self, first: np.ndarray, last: np.ndarray) -> None:
        """Keep the symbols from ``first`` to ``last``, one for each pair of places."""
        self.doc, self.start, self.end = self.doc[first], self.start[first], self.end[last]
        self.low, self.high = np.minimum(self.low[first], self.low[last]), np.maximum(self.high[first], self.high[last])

    def name_runs(self) -> None:
        if len(self.a) < 2:
            if len(self.a):
                self.low, self.high = self._neighbours()
            return
        starts = np.ones(len(self.a), bool)
        starts[1:] = (self.a[1:] != self.a[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(starts)
        last = np.append(first[1:], len(self.a)) - 1
        left, right = self._neighbours()
        count = (last - first + 1).astype(np.uint64)
        a, b = self.a[first], self.b[first]
        many = count > 1
        a[many] = combine(a[many], count[many], _RUN)
        b[many] = combine(b[many], count[many], _RUN + 2)
        low, high = left[first], right[last]
        self._keep(first, last)
        self.a, self.b, self.low, self.high = a, b, low, high

    def name_pairs(self, level: int) -> None:
        if not len(self.a):
            return
        with np.errstate(over="ignore"):
            side = (mix(self.a + np.uint64(level) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(self.a), bool)
        joins[:-1] = ~side[:-1] & side[1:] & (self.doc[1:] == self.doc[:-1])
        joined = np.zeros(len(self.a), bool)
        joined[1:] = joins[:-1]
        left, right = self._neighbours()
        # a left symbol that stays alone depends on its right neighbour, a right symbol on its left one
        alone = ~joins & ~joined
        self.high = np.where(alone & ~side, right, self.high)
        self.low = np.where(alone & side, left, self.low)
        first = np.flatnonzero(~joined)
        last = first + joins[first]
        a, b = self.a[first], self.b[first]
        two = joins[first]
        a[two] = combine(a[two], self.a[last[two]], _PAIR)
        b[two] = combine(b[two], self.b[last[two]], _PAIR + 2)
        self._keep(first, last)
        self.a, self.b = a, b


def rounds(words: Words, names: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, Symbols]]:
    """(round, symbols) after SMALL rounds and after each of LONG."""
    s = Symbols(names, words.doc)
    for level in range(max(LONG)):
        if level in RUN_ROUNDS:
            s.name_runs()
        s.name_pairs(level)
        if level + 1 == SMALL or level + 1 in LONG:
            yield level + 1, s


def symbol_rows(words: Words, names: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, a, b, row, ordinal) of the symbols that are looked up: kind 0
    small ones that fit into a window with what they depend on, else the round."""
    for level, s in rounds(words, names, window):
        if level == SMALL:
            pick = np.flatnonzero((s.high - s.low <= window) & (words.count[s.doc] >= window))
        else:
            pick = np.flatnonzero(s.end - s.start >= window)
        base = np.searchsorted(s.doc, np.arange(len(words.count)))
        yield (0 if level == SMALL else level), s.a[pick], s.b[pick], s.doc[pick], pick - base[s.doc[pick]]


def window_names(names: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the windows that start at the given words."""
    out = []
    for base, lane in zip(_BASES, (names, mix(names ^ np.uint64(0x3C3C3C3C3C3C3C3C)))):
        with np.errstate(over="ignore"):
            n = len(lane)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(lane * powers(base, n), dtype=np.uint64)))
            out.append(mix((sums[at + window] - sums[at]) * powers(pow(base, -1, 1 << 64), n)[at]))
    return out[0], out[1]


def doubtful(words: Words, names: np.ndarray, shared: list[np.ndarray], covers: list[dict[int, np.ndarray]],
             window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows to compare, and the covered spans (start, end).
    ``shared[row]`` are ordinals of shared small symbols, ``covers[row][round]``
    those of long symbols that a smaller document holds."""
    n = len(names)
    dead = np.zeros(n + 1, np.int64)
    start, end = [], []
    for level, s in rounds(words, names, window):
        base = np.searchsorted(s.doc, np.arange(len(words.count)))
        if level == SMALL:
            known = np.zeros(len(s.a), bool)
            for row, o in enumerate(shared):
                if len(o):
                    known[base[row] + o] = True
            k = np.flatnonzero(~known & (s.high - s.low <= window))
            # windows from high - window to low hold the symbol whole
            np.add.at(dead, np.maximum(s.high[k] - window, words.first[s.doc[k]]), 1)
            np.add.at(dead, s.low[k] + 1, -1)
        else:
            at = [base[row] + by[level] for row, by in enumerate(covers) if level in by]
            if at:
                at = np.concatenate(at)
                start.append(s.start[at])
                end.append(s.end[at])
    start = np.concatenate(start) if start else np.zeros(0, np.int64)
    end = np.concatenate(end) if end else np.zeros(0, np.int64)
    # a window inside one covered span is known already
    np.add.at(dead, start, 1)
    np.add.at(dead, end - window + 1, -1)
    alive = np.cumsum(dead[:n]) == 0
    room = words.first[1:][words.doc] - np.arange(n) >= window
    return np.flatnonzero(alive & room), start, end


_SYMBOL = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()),
                     ("ordinal", pa.int32())])
_WINDOW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("start", pa.int32()),
                     ("end", pa.int32())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def kept_texts(words: Words, keep: np.ndarray) -> list[bytes]:
    """Each row's kept words joined by one space."""
    start, end = words.start[keep], words.end[keep]
    doc = words.doc[keep]
    more = np.zeros(len(start), bool)                       # another kept word follows in the row
    more[:-1] = doc[1:] == doc[:-1]
    mark = np.zeros(len(words.data) + 2, np.int8)
    np.add.at(mark, start, 1)
    np.add.at(mark, end + more, -1)
    take = np.cumsum(mark[:len(words.data)]) > 0
    data = words.data.copy()
    data[end[more]] = 0x20
    at = np.concatenate(([0], np.cumsum(take)))[words.row]
    out = data[take].tobytes()
    return [out[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed,
    kept_sha256`` and, if asked for, ``kept_text``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                       F.xxhash64("text").alias("key"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                for kind, a, b, row, ordinal in symbol_rows(words, words.hashes(), window):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(signed(a)), pa.array(signed(b)),
                                                      part.column("doc_id").take(at), part.column("key").take(at),
                                                      pa.array(ordinal.astype(np.int32))], schema=_SYMBOL)
    symbols = materialize(rows.where("doc_id is not null").mapInArrow(
        name, "kind int, a bigint, b bigint, doc_id bigint, key bigint, ordinal int"), "symbols")
    # a table of its own: next to it in the join, Spark can split the partition of a hot name
    held = materialize(symbols.groupBy("kind", "a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "held")
    found = (symbols.join(held, ["kind", "a", "b"]).where((F.col("kind") == 0) | (F.col("doc_id") > F.col("low")))
             .groupBy("doc_id", "key", "kind").agg(F.collect_set("ordinal").alias("ordinals")))
    flags = materialize(found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("kind", "ordinals")).alias("flags")), "flags")
    drop_scratch(symbols, held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                names = words.hashes()
                shared, covers = [], []
                for flag in part.column("flags").to_pylist():
                    by = {f["kind"]: np.array(f["ordinals"], np.int64) for f in flag or ()}
                    shared.append(by.pop(0, np.zeros(0, np.int64)))
                    covers.append(by)
                at, start, end = doubtful(words, names, shared, covers, window)
                a, b = window_names(names, at, window)
                doc = words.doc
                for where, x, y, s, e in ((doc[at], a, b, at, None), (doc[start], None, None, start, end)):
                    take, first = pa.array(where), words.first[where]
                    blank = pa.nulls(len(where), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("key").take(take),
                                                      pa.array(signed(x)) if x is not None else blank,
                                                      pa.array(signed(y)) if y is not None else blank,
                                                      pa.array((s - first).astype(np.int32)),
                                                      pa.array(((e if e is not None else s + window) - first).astype(np.int32))], schema=_WINDOW)
    keys = ["doc_id", "key"]
    doubt = materialize(rows.where("doc_id is not null").join(flags, keys, "left").mapInArrow(
        compare, "doc_id bigint, key bigint, a bigint, b bigint, start int, end int"), "windows")
    drop_scratch(flags)
    windows = doubt.where("a is not null")
    least = materialize(windows.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "least")
    repeats = windows.join(least, ["a", "b"]).where(F.col("doc_id") > F.col("low")).select(*keys, "start", "end")
    spans = materialize(repeats.union(doubt.where("a is null").select(*keys, "start", "end")).distinct()
                        .groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    drop_scratch(doubt, least)

    schema = pa.schema([*_RESULT, *([("kept_text", pa.string())] if with_text else [])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                cover = np.zeros(len(words.start) + 1, np.int64)
                for row, own in enumerate(part.column("spans").to_pylist()):
                    if own:
                        both = np.array([(s["start"], s["end"]) for s in own]) + words.first[row]
                        np.add.at(cover, both[:, 0], 1)
                        np.add.at(cover, both[:, 1], -1)
                keep = np.cumsum(cover[:-1]) == 0
                texts = kept_texts(words, keep)
                gone = words.count - np.bincount(words.doc[keep], minlength=len(words.count))
                columns = [part.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(gone.astype(np.int64)),
                           pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
    joined = rows.join(spans, keys, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(finish, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
                             + (", kept_text string" if with_text else ""))
