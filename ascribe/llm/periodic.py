"""Periodic runs of words by a dictionary of basic factors (operator 11).

A run is a stretch of consecutive words of one document with smallest period
``q``, at least ``max(MIN_LENGTH, 2 * q)`` words long, that no neighbouring
word extends keeping the period.

The dictionary names, for every power of two ``m``, the factor of ``m`` words
that starts at each place; equal factors of one document share a name, and a
factor that occurs once is not refined further.  For one ``m``:

1. the places of a name, in order, fall into arithmetic progressions: a
   successor at most ``m / 2`` away is the next member (two such occurrences
   overlap by half, so the distance is the factor's own period).  Only the last
   member of each progression is kept;
2. kept places of one name lie more than ``m / 2`` apart, so each has at most
   three others within twice ``m``.  Each distance ``q`` in ``[m, 2m)`` is a
   proposed period.  A run of period ``q`` has such a pair: a factor inside its
   first period and the same factor ``q`` words later never lie in one
   progression (the period would not be the smallest), and their progressions
   end ``q`` words apart as the run goes on beyond them;
3. a proposal is extended both ways by comparing factors of falling lengths
   from the dictionary, and counts if it is long enough; of proposals for the
   same stretch the smallest period is the run's own.

Everything about a document happens in one pass over its words inside a task;
a document of n words needs about ``4 * n * log2(n)`` bytes if it is periodic
throughout, far less otherwise.  Words are compared by 64-bit hashes.

Defined cases: a null or empty text has no words and no runs (its collapsed
text is empty); a null ``doc_id`` is an ordinary value; repeated rows are
answered each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, combine, mix, slices
from .quality import let, words_of

MIN_LENGTH = 12
_DOC = 0x1F83D9ABFB41BD6B


def _group(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` sorted by (key, place), and each one's first place of
    the same key; places whose key occurs once are left out."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    starts = np.ones(len(keys), bool)
    starts[1:] = sorted_keys[1:] != sorted_keys[:-1]
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(keys)))
    many = np.repeat(size > 1, size)
    places = at[order]
    return places[many], np.repeat(places[first], size)[many]


class Factors:
    """Dictionary of basic factors of a slice's documents.  ``names[k][i]`` is
    the first place of the factor of ``2 ** k`` words at ``i``: ``i`` itself if
    it occurs once in its document or would leave it."""

    def __init__(self, words: Words):
        n = len(words.start)
        self.end = words.first[1:][words.doc] if n else np.zeros(0, np.int64)
        self.begin = words.first[:-1][words.doc] if n else np.zeros(0, np.int64)
        self.names: list[np.ndarray] = []
        self.shared: list[tuple[np.ndarray, np.ndarray]] = []      # places that share a name, sorted by (name, place)
        keys = combine(mix(words.doc.astype(np.uint64)), words.hashes(), _DOC)
        at, name = _group(keys, np.arange(n))
        while len(at):
            level = np.arange(n, dtype=np.int32)
            level[at] = name
            self.names.append(level)
            self.shared.append((at, name))
            size = 1 << (len(self.names) - 1)
            alive = np.zeros(n, bool)
            alive[at] = True
            at = np.flatnonzero(alive)
            at = at[at + 2 * size <= self.end[at]]
            at = at[alive[at + size]]
            at, name = _group(level[at].astype(np.int64) * n + level[at + size], at)

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) of every proposed run."""
        places, periods = [], []
        for k, (at, name) in enumerate(self.shared):
            size = 1 << k
            near = np.zeros(len(at), bool)
            near[:-1] = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= size)
            at, name = at[~near], name[~near]
            for step in (1, 2, 3):
                gap = at[step:] - at[:-step]
                fits = (name[step:] == name[:-step]) & (gap >= size) & (gap < 2 * size)
                places.append(at[:-step][fits])
                periods.append(gap[fits])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(periods)

    def extend(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximal stretches [start, end) around ``at`` that keep the period."""
        left, right = at.copy(), at + period
        begin, end = self.begin[at], self.end[at] if len(at) else at
        for k in range(len(self.names) - 1, -1, -1):
            size, level = 1 << k, self.names[k]
            # factors that would leave the document have names of their own and never match
            go = np.flatnonzero(right < end)
            same = level[right[go] - period[go]] == level[right[go]]
            right[go[same]] += size
            go = np.flatnonzero(left - size >= begin)
            same = level[left[go] - size] == level[left[go] - size + period[go]]
            left[go[same]] -= size
        return left, right

    def runs(self, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all runs, by start, then period."""
        at, period = self.proposals()
        start, end = self.extend(at, period)
        long = end - start >= np.maximum(min_length, 2 * period)
        start, end, period = start[long], end[long], period[long]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        return start[order], (end - start)[order], period[order]


def _joined(words: Words, keep: np.ndarray) -> pa.Array:
    """Each row's kept words joined by one space."""
    start, end, doc = words.start[keep], words.end[keep], words.doc[keep]
    out_end = np.cumsum(end - start + 1)
    size = int(out_end[-1]) if len(out_end) else 0
    source = np.repeat(start - (out_end - (end - start + 1)), end - start + 1) + np.arange(size)
    data = np.append(words.data, 0)[source].astype(np.uint8)
    data[out_end - 1] = 0x20
    last = np.concatenate(([0], out_end))[np.searchsorted(doc, np.arange(len(words.count) + 1))]
    has = np.diff(last) > 0
    # the space behind a row's last word goes
    take = np.ones(size, bool)
    take[last[1:][has] - 1] = False
    offsets = np.concatenate(([0], np.cumsum(np.diff(last) - has))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(words.count),
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[take].tobytes())]).cast(pa.string())


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs`` (an array of
    ``start, length, period`` by start, then period) and ``collapsed``, the
    words that lie in no run beyond its first period, joined by one space."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                n = len(words.start)
                start, length, period = Factors(words).runs(min_length)
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, start + length, -1)
                row = words.doc[start] if n else start
                offsets = np.searchsorted(row, np.arange(len(words.count) + 1)).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(start - words.first[row]), pa.array(length), pa.array(period)],
                                                   fields=list(_RUN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.count.astype(np.int64)),
                                                  pa.ListArray.from_arrays(pa.array(offsets), found, type=pa.list_(_RUN)),
                                                  _joined(words, np.cumsum(cover[:-1]) == 0)], schema=_RESULT)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
                                 "collapsed string")


def plant(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``text``, the texts of about one document in ten made
    periodic from some word on: with ``h`` the CRC-32 of the decimal id and
    ``g = h div 10``, if 10 divides h, word i >= a = g mod n becomes word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).  A null id has no h."""
    h = F.crc32(F.col(key).cast("bigint").cast("string"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)

        def tail(a: Column) -> Column:
            p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
            head, rest = F.slice(w, 1, a), F.slice(w, a + 1, p)
            repeated = F.slice(F.flatten(F.array_repeat(rest, F.ceil((n - a) / p).cast("int"))), 1, n - a)
            return F.concat(head, repeated)
        return F.when(n == 0, "").otherwise(F.array_join(let((g % n).cast("int"), tail), " "))
    changed = F.when(h % 10 == 0, let(words_of(text), periodic)).otherwise(F.col(text))
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), changed.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: the number of runs, the longest one (ties: the
    smallest start, then period) and digests of all runs and the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"],
                                                                F.lit("\n"))), "")
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
                    F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                    F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
