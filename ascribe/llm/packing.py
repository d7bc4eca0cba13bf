"""Order-preserving packing of documents into fixed windows (operator 2).

Documents, in order of ``doc_id``, form one stream of token ids, each document
closed by an end id.  Every Spark partition packs its range of the order; in it a
dynamic program over the cut places (document ends, sentence ends, and places
inside a very long sentence) picks the windows with the least padding plus
cut penalties.  With S(i) the tokens before cut i and f(i) the least cost up
to it,

    f(j) = min over i with S(j) - S(i) <= width of f(i) + width - (S(j) - S(i)) + penalty(j)

so the best i is the least f(i) + S(i) in a sliding window, which a monotone
queue yields in constant time.  A window whose length is a power of two is
not padded, so those transitions (from half the width up) are looked up besides.

A partition is packed in runs of bounded size; the tail of a run that does not
fill a window is carried to the next, so only a partition's last window can
be short for want of documents.

Defined cases: a null or empty text is one end id; a null ``doc_id`` sorts
first; repeated rows are packed each, in an order that does not matter as
they are alike in ``doc_id``; a text longer than a window is cut; an empty
table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import bound_batches
from .common import slices
from .tokens import sentence_end_ids, vocabulary_json, worker_tokenizer

WIDTH = 4096
END_ID = 2
GAP = 32                       # least tokens between two sentence cuts, and between two forced cuts
SENTENCE_PENALTY = 16          # cost of a cut at a sentence end, in padded tokens
FORCED_PENALTY = 256           # cost of a cut inside a sentence
RUN_TOKENS = 1 << 20           # tokens packed at once

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType())])
_ARROW = pa.schema([(f.name, pa.int64()) for f in SCHEMA.fields])


def cut_places(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Cut places of a run (0 first, its length last) and their penalties.
    ``ends`` are the document ends, ``closing`` marks ids that end a sentence."""
    sentence = np.flatnonzero(closing[ids]) + 1
    # of sentence ends in one stretch of ``gap`` tokens the first counts
    if len(sentence):
        sentence = sentence[np.concatenate(([True], np.diff(sentence // gap) > 0))]
    soft = np.setdiff1d(sentence, ends, assume_unique=False)
    known = np.union1d(np.concatenate(([0], ends)), soft)
    holes = np.flatnonzero(np.diff(known) > 2 * gap)
    forced = [np.arange(known[h] + gap, known[h + 1] - gap // 2, gap) for h in holes]
    forced = np.concatenate(forced) if forced else np.zeros(0, np.int64)
    places = np.concatenate([known, forced])
    penalty = np.concatenate([np.where(np.isin(known, ends), 0, SENTENCE_PENALTY), np.full(len(forced), FORCED_PENALTY)])
    order = np.argsort(places, kind="stable")
    return places[order], penalty[order]


def best_windows(places: np.ndarray, penalty: np.ndarray, width: int = WIDTH) -> list[int]:
    """Cut places chosen by the dynamic program, the last place included."""
    n = len(places)
    powers = [p for p in (1 << k for k in range(width.bit_length())) if width // 2 <= p <= width]
    exact: dict[int, list[int]] = {}
    for p in powers:
        at = np.searchsorted(places, places - p)
        for j in np.flatnonzero((at < n) & (places[np.minimum(at, n - 1)] == places - p)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
    s, pen = places.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue = deque([(0, 0)])                        # (f(i) + S(i), i), increasing
    for j in range(1, n):
        here = s[j]
        while s[queue[0][1]] < here - width:
            queue.popleft()
        least, i = queue[0]
        value = least + width - here
        for k in exact.get(j, ()):                 # no padding at a power of two
            if cost[k] < value:
                value, i = cost[k], k
        cost[j] = value = value + pen[j]
        back[j] = i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(s[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents run by run."""

    def __init__(self, closing: np.ndarray, first_sequence: int, width: int = WIDTH, run_tokens: int = RUN_TOKENS):
        self.closing, self.width, self.run = closing, width, run_tokens
        self.sequence = first_sequence
        self.ids: list[np.ndarray] = []            # ids not packed yet
        self.docs: list[tuple] = []                # (doc_id, ids of it packed before, its ids in the run, all its ids)
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list]:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.waiting += len(ids)
        if self.waiting >= self.run:
            yield self.flush(last=False)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the run's windows; unless ``last``, the final window waits."""
        if not self.docs:
            return []
        ids = np.concatenate(self.ids)
        ends = np.cumsum([d[2] for d in self.docs])
        cuts = best_windows(*cut_places(ids, ends, self.closing), self.width)
        done = cuts if last else cuts[:-1]
        edges = np.array([0, *done])
        pieces = []
        # a piece is what lies between two neighbours of the window and document edges
        limit = int(edges[-1])
        bounds = np.union1d(edges, ends[ends < limit])
        window = np.searchsorted(edges, bounds[:-1], "right") - 1
        owner = np.searchsorted(ends, bounds[:-1], "right")
        starts = ends - [d[2] for d in self.docs]
        raw = ids.astype("<u4")
        for a, b, w, o in zip(bounds[:-1].tolist(), bounds[1:].tolist(), window.tolist(), owner.tolist()):
            doc_id, before, _, total = self.docs[o]
            pieces.append((doc_id, before + a - int(starts[o]), b - a, zlib.crc32(raw[a:b]), total,
                           self.sequence + w, a - int(edges[w])))
        self.sequence += len(done)
        kept = []
        for (doc_id, before, n, total), end in zip(self.docs, ends.tolist()):
            if end > limit:
                cut = max(0, limit - (end - n))
                kept.append((doc_id, before + cut, n - cut, total))
        self.docs, self.ids = kept, [ids[limit:]]
        self.waiting = len(ids) - limit
        return pieces


def pack(docs: DataFrame, vocabulary_path: str | None = None, width: int = WIDTH, end_id: int = END_ID,
         partitions: int | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  One shuffle, by ranges of ``doc_id``."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(vocabulary_json(vocabulary_path))      # a public file of 3 MB
    ends = sentence_end_ids(vocabulary.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        tokenizer = worker_tokenizer(vocabulary.value)
        closing = np.zeros(1 << 16, bool)
        closing[ends] = True
        packer = Packer(closing, TaskContext.get().partitionId() << 40, width)

        def out(pieces):
            columns = zip(*pieces) if pieces else [[]] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=_ARROW)
        try:
            for batch in batches:
                for part in slices(batch):
                    ids, offsets = tokenizer.encode(part.column("text"))
                    for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                        own = np.append(ids[offsets[k]:offsets[k + 1]], np.uint32(end_id))
                        for pieces in packer.add(doc_id, own):
                            yield out(pieces)
            yield out(packer.flush(last=True))
        finally:
            tokenizer.forget()              # the worker lives on beside other stages' tasks

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    ranged = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    return ranged.sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA)
