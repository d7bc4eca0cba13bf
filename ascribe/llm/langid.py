"""Language identification by segmentation-marginalised unigrams (operator 1).

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word in a language is the sum over all its segmentations
into pieces of the product of their probabilities, computed by a forward
algorithm; a text's log-probability is the sum over its words.  The piece
probabilities are trained by expectation-maximisation: a forward-backward pass
gives every piece's expected count over all segmentations.

Training reads a bounded sample of labelled documents, at most
``per_language`` of each language by a hash of ``doc_id``, whole texts.  The
sample's word counts are a distributed table, each step sums expected counts
by (language, piece), and what is collected has languages x vocabulary
numbers at most.  Prediction is one pass over all documents.

Defined cases: a null text or one without a letter is ``und`` with score 0; a
null ``lang`` is not learned from; a null ``doc_id`` is held out of learning
(its remainder is unknown, so ``held_out`` is false); equal scores go to the
first language by name; without any labelled row every text is ``und``;
repeated rows are predicted each; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_scratch, materialize
from .common import slices

UNKNOWN = "und"
VOCABULARY = "piece_bpe_32k.model"
PER_LANGUAGE = 1000            # labelled documents that are learned from, per language
RANGE_BITS = 12                # ranges of the hash (as a power of two) that are counted to find the sample
STEPS = 4                      # EM steps
SMOOTH = 0.01                  # pseudo-count of every piece
LONG_WORD = 40                 # longer words are summed in log space from the start
TINY = 1e-250                  # so are words whose product of probabilities comes near the least number
KNOWN_WORDS = 400_000          # words whose scores a worker keeps; beyond that it starts anew
MARK = "▁"                # word start, as the vocabulary writes it

_LETTERS = re.compile(r"[^\W\d_]+")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces of the public vocabulary that are letters with or without a word start."""
    import sentencepiece
    from .tokens import vocabulary_path
    sp = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path(VOCABULARY))
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in pieces if (core := p.removeprefix(MARK)) and core.isalpha())


def words_in(text: str) -> list[str]:
    """Lower-case letter runs with the word-start mark."""
    runs = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return [MARK + w for w in runs]
    # the pattern also takes numbers that are no digits, such as ² and ½
    return [MARK + w for run in runs for w in (run if run.isalpha() else "".join(c if c.isalpha() else " " for c in run)).split()]


class PieceModel:
    """``table[piece]`` holds the piece's probability in every language; a
    character outside the vocabulary is a piece with the last row's."""

    def __init__(self, pieces: list[str], table: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.table = table
        self.other = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def spans(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end, the (start, piece) that can come last; the mark is never a piece alone."""
        get, n = self.index.get, len(word)
        first = 1 if word[0] == MARK else 0
        out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            if start == first == 1:
                continue                                # the first piece starts at the mark
            for end in range(start + 1 + (first if start == 0 else 0), min(n, start + max(self.longest, 2)) + 1):
                piece = get(word[start:end])
                if piece is not None:
                    out[end].append((start, piece))
                elif end == start + 1 + (first if start == 0 else 0):
                    out[end].append((start, self.other))
        return out

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Forward algorithm over many words at once: log of the sum over all
        segmentations, one row per word and one column per language."""
        out = np.zeros((len(words), self.table.shape[1]))
        table = np.concatenate([self.table, np.zeros((1, self.table.shape[1]))])    # last row: no such piece
        none, get = len(table) - 1, self.index.get
        alike: dict[tuple[int, int], list[int]] = {}
        for k, w in enumerate(words):
            alike.setdefault((len(w), int(w[0] == MARK)), []).append(k)
        longest = max(self.longest, 2)                  # a mark with a character outside the vocabulary
        with np.errstate(divide="ignore"):
            logs = np.log(table)
        for (n, first), rows in alike.items():
            own = [words[k] for k in rows]
            if n > LONG_WORD + 1:
                out[rows] = np.maximum(self._long(own, n, first, logs, longest), -1e300)
                continue
            alpha: list = [None] * (n + 1)
            alpha[0] = np.ones((len(own), self.table.shape[1]))
            for end in range(1 + first, n + 1):
                total = np.zeros_like(alpha[0])
                for start in range(max(0, end - longest), end):
                    if start == first == 1:
                        continue                        # the first piece starts at the mark
                    default = self.other if end - start == 1 + (first if start == 0 else 0) else none
                    pieces = np.fromiter((get(w[start:end], default) for w in own), np.int64, len(own))
                    total += alpha[start] * table[pieces]
                alpha[end] = total
            out[rows] = np.log(np.maximum(alpha[n], 1e-300))
            small = np.flatnonzero((alpha[n] < TINY).any(axis=1))
            if len(small):
                far = self._long([own[k] for k in small], n, first, logs, longest)
                out[[rows[k] for k in small]] = np.maximum(far, -1e300)
        return out

    def _long(self, own: list[str], n: int, first: int, logs: np.ndarray, longest: int) -> np.ndarray:
        """The forward algorithm of words of length ``n`` in log space; only
        the places that a piece can start at are kept."""
        get, none = self.index.get, len(logs) - 1
        alpha = {0: np.zeros((len(own), logs.shape[1]))}
        for end in range(1 + first, n + 1):
            total = np.full_like(alpha[max(alpha)], -np.inf)
            for start in range(max(0, end - longest), end):
                if start not in alpha:
                    continue
                default = self.other if end - start == 1 + (first if start == 0 else 0) else none
                pieces = [get(w[start:end], default) for w in own]
                if any(k != none for k in pieces):
                    total = np.logaddexp(total, alpha[start] + logs[pieces])
            alpha[end] = total
            alpha.pop(end - longest, None)
        return alpha[n]

    def _expected_long(self, word: str, language: int) -> dict[int, float]:
        """``expected`` in log space."""
        with np.errstate(divide="ignore"):
            p = np.log(self.table[:, language])
        spans, n = self.spans(word), len(word)
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for end in range(1, n + 1):
            if spans[end]:
                alpha[end] = np.logaddexp.reduce([alpha[s] + p[k] for s, k in spans[end]])
        for end in range(n, 0, -1):
            for s, k in spans[end]:
                beta[s] = np.logaddexp(beta[s], beta[end] + p[k])
        out: dict[int, float] = {}
        if np.isfinite(alpha[n]):
            for end in range(1, n + 1):
                for s, k in spans[end]:
                    if (c := float(np.exp(alpha[s] + p[k] + beta[end] - alpha[n]))) > 0:
                        out[k] = out.get(k, 0.0) + c
        return out

    def expected(self, word: str, language: int) -> dict[int, float]:
        """Forward-backward: expected count of each piece in one language."""
        if len(word) > LONG_WORD + 1:
            return self._expected_long(word, language)
        p, spans, n = self.table[:, language], self.spans(word), len(word)
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = beta[n] = 1.0
        for end in range(1, n + 1):
            alpha[end] = sum(alpha[s] * p[k] for s, k in spans[end])
        if alpha[n] < TINY:
            return self._expected_long(word, language)
        for end in range(n, 0, -1):
            for s, k in spans[end]:
                beta[s] += beta[end] * p[k]
        out: dict[int, float] = {}
        if alpha[n] > 0:
            for end in range(1, n + 1):
                for s, k in spans[end]:
                    if (c := alpha[s] * p[k] * beta[end] / alpha[n]) > 0:
                        out[k] = out.get(k, 0.0) + c
        return out


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The labelled rows that are learned from.  The first ``per_language`` by
    hash are found on ids alone; each task keeps no more than that per language."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text", "doc_id").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    # counts by range of the hash say up to which range the first rows reach; only those are numbered
    place = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    sizes = place.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("lang").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    last = (sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_language)
            .groupBy("lang").agg(F.max("range").alias("last")))
    last = materialize(last.select(F.col("lang").alias("l"), "last"), "lang_ranges")
    order = W.partitionBy("lang").orderBy("h", "doc_id")
    ids = (place.join(last, (F.col("lang") == F.col("l")) & (F.col("range") <= F.col("last")))
           .withColumn("place", F.row_number().over(order))
           .where(F.col("place") <= per_language).select(F.col("doc_id").alias("id")).distinct())
    return rows.join(ids, F.col("doc_id") == F.col("id"), "left_semi").select("lang", "text")


def train(docs: DataFrame, vocabulary_path: str | None = None, per_language: int = PER_LANGUAGE,
          steps: int = STEPS) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Languages, pieces, the table of piece probabilities and the languages' log shares."""
    spark = docs.sparkSession
    pieces = vocabulary(vocabulary_path)
    count_schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        for batch in batches:
            for part in slices(batch):
                seen: Counter = Counter()
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    seen.update((lang, w) for w in words_in(text))
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                                  pa.array([seen[k] for k in keys], pa.int64())], schema=count_schema)
    words = materialize(sample(docs, per_language).mapInArrow(count, "lang string, word string, n bigint")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang_words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    if not languages:
        return [], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0)
    place = {name: i for i, name in enumerate(languages)}
    size = len(pieces) + 1
    table = np.full((size, len(languages)), 1.0 / size)
    expect_schema = pa.schema([("language", pa.int32()), ("piece", pa.int32()), ("c", pa.float64())])
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(table)                # languages x vocabulary

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = PieceModel(pieces, shared.value)
            sums: dict[tuple[int, int], float] = {}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    k = place[lang]
                    for piece, c in model.expected(word, k).items():
                        sums[k, piece] = sums.get((k, piece), 0.0) + n * c
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                              pa.array([sums[k] for k in keys], pa.float64())], schema=expect_schema)
        got = (words.mapInArrow(expect, "language int, piece int, c double").groupBy("language", "piece")
               .agg(F.sum("c").alias("c")).collect())
        table = np.full((size, len(languages)), SMOOTH)
        for r in got:
            table[r["piece"], r["language"]] += r["c"]
        table /= table.sum(axis=0)
        shared.unpersist()
    drop_scratch(words)
    # languages are taken as equally likely beforehand: labels' shares say little about other corpora
    return languages, pieces, table, np.zeros(len(languages))


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document; only the text decides."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    arrow = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, table, prior = shared.value
        scorer = PieceModel(pieces, table)
        place: dict[str, int] = {}
        scores = np.zeros((1 << 14, len(languages)))
        for batch in batches:
            for part in slices(batch):
                words = [words_in(t) if t else [] for t in part.column("text").to_pylist()]
                if len(place) > KNOWN_WORDS:
                    place.clear()
                new = [w for w in {w for ws in words for w in ws} if w not in place]
                if new:
                    k = len(place)
                    while k + len(new) > len(scores):
                        scores = np.concatenate([scores, np.zeros_like(scores)])
                    scores[k:k + len(new)] = scorer.log_probabilities(new)
                    place.update(zip(new, range(k, k + len(new))))
                names, values = [], []
                for ws in words:
                    if not ws or not languages:
                        names.append(UNKNOWN)
                        values.append(0.0)
                        continue
                    total = prior + scores[np.fromiter(map(place.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    best = int(np.argmax(total))
                    names.append(languages[best])
                    values.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()),
                                                  pa.array(values, pa.float64())], schema=arrow)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocabulary_path: str | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, train(docs, vocabulary_path, per_language))
