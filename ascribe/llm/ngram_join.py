"""Exact Jaccard join on word n-grams with a vertically partitioned order (operator 9).

Every document is the set of its distinct k-word shingles (ASCII lower-cased;
64-bit names).  All shingles stand in one global order: the rarer first, by a
count sketch over all documents, ties by name.  Two sets that reach the
threshold t share a shingle among the first |x| - ceil(t |x|) + 1 of each, so

1. documents with equal sets are folded into classes;
2. only these first shingles are dealt out; a shingle that one class holds
   goes no further;
3. in each shingle's bucket, every member is paired with two leaders, not with
   all others, when the places of the shingle in both sets still allow the
   threshold, and the sizes of many small cells of the sets (cut by name) add
   up to a large enough bound of the overlap;
4. the global order is cut at fixed places into fragments, and every set into
   one row per fragment; the pairs are joined with the rows of a fragment, each
   (pair, fragment) gives a partial overlap, and these are summed per pair;
5. linked documents form components.  Pairs inside one component need no
   check.  The pairs of a bucket across components are counted the same way,
   and the components joined up.  They are found by joining the members outside
   the bucket's main component with all; where these are more than ``OUTSIDE``,
   by joining the bucket's members on whole cells of their sets, in one of which
   linked sets agree, if they meet far less often that way.  This last round covers every pair that is left, so the
   components are those of all links.

Defined cases: a null or empty text has no shingles and links with nothing;
fewer than k words make one shingle of them all; a null ``doc_id`` links with
nothing and has no component; a repeated ``doc_id`` is one document in the
links, with the set of one of its rows, and one row each in the result; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import bound_batches, drop_scratch, materialize
from .common import Words, combine, mix, signed, slices, windows
from .components import components

K = 3
PERCENT = 90
SKETCH = 1 << 20               # counters of the count sketch: 4 MB, whatever the corpus
SKETCH_PARTS = 16              # pieces that a sketch travels in
FRAGMENTS = 4                  # fragments of the global order
CELLS = 128                    # cells of a set whose sizes bound overlaps
OUTSIDE = 64                   # members outside a bucket's main component that meet all others of it
BITS = 1 << 23                 # bits of the id bitmap: 1 MB, whatever the corpus


def shingle_sets(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle names of each row, sorted by (row, name), and their rows."""
    words = Words(texts, lower=True)
    h = words.hashes()
    names, doc = windows(h, words, k)
    few = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(few):
        short = []
        for d in few.tolist():
            own = h[words.first[d]:words.first[d + 1]]
            name = own[:1]
            for i in range(1, len(own)):
                name = combine(name, own[i:i + 1], i)
            short.append(mix(name ^ np.uint64(len(own))))
        names, doc = np.concatenate([names, *short]), np.concatenate([doc, few])
    order = np.lexsort((names, doc))
    names, doc = names[order], doc[order]
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    return names[first], doc[first]


def set_names(names: np.ndarray, doc: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each row's set and its 128-bit name (two sums of scrambled members)."""
    size = np.bincount(doc, minlength=rows)
    at = np.concatenate(([0], np.cumsum(size)))
    parts = []
    with np.errstate(over="ignore"):
        for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(names + salt), dtype=np.uint64)))
            parts.append(signed(sums[at[1:]] - sums[at[:-1]]))
    return size, parts[0], parts[1]


def cell_sizes(names: np.ndarray, doc: np.ndarray, rows: int) -> pa.Array:
    """How many members of each row's set lie in each cell (by the name's upper bits)."""
    cell = (names >> np.uint64(64 - (CELLS - 1).bit_length())).astype(np.int64)
    sizes = np.bincount(doc * CELLS + cell, minlength=rows * CELLS).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * CELLS), pa.array(sizes))


def sketch_slot(names: np.ndarray) -> np.ndarray:
    return (mix(names ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(SKETCH - 1)).astype(np.int64)


def ordered(names: np.ndarray, doc: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's names in the global order; their places in it, and in the row."""
    rank = sketch[sketch_slot(names)]
    order = np.lexsort((names, rank, doc))
    names, doc, rank = names[order], doc[order], rank[order]
    size = np.bincount(doc, minlength=int(doc[-1]) + 1 if len(doc) else 0)
    start = np.cumsum(size) - size
    return names, doc, np.arange(len(names)) - start[doc]


def _members(docs: DataFrame, k: int) -> DataFrame:
    """One pass over all texts: a row per document (size and name of its set, sizes of its cells)
    and, per task, the pieces of its count sketch (null ``slot`` marks a document)."""
    schema = "doc_id bigint, key bigint, n int, a bigint, b bigint, cells array<int>, slot int, counts binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("b", pa.int64()),
                       ("cells", pa.list_(pa.int32())), ("slot", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for part in slices(batch):
                names, doc = shingle_sets(part.column("text"), k)
                size, a, b = set_names(names, doc, part.num_rows)
                counts += np.bincount(sketch_slot(names), minlength=SKETCH)
                none = pa.nulls(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(size.astype(np.int32)), pa.array(a),
                                                  pa.array(b), cell_sizes(names, doc, part.num_rows),
                                                  none.cast(pa.int32()), none.cast(pa.binary())], schema=arrow)
        pieces = [p.astype("<u4").tobytes() for p in np.array_split(np.minimum(counts, 0xFFFFFFFF), SKETCH_PARTS)]
        none = pa.nulls(SKETCH_PARTS)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()),
                                          none.cast(pa.int64()), none.cast(pa.list_(pa.int32())),
                                          pa.array(range(SKETCH_PARTS), pa.int32()),
                                          pa.array(pieces, pa.binary())], schema=arrow)
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text", "xxhash64(text) key").mapInArrow(run, schema)


def _sketch(members: DataFrame) -> np.ndarray:
    """The tasks' sketches added up: by piece and a salt first, then by piece.
    The result has SKETCH counters and is the only thing collected."""
    def add(pdf):
        import pandas as pd
        total = sum(np.frombuffer(c, "<u4").astype(np.int64) for c in pdf["counts"])
        return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "salt": 0,
                             "counts": [np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()]})
    schema = "slot int, salt int, counts binary"
    pieces = members.where("slot is not null").select("slot", (F.spark_partition_id() % 32).alias("salt"), "counts")
    once = pieces.groupBy("slot", "salt").applyInPandas(add, schema)
    rows = once.groupBy("slot").applyInPandas(add, schema).collect()
    return np.concatenate([np.frombuffer(r["counts"], "<u4") for r in sorted(rows, key=lambda r: r["slot"])])


def _postings(docs: DataFrame, sketch, k: int, percent: int) -> DataFrame:
    """The first shingles of every document in the global order: (shingle, doc_id, n, pos)."""
    arrow = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                names, doc, pos = ordered(*shingle_sets(part.column("text"), k), sketch.value)
                size = np.bincount(doc, minlength=part.num_rows)
                reach = size - (percent * size + 99) // 100 + 1
                take = pos < reach[doc]
                ids = part.column("doc_id").take(pa.array(doc[take]))
                yield pa.RecordBatch.from_arrays([pa.array(signed(names[take])), ids, pa.array(size[doc[take]].astype(np.int32)),
                                                  pa.array(pos[take].astype(np.int32))], schema=arrow)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null")
    return rows.mapInArrow(run, "shingle bigint, doc_id bigint, n int, pos int")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """BITS bits, those set that some id hashes to; at most BITS / 64 rows are collected."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    rows = ids.groupBy((slot / 64).cast("bigint").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))")).alias("bits")).collect()
    words = np.zeros(BITS // 64, np.int64)
    for r in rows:
        words[r["w"]] = r["bits"]
    return words


def _segments(docs: DataFrame, wanted: DataFrame, sketch, k: int, fragments: int) -> DataFrame:
    """The wanted documents' sets, cut into fragments of the global order: one
    row (fragment, doc_id, a, names) for each fragment that a set reaches into.
    The cuts are quantiles of the sketch, so fragments are about equally full.

    A bitmap of the wanted ids spares the tasks most other documents; it has a
    fixed size and only saves work, the join decides."""
    spark = docs.sparkSession
    counts = np.sort(sketch.value)
    mass = np.cumsum(counts.astype(np.float64))
    cuts = np.array([counts[min(len(counts) - 1, np.searchsorted(mass, mass[-1] * f / fragments))] for f in range(1, fragments)])
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))
    arrow = pa.schema([("fragment", pa.int32()), ("doc_id", pa.int64()), ("a", pa.int64()), ("names", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            hit = (bitmap.value[(h % BITS) // 64] >> (h % 64)) & 1
            batch = batch.filter(pa.array(hit.astype(bool)))
            for part in slices(batch):
                names, doc = shingle_sets(part.column("text"), k)
                _, a, _ = set_names(names, doc, part.num_rows)
                piece = np.searchsorted(cuts, sketch.value[sketch_slot(names)], "right")
                for i in range(fragments):
                    own = piece == i
                    size = np.bincount(doc[own], minlength=part.num_rows)
                    held = np.flatnonzero(size)
                    ends = np.concatenate(([0], np.cumsum(size[held]))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(held), i, np.int32)), part.column("doc_id").take(pa.array(held)), pa.array(a[held]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(names[own])))], schema=arrow)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    out = rows.mapInArrow(run, "fragment int, doc_id bigint, a bigint, names array<bigint>")
    # of a repeated doc_id, the set that stands for it
    return out.join(wanted, ["doc_id", "a"], "left_semi").dropDuplicates(["doc_id", "a", "fragment"])


def _allowed(n: Column, pos: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Whether two sets of n and n2 shingles whose first common one stands at
    pos and pos2 can still reach the threshold (integer arithmetic)."""
    most = 1 + F.least(n - pos, n2 - pos2) - 1
    return ((100 * F.least(n, n2) >= percent * F.greatest(n, n2))
            & ((100 + percent) * most >= percent * (n + n2)))


def _possible(pairs: DataFrame, members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs whose cells could hold a large enough overlap: in no cell can
    it be larger than the smaller of both sizes.  Drops no link; most pairs
    that meet in a common shingle by chance go here, before any set is moved."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    own = known.join(ids, "doc_id", "left_semi")
    cells = members.select("doc_id", "a", "cells").join(own, ["doc_id", "a"], "left_semi").dropDuplicates(["doc_id", "a"])
    cells = materialize(cells, "cells")
    left = cells.select(F.col("doc_id").alias("u"), F.col("cells").alias("x"))
    right = cells.select(F.col("doc_id").alias("v"), F.col("cells").alias("y"))
    most = F.aggregate(F.zip_with("x", "y", lambda c, d: F.least(c, d)), F.lit(0), lambda total, c: total + c)
    bound = pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", most.alias("most"))
    out = materialize(bound.where((100 + percent) * F.col("most") >= percent * (F.col("nu") + F.col("nv"))).drop("most"), "possible")
    drop_scratch(cells)
    return out


def _linked(docs: DataFrame, pairs: DataFrame, known: DataFrame, sketch, k: int, percent: int, fragments: int) -> DataFrame:
    """The pairs (u, v) that reach the threshold.  Each pair meets the rows of
    one fragment at a time: a partial count per (pair, fragment), which are
    summed per pair.  A pair with nothing in common has no row and no link."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select(F.col("v").alias("doc_id"))).distinct()
    wanted = materialize(known.join(ids, "doc_id", "left_semi").select("doc_id", "a"), "wanted")
    rows = materialize(_segments(docs, wanted, sketch, k, fragments), "segments")
    left = rows.select("fragment", F.col("doc_id").alias("u"), F.col("names").alias("x"))
    right = rows.select("fragment", F.col("doc_id").alias("v"), F.col("names").alias("y"))
    # both ends meet the rows by (id, fragment), so these are dealt out once for both
    each = pairs.withColumn("fragment", F.explode(F.array(*[F.lit(i) for i in range(fragments)])))
    partial = each.join(left, ["u", "fragment"]).join(right, ["v", "fragment"]).select(
        "u", "v", "nu", "nv", F.size(F.array_intersect("x", "y")).alias("part"))
    total = partial.groupBy("u", "v", "nu", "nv").agg(F.sum("part").alias("common"))
    out = materialize(total.where(100 * F.col("common") >= percent * (F.col("nu") + F.col("nv") - F.col("common"))).select("u", "v"),
                      "links")
    drop_scratch(rows, wanted)
    return out


def _edges(percent: int) -> np.ndarray:
    """Lower ends of size classes: a set and another up to 100 / percent times
    as large lie in one class or in neighbouring ones."""
    if percent >= 100:
        return np.array([1, 1 << 31], np.int64)
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


def signatures(names: np.ndarray, doc: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the cells of each row's set (names sorted within rows), and their rows.

    Two sets of n <= m members that reach the threshold differ in at most
    n (100 - percent) / percent members.  Cut into one cell more than that, they
    agree in a whole cell.  The number of cells follows from the class of the
    smaller set, so a set is cut for its own class and for the one below."""
    edges = _edges(percent)
    cells = (edges[1:] - 1) * (100 - percent) // percent + 1
    size = np.bincount(doc, minlength=rows)
    own = np.searchsorted(edges, size, "right") - 1
    scrambled = mix(names + np.uint64(0x9E3779B97F4A7C15))
    out, of = [], []
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(scrambled, dtype=np.uint64)))
        for below in (0, 1):
            cls = own - below
            count = np.where((size > 0) & (cls >= 0), cells[np.maximum(cls, 0)], 0)
            first = np.cumsum(count) - count
            row = np.repeat(np.arange(rows), count)
            held = count[doc] > 0
            # names are uniform, and their order is that of the cells: each cell is one stretch
            cell = ((names >> np.uint64(32)) * count[doc].astype(np.uint64)) >> np.uint64(32)
            filled = np.bincount(first[doc[held]] + cell[held].astype(np.int64), minlength=len(row))
            skipped = np.searchsorted(doc, row, "left")        # members of rows before this one
            within = np.cumsum(filled) - filled - np.repeat((np.cumsum(filled) - filled)[first[count > 0]], count[count > 0])
            at = skipped + within
            content = sums[at + filled] - sums[at]
            place = (cls[row].astype(np.uint64) << np.uint64(32)) + (np.arange(len(row)) - first[row]).astype(np.uint64)
            out.append(mix(content ^ mix(place)))
            of.append(row)
    return np.concatenate(out), np.concatenate(of)


def _signatures(docs: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """(shingle, doc_id): the cells of the wanted documents' sets, in place of shingles."""
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))
    arrow = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            hit = (bitmap.value[(h % BITS) // 64] >> (h % 64)) & 1
            for part in slices(batch.filter(pa.array(hit.astype(bool)))):
                names, doc = shingle_sets(part.column("text"), k)
                _, a, _ = set_names(names, doc, part.num_rows)
                cell, row = signatures(names, doc, part.num_rows, percent)
                yield pa.RecordBatch.from_arrays([pa.array(signed(cell)), part.column("doc_id").take(pa.array(row)), pa.array(a[row])],
                                                 schema=arrow)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    out = rows.mapInArrow(run, "shingle bigint, doc_id bigint, a bigint")
    return out.join(wanted, ["doc_id", "a"], "left_semi").select("shingle", "doc_id").distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """Buckets that hold several components: (shingle, main, outside, total),
    the component with most members, the number of members outside it, and of all."""
    by = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("c"))
    return (by.groupBy("shingle").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("total"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("shingle", F.col("m.component").alias("main"), (F.col("total") - F.col("m.c")).alias("outside"), "total"))


def _fewer(some: DataFrame, others: DataFrame) -> bool:
    """Whether some buckets' members across components meet less than a tenth as often as
    others'.  Places thin out the meetings of the latter (shingles), not of the former (cells)."""
    meet = F.coalesce(F.sum(F.col("outside").cast("double") * F.col("total")), F.lit(0.0))
    return 10 * some.agg(meet).first()[0] < others.agg(meet).first()[0]


def _across(placed: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Allowed pairs (u, v, nu, nv) of the buckets' members across components."""
    mixed = placed.join(buckets.select("shingle", "main"), "shingle")
    other = mixed.where(F.col("component") != F.col("main")).select(
        "shingle", F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("component").alias("c2"))
    return (mixed.join(other, (mixed["shingle"] == other["shingle"]) & (F.col("component") != F.col("c2"))
                       & _allowed(F.col("n"), F.col("pos"), F.col("n2"), F.col("p2"), percent))
            .select(F.least("doc_id", "d2").alias("u"), F.greatest("doc_id", "d2").alias("v"),
                    F.when(F.col("doc_id") < F.col("d2"), F.col("n")).otherwise(F.col("n2")).alias("nu"),
                    F.when(F.col("doc_id") < F.col("d2"), F.col("n2")).otherwise(F.col("n")).alias("nv")).distinct())


def _left_over(docs: DataFrame, placed: DataFrame, known: DataFrame, k: int, percent: int) -> DataFrame:
    """Every pair across components that may still be a link, from ``placed``
    (shingle, doc_id, n, pos, component).  In buckets with at most ``OUTSIDE``
    members outside the main component these meet all members, so pairs grow
    with the bucket.  The members of larger buckets are also dealt out by the
    cells of their sets, in one of which linked sets agree: unrelated texts with
    a common shingle part there, while groups just below the threshold meet in
    many cells.  Both ways find every link; cells are taken where they make
    meetings, counted from the sizes of the buckets, far fewer."""
    buckets = materialize(_mixed(placed), "buckets")
    large = buckets.where(F.col("outside") > OUTSIDE)
    wide = materialize(placed.join(large, "shingle", "left_semi").select("doc_id", "n", "component").distinct(), "wide")
    if wide.isEmpty():
        return _across(placed, buckets, percent)
    wanted = materialize(known.join(wide, "doc_id", "left_semi").select("doc_id", "a"), "wanted")
    cells = materialize(_signatures(docs, wanted, k, percent).join(wide, "doc_id").withColumn("pos", F.lit(0)), "cells")
    agreed = materialize(_mixed(cells), "agreed")
    if not _fewer(agreed, large):
        return _across(placed, buckets, percent)
    return _across(placed, buckets.where(F.col("outside") <= OUTSIDE), percent).union(_across(cells, agreed, percent)).distinct()


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id,
    class_id`` (smallest id with the same set), ``key`` (of the row's text),
    ``a`` and ``b`` (name of its set)."""
    spark = docs.sparkSession
    bound_batches(spark)
    both = materialize(_members(docs, k), "members")
    sketch = spark.sparkContext.broadcast(_sketch(both))            # SKETCH counters, 4 MB
    members = both.where("slot is null").select("doc_id", "key", "n", "a", "b", "cells")
    # one set per document id, one class per set
    single = members.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(F.struct("a", "b", "n")).alias("s")).select(
        "doc_id", "s.a", "s.b", "s.n")
    classes = single.groupBy("a", "b", "n").agg(F.min("doc_id").alias("class_id"))
    reps = materialize(classes, "classes")
    in_class = materialize(single.join(reps, ["a", "b", "n"]).select("doc_id", "class_id"), "in_class")
    known = reps.select(F.col("class_id").alias("doc_id"), "a")

    first = materialize(_postings(docs, sketch, k, percent), "postings")
    held = first.groupBy("shingle").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = materialize(first.join(held.select("shingle"), "shingle", "left_semi")
                         .join(known.select("doc_id"), "doc_id", "left_semi"), "shared")
    drop_scratch(first)
    if shared.isEmpty():
        comp = known.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    else:
        # round 1: each member with its bucket's leaders.  The one with the fewest rarer shingles before the
        # bucket's differs least from what the members have in common; the other has the smallest id.
        leader = shared.groupBy("shingle").agg(F.array(F.min(F.struct("pos", "doc_id", "n")), F.min(F.struct(
            F.lit(-1).alias("pos"), "doc_id", "n"))).alias("l"), F.min(F.struct("doc_id", "pos")).alias("first"))
        leader = leader.select("shingle", F.explode("l").alias("l"), "first").select(
            "shingle", F.col("l.doc_id").alias("d2"), F.col("l.n").alias("n2"),
            F.when(F.col("l.pos") >= 0, F.col("l.pos")).otherwise(F.col("first.pos")).alias("p2"))
        star = (shared.join(leader, "shingle").where(F.col("doc_id") != F.col("d2"))
                .where(_allowed(F.col("n"), F.col("pos"), F.col("n2"), F.col("p2"), percent))
                .select(F.col("doc_id").alias("u"), F.col("d2").alias("v"), F.col("n").alias("nu"), F.col("n2").alias("nv")).distinct())
        star = _possible(materialize(star, "star"), members, known, percent)
        links = _linked(docs, star, known, sketch, k, percent, fragments)
        comp = components(links)
        # round 2: what is left in buckets that still hold several components
        placed = materialize(shared.join(comp, shared["doc_id"] == comp["node"], "left")
                             .withColumn("component", F.coalesce("component", "doc_id")).drop("node"), "placed")
        rest = _left_over(docs, placed, known, k, percent)
        rest = _possible(materialize(rest, "rest"), members, known, percent)
        if not rest.isEmpty():
            more = _linked(docs, rest, known, sketch, k, percent, fragments)
            if not more.isEmpty():
                comp = components(links.union(more))
    placed_class = in_class.join(comp, in_class["class_id"] == comp["node"], "left").select(
        F.col("doc_id").alias("d"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = members.select("doc_id", "key", "a", "b", F.col("n").cast("bigint").alias("n_shingles")).join(
        placed_class, F.col("doc_id") == F.col("d"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce("class_id", "doc_id").alias("class_id"), "key", "a", "b")


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with its smallest id, and every
    document without an id or shingles; all columns kept, whatever their names.
    Of rows that repeat an id, only those with the set that stands for the id
    go with it; another text stays."""
    found = materialize(near_duplicates(docs, k, percent), "near")
    gone = found.where((F.col("component_id") != F.col("doc_id")) & (F.col("n_shingles") > 0))
    stands = gone.groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("s")).select(F.col("doc_id").alias("d"), "s.*")
    drop = gone.join(stands, (gone["doc_id"] == stands["d"]) & (gone["a"] == stands["a"]) & (gone["b"] == stands["b"]), "left_semi")
    drop = drop.select(F.col("doc_id").alias("id"), F.col("key").alias("other")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("own"), F.xxhash64("text").alias("mine"))
    return rows.join(drop, (F.col("own") == F.col("id")) & (F.col("mine") == F.col("other")), "left_anti").select("row.*")
