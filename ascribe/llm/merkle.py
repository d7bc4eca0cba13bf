"""Merkle manifest of a dataset as a content-addressed graph (operator 13).

Every row is a leaf: the SHA-256 of its columns, each ``-`` if null, else its
UTF-8 byte count, ``:`` and the value.  Per source, leaves ascend by
``doc_id``; every ``FAN`` consecutive nodes (the last run may be shorter, even
one) become the digest of their concatenated hex digests, level by level,
until one is left, the source's subroot.  The subroots, ordered by source, are
built up to the root in the same way.

The manifest stores digest-to-children records: the key is the digest, the
value its children's hex digests in one string, so a record proves itself.
Leaf requests descend from the root.  At each record the next digit of the
rank (base ``FAN``) picks the child to go on with; the digests left and right
of it are the path's next segment.  Requests below one node share its path, so
a step moves one row per node, not per request; the leaves meet their paths
only in the last step.  A path is the reversed list of segments.

Ranks need no task that sees a whole source: rows are dealt into sorted ranges
of (source, doc_id, leaf), counted per range, and numbered from the counts
before.

Defined cases: a null source is a source of its own, first in order; a null
``doc_id`` comes before all others and its row is never tampered with; rows
that repeat a source and ``doc_id`` are ordered by leaf digest, equal rows in
any order (their proofs hold for either); an empty table gives no leaves, no
records and no root; a null text stays null when tampered with; extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_scratch, materialize

FAN = 16
HEX = 64                       # characters of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """``leaves``: tree, rank, doc_id, leaf and what came with them;
    ``trees``: tree, tree_rank, height, subroot; ``records``: digest, children;
    ``root``: one row of root and height, none for an empty table."""

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: DataFrame


def encoded(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s), F.lit(":"), s))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the columns, each with its length."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def ranked(rows: DataFrame, tree: str | None, order: list[str], out: str) -> DataFrame:
    """``rows`` with their number from 0 in the order given, per tree (a column
    that may be null) or overall; every sorted range is numbered by itself."""
    keys = [tree] if tree else []
    placed = materialize(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                         .withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range"), *keys).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # one row per range and tree
    before = W.partitionBy(*keys or [F.lit(0)]).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = materialize(ranges.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_{k}") for k in keys],
                                     (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_base")), "bases")
    same = F.shiftright(placed["_at"], 33) == base["_of"]
    for k in keys:
        same = same & placed[k].eqNullSafe(base[f"_{k}"])
    return placed.join(base, same).withColumn(out, F.col("_at") + F.col("_base")).drop("_at", "_of", "_base", *[f"_{k}" for k in keys])


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From ``tree, rank, digest`` the records of each level (``tree, rank,
    digest, children``) and every tree's top (``tree, height, top``)."""
    sizes = materialize(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], []
    level = nodes.select("tree", "rank", "digest").join(
        sizes.select(F.col("tree").alias("_t"), "n"), F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")
    tops.append(level.where("n = 1").select("tree", F.lit(0).alias("height"), F.col("digest").alias("top")))
    while largest > 1:
        grouped = (level.where("n > 1").groupBy("tree", F.floor(F.col("rank") / FAN).alias("rank"))
                   .agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("_c"), F.first("n").alias("_n")))
        level = materialize(grouped.withColumn("children", F.array_join(F.transform("_c", lambda x: x["digest"]), ""))
                            .select("tree", "rank", F.sha2("children", 256).alias("digest"), "children",
                                    F.ceil(F.col("_n") / FAN).alias("n")), "level")
        levels.append(level)
        tops.append(level.where("n = 1").select("tree", F.lit(len(levels)).alias("height"), F.col("digest").alias("top")))
        largest = -(-largest // FAN)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, top


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", key: str = "doc_id",
                   carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``; ``carry`` adds columns to the leaves."""
    leaves = materialize(docs.select(F.col(tree).alias("tree"), F.col(key).alias("doc_id"),
                                     leaf_digest(*[F.col(f) for f in fields]).alias("leaf"),
                                     *[c.alias(name) for name, c in (carry or {}).items()]), "leaves")
    leaves = materialize(ranked(leaves, "tree", ["doc_id", "leaf"], "rank"), "ranked")
    levels, tops = build(leaves.select("tree", "rank", F.col("leaf").alias("digest")))
    trees = materialize(ranked(tops, None, ["tree"], "tree_rank"), "trees")
    subroots = materialize(trees.select(F.lit(0).alias("tree"), F.col("tree_rank").alias("rank"), F.col("top").alias("digest")), "subroots")
    above, root = build(subroots)
    records = None
    for level in levels + above:
        part = level.select("digest", "children")
        records = part if records is None else records.unionByName(part)
    if records is None:
        records = docs.sparkSession.createDataFrame([], "digest string, children string")
    records = materialize(records.dropDuplicates(["digest"]), "records")
    root = materialize(root.select(F.col("top").alias("root"), "height"), "root")
    drop_scratch(*levels, *above)
    return Manifest(leaves, trees.withColumnRenamed("top", "subroot"), records, root)


def segment(children: str, digit: str) -> Column:
    """The siblings of a child: the hex digests left and right of it."""
    return F.struct(F.expr(f"substring({children}, 1, {HEX} * cast({digit} as int))").alias("left"),
                    F.expr(f"substring({children}, {HEX} * cast({digit} as int) + {HEX} + 1)").alias("right"))


def descend(frontier: DataFrame, records: DataFrame, keep: list[str]) -> DataFrame:
    """One step down for the rows with levels left (``digest, prefix, path,
    left``): one row per child, its siblings added to the path."""
    return (frontier.where("left > 0").join(records, "digest")
            .select(*keep, "prefix", "path", "left", "children",
                    F.explode(F.sequence(F.lit(0), (F.length("children") / HEX).cast("int") - 1)).alias("digit"))
            .select(*keep, (F.col("prefix") * FAN + F.col("digit")).alias("prefix"),
                    F.expr(f"substring(children, {HEX} * digit + 1, {HEX})").alias("digest"),
                    F.concat("path", F.array(segment("children", "digit"))).alias("path"), (F.col("left") - 1).alias("left")))


_PATH = "cast(array() as array<struct<left:string,right:string>>)"


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves (all, or ``requests``: some rows of the manifest's leaves)
    with ``subroot, root`` and ``path``: the siblings of each level from the
    leaf's up to the root's.  With requests only nodes above them are visited."""
    _, trees, records, root = manifest
    leaves = manifest.leaves if requests is None else requests
    known = trees.select(F.col("tree").alias("_t"), "tree_rank", "height", "subroot")
    above = root.agg(F.max("height")).first()[0] or 0
    frontier = root.select(F.col("root").alias("digest"), "root", F.lit(0).cast("bigint").alias("prefix"),
                           F.expr(_PATH).alias("path"), F.col("height").alias("left"))
    for _ in range(above):
        frontier = descend(frontier, records, ["root"])
    # one row per tree
    frontier = frontier.select("root", "prefix", "path").join(known, F.col("prefix") == F.col("tree_rank"))
    if requests is not None:
        frontier = frontier.join(requests.select("tree").distinct(), F.col("_t").eqNullSafe(F.col("tree")), "left_semi")
    frontier = materialize(frontier.select(F.col("_t").alias("tree"), "root", "subroot", "path", F.col("subroot").alias("digest"),
                                           F.lit(0).cast("bigint").alias("prefix"), F.col("height").alias("left")), "paths")
    lowest = [frontier.where("left <= 1")]
    for depth in range(1, trees.agg(F.max("height")).first()[0] or 1):
        step = descend(frontier.where("left > 1"), records, ["tree", "root", "subroot"])
        if requests is not None:
            asked = (requests.join(known, requests["tree"].eqNullSafe(known["_t"])).where(F.col("height") > depth)
                     .select("_t", F.expr(f"cast(rank div cast(pow({FAN}, height - {depth}) as bigint) as bigint)").alias("_p")).distinct())
            step = step.join(asked, step["tree"].eqNullSafe(asked["_t"]) & (step["prefix"] == asked["_p"]), "left_semi")
        frontier = materialize(step, "paths")
        lowest.append(frontier.where("left <= 1"))
    parents = lowest[0]
    for part in lowest[1:]:
        parents = parents.unionByName(part)
    parents = parents.join(records, "digest", "left").select(
        F.col("tree").alias("_t"), "root", "subroot", "path", "prefix", "left", "children")
    # the last digit picks the leaf among its parent's children; a lone leaf is its tree's top, all ranks divide to 0
    placed = leaves.withColumn("_up", F.floor(F.col("rank") / FAN))
    found = placed.join(parents, placed["tree"].eqNullSafe(parents["_t"]) & (F.col("_up") == F.col("prefix")))
    last = F.when(F.col("left") > 0, F.array(segment("children", f"rank % {FAN}"))).otherwise(F.expr(_PATH))
    return (found.withColumn("path", F.reverse(F.concat("path", last)))
            .drop("_t", "_up", "prefix", "left", "children"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tampered_text(text: str = "text", key: str = "doc_id") -> Column:
    """The text with A-Z lower-cased in rows whose CRC-32 of the decimal id 5 divides."""
    picked = F.crc32(F.col(key).cast("string")) % 5 == 0
    return F.when(picked, F.translate(F.col(text), _UPPER, _LOWER)).otherwise(F.col(text))


def verify_tampering(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root and proof digest, and whether its
    possibly tampered text still folds up to the root."""
    # an untouched row's leaf is not computed again
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                     leaf_digest(*[tampered_text() if f == "text" else F.col(f) for f in FIELDS]))
    proofs = prove(build_manifest(docs, carry={"changed": changed}))
    return (proofs.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))
