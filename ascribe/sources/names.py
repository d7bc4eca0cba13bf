"""Name dictionaries and prompt libraries as nested JSON -> rows.

Nested dictionaries are parsed with ``from_json`` into maps and flattened
with ``explode`` / ``posexplode``; nothing is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stats import top_k_per_group
from ..schemas import OPTION_KEYS, raw_template_schema

BLOCK = 20                               # names per generated dictionary document
STRETCH = 1000                           # blocks numbered in one window
ALLOWED_DOMAINS = ["src0", "src1", "src2"]

SHARD = 8                                # prompts per library document

FLAT_NAMES = "map<string,map<string,array<string>>>"
IRREGULAR = "map<string,map<string,string>>"     # inner level kept raw: depth 2 or 3


def read_templates(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """A JSON array of template records (one multi-line file each), read
    whole, parsed with an explicit schema; ``template_id`` is the stable
    position in the array."""
    arr = f"array<{raw_template_schema(mode).simpleString()}>"
    doc = spark.read.text(path, wholetext=True)
    return (doc.select(F.posexplode(F.from_json("value", arr)).alias("template_id", "_t"))
            .select(F.col("template_id").cast("bigint"), "_t.*"))


def name_documents(names: DataFrame) -> DataFrame:
    """Nested ``{nationality: {Gender: [names]}}`` JSON documents, one per
    (nationality, gender, block of BLOCK customer keys): every list is bounded."""
    g = (names.withColumn("block", (F.col("c_custkey") / BLOCK).cast("bigint"))
         .groupBy("nationality", "gender", "block")
         .agg(F.array_sort(F.collect_list(F.struct("c_custkey", "name"))).alias("_l")))
    doc = F.to_json(F.create_map(F.col("nationality"),
                                 F.create_map(F.initcap(F.col("gender")),
                                              F.transform("_l", lambda x: x["name"]))))
    return g.select("block", doc.alias("doc"))


def flatten_names(docs: DataFrame, col: str = "doc", extra=()) -> DataFrame:
    """S2 + F6: ``map<nationality, map<gender, array<name>>>`` JSON -> rows
    ``(nationality, gender, name_ord, name)``, gender keys lower-cased."""
    m = docs.select(*extra, F.from_json(F.col(col), FLAT_NAMES).alias("_m"))
    a = m.select(*extra, F.explode("_m").alias("nationality", "_g"))
    b = a.select(*extra, "nationality", F.explode("_g").alias("gender", "_names"))
    c = b.select(*extra, "nationality", F.lower("gender").alias("gender"),
                 F.posexplode("_names").alias("name_ord", "name"))
    return c.withColumn("name_ord", F.col("name_ord").cast("bigint"))


def number_names(flat: DataFrame) -> DataFrame:
    """``flat`` (block, nationality, gender, name_ord, name) with ``name_ord``
    running over all blocks of a (nationality, gender) list.  Windows run over
    names per block only, within stretches of STRETCH blocks and over those."""
    keys = ["nationality", "gender"]

    def before(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)))
    sizes = flat.groupBy(*keys, "block").agg(F.count("*").alias("_n")).withColumn("_s", F.floor(F.col("block") / STRETCH))
    inner = before(sizes, [*keys, "_s"], "block", "_in").drop("_n")
    outer = before(sizes.groupBy(*keys, "_s").agg(F.sum("_n").alias("_n")), keys, "_s", "_out").drop("_n")
    places = inner.join(outer, [*keys, "_s"]).select(*keys, "block", (F.col("_in") + F.col("_out")).alias("_before"))
    return flat.join(places, [*keys, "block"]).select(*keys, (F.col("name_ord") + F.col("_before")).alias("name_ord"), "name")


def flatten_irregular_names(docs: DataFrame, allowed_top, allowed_sub, col: str = "doc") -> DataFrame:
    """S3 + P9 + P16: dictionaries of depth 2 (region -> Gender -> names) or 3
    (region -> subregion -> Gender -> names).  The second level is kept as raw
    JSON; a value that parses as a name array is depth 2, otherwise depth 3.
    Returns ``(region, subregion, gender, name)``; missing genders yield no rows.
    """
    m = docs.select(F.explode(F.from_json(F.col(col), IRREGULAR)).alias("region", "_inner"))
    m = m.select("region", F.explode("_inner").alias("_k", "_v"))
    as_list = F.from_json(F.col("_v"), "array<string>")
    d2 = (m.filter(F.col("region").isin(list(allowed_top)) & as_list.isNotNull())
          .select("region", F.lit(None).cast("string").alias("subregion"),
                  F.lower("_k").alias("gender"), F.explode(as_list).alias("name")))
    d3 = (m.filter(F.col("_k").isin(list(allowed_sub)) & as_list.isNull())
          .select("region", F.col("_k").alias("subregion"),
                  F.explode(F.from_json(F.col("_v"), "map<string,array<string>>")).alias("_g", "_n"))
          .select("region", "subregion", F.lower("_g").alias("gender"), F.explode("_n").alias("name")))
    return d2.unionByName(d3)


def flatten_names_by_depth(docs: DataFrame, col: str = "doc", extra=()) -> DataFrame:
    """S3 + U5 + P16: name dictionaries of any depth, found in the data, as
    rows ``(keys, name_ord, name)``; ``keys`` is the path to the list
    (region, perhaps subregion, Gender).  The JSON is read as VARIANT; objects
    are exploded level by level until only lists are left (as many passes as
    the deepest dictionary has levels).  A missing gender, an empty object or
    list, and a value that is neither, yield no rows."""
    spark = docs.sparkSession
    level = docs.select(*extra, F.parse_json(col).alias("_v"), F.expr("cast(array() as array<string>)").alias("keys"))
    lists = None
    while True:
        kind = F.schema_of_variant("_v")
        found = level.where(kind.startswith("ARRAY")).select(*extra, "keys", F.posexplode(F.expr("cast(_v as array<string>)")).alias("name_ord", "name"))
        lists = found if lists is None else lists.unionByName(found)
        inner = level.where(kind.startswith("OBJECT"))
        if inner.isEmpty():
            return lists.withColumn("name_ord", F.col("name_ord").cast("bigint"))
        level = (inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
                 .select(*extra, F.col("value").alias("_v"), F.concat("keys", F.array("key")).alias("keys")))


# one prompt as the library stores it; any field may be absent
PROMPT = "initial_prompt string, instruction string, options array<string>, " + ", ".join(
    f"{k} string" for k in OPTION_KEYS["Success"])
LIBRARY = f"map<string,map<string,map<string,array<struct<pos:bigint,{PROMPT.replace(' ', ':').replace(',:', ',')}>>>>>"


def library_documents(prompts: DataFrame) -> DataFrame:
    """Nested ``{gender: {domain: {length: [prompt, ...]}}}`` JSON documents of
    at most SHARD prompts each, numbered by ``shard``; ``prompts`` has pos,
    gender, domain, length and the fields of PROMPT.  One shuffle: all levels
    are grouped within a shard."""
    fields = [f.split(" ")[0] for f in PROMPT.split(", ")]
    one = prompts.select(F.floor(F.col("pos") / SHARD).alias("shard"), "gender", "domain", "length",
                         F.struct("pos", *fields).alias("_p")).repartition("shard")

    def nest(df: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("_p"))
    lists = one.groupBy("shard", "gender", "domain", "length").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    library = nest(nest(nest(lists, ["shard", "gender", "domain"], "length", "_p"), ["shard", "gender"], "domain", "_p"),
                   ["shard"], "gender", "_p")
    return library.select("shard", F.to_json("_p").alias("doc"))


def library_head(docs: DataFrame, allowed_domains, length: str = "short", k: int = 2, col: str = "doc") -> DataFrame:
    """S4 + P9 + P10 + W8: the first k prompts of the wanted length per
    (gender, domain) of the allowed domains, over all library documents; ``pos`` is
    0-based.  A domain without that length has no key and is passed over."""
    genders = docs.select(F.explode(F.from_json(col, LIBRARY)).alias("gender", "_d"))
    domains = genders.select("gender", F.explode("_d").alias("domain", "_l")).where(F.col("domain").isin(list(allowed_domains)))
    prompts = (domains.where(F.map_contains_key("_l", F.lit(length)))
               .select("gender", "domain", F.inline(F.element_at("_l", F.lit(length)))))
    head = top_k_per_group(prompts, ["gender", "domain"], [F.col("pos")], k, "rank")
    return head.withColumn("pos", F.col("rank") - 1).drop("rank")
