"""Trial generation, filling, rendering and sampling queries (stage 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.render import (FRAMINGS, options_block, render_actor, sql_render_actor, sql_render_by,
                                template_parts)
from ..operators import generate as G
from ..operators.options import shuffle_texts
from ..operators.trials import TRIAL_KEY, option_key, trial_id
from ..functions.text import fill
from ..schemas import DEFAULT_INSTRUCTION, GLOBAL_SEED, MISSING_PREFIX, OPTION_KEYS, SECOND_NAME
from ..session import materialize
from ..sources import names as N
from .registry import register
from .sql import KEY_CASE, TRIALS

K = ", ".join(TRIAL_KEY)
TID = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in TRIAL_KEY) + ")"
KEYS = [KEY_CASE("mode", str(k)) for k in range(1, 5)]
N_RUNS = 3
HEAD_N = 1000

_q = "'{X} '"
GEN_CTES = f"""
WITH b AS (SELECT (SELECT max(item_id) + 1 FROM benchmark) AS nt,
                  (SELECT max(n_nationkey) + 1 FROM nation) AS nn,
                  (SELECT max(c_custkey) + 1 FROM customer) AS ck),
nm AS (SELECT c.c_custkey, c.c_name AS name,
              CASE WHEN c.c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
              n.n_name AS nationality, CAST(n.n_nationkey AS BIGINT) AS nat_ord
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
tm AS (SELECT t0.item_id AS template_id,
              CASE WHEN t0.item_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
              {_q} || t0.text AS initial_prompt, '{G.CHOICE_INSTRUCTION}' AS instruction,
              b1.text AS o1, b2.text AS o2, b3.text AS o3, b4.text AS o4
       FROM benchmark t0, b
       LEFT JOIN benchmark b1 ON b1.item_id = (t0.item_id + 1) % b.nt
       LEFT JOIN benchmark b2 ON b2.item_id = (t0.item_id + 2) % b.nt
       LEFT JOIN benchmark b3 ON b3.item_id = (t0.item_id + 3) % b.nt
       LEFT JOIN benchmark b4 ON b4.item_id = (t0.item_id + 4) % b.nt),
gt AS (SELECT nm.*, tm.template_id, tm.initial_prompt, tm.instruction, tm.o1, tm.o2, tm.o3, tm.o4,
              CAST((((CASE WHEN nm.gender = 'male' THEN 0 ELSE 1 END) * b.nt + tm.template_id) * b.nn
                    + nm.nat_ord) * b.ck + nm.c_custkey AS BIGINT) AS idx
       FROM nm JOIN tm ON nm.gender = tm.gender, b)
"""

# one template per row of the trial view
DRAWN_CTES = GEN_CTES.replace("WITH b AS", f"WITH {TRIALS}, b AS", 1) + """
, dt AS (SELECT tr.l_orderkey, tr.l_linenumber, tr.l_partkey, tr.l_suppkey, tr.mode, tr.name, tr.gender, tr.nationality,
                tm.template_id, tm.initial_prompt, tm.instruction, tm.o1, tm.o2, tm.o3, tm.o4
         FROM trials tr, b JOIN tm ON tm.template_id = tr.l_partkey % b.nt)
"""


def _drawn(t, for_texts: bool = False):
    return G.drawn_trials(t, G.templates(t).drop("gender"), for_texts)


def _keys() -> list:
    return [option_key(F.col("mode"), F.lit(k)) for k in range(1, 5)]


@register("trial_generate", GEN_CTES + """
SELECT idx, template_id, gender, nationality, name FROM gt
""", headline=True)
def trial_generate(t):
    """J1 + W1 + P3 + P11 + U1: gendered templates x same-gender names."""
    return G.generate_trials(t).select("idx", "template_id", "gender", "nationality", "name")


@register("head_n", GEN_CTES + f"""
SELECT idx, template_id, gender, nationality, name FROM gt ORDER BY idx LIMIT {HEAD_N}
""")
def head_n(t):
    """O1: the first N trials of the generation order."""
    return G.head_n(t, HEAD_N).select("idx", "template_id", "gender", "nationality", "name")


@register("multi_run", DRAWN_CTES + f"""
, r AS (SELECT CAST(range AS INTEGER) AS run FROM range(1, {N_RUNS + 1}))
SELECT {K}, run,
       CAST(CAST('0x' || substr(md5(concat_ws('|', '{GLOBAL_SEED}', CAST(run AS VARCHAR))), 1, 8) AS BIGINT)
            % 100001 AS BIGINT) AS seed,
       template_id, gender, nationality, name
FROM dt, r
""")
def multi_run(t):
    """P4 + U2 + R1: each trial once per run, with a per-run hash seed."""
    return G.with_runs(_drawn(t), N_RUNS).select(
        *TRIAL_KEY, "run", "seed", "template_id", "gender", "nationality", "name")


@register("template_fill", DRAWN_CTES + f"""
SELECT {K}, replace(instruction, '{{X}}', name) AS instruction,
       replace(initial_prompt, '{{X}}', name) AS initial_prompt FROM dt
""")
def template_fill(t):
    """P1 + F1: the name placed into every ``{X}`` of both texts."""
    return G.fill_choice(_drawn(t, for_texts=True)).select(*TRIAL_KEY, "instruction", "initial_prompt")


def _pos_sql(k: int) -> str:
    hs = [f"md5(concat_ws('|', '{GLOBAL_SEED}', {TID}, {KEYS[j]}))" for j in range(4)]
    return "(1 + " + " + ".join(f"CAST({hs[j]} < {hs[k]} AS INTEGER)" for j in range(4) if j != k) + ")"


def _at_pos(p: int, vals: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN pos{k + 1} = {p} THEN {vals[k]}" for k in range(4)) + " END"


_FRAMING_SQL = "[" + ", ".join(f"'{f}'" for f in FRAMINGS) + f"][template_id % {len(FRAMINGS)} + 1]"
_FILLED_O = [f"o{k}" for k in range(1, 5)]


@register("prompt_render", DRAWN_CTES + f"""
, sh AS (SELECT *, {_pos_sql(0)} AS pos1, {_pos_sql(1)} AS pos2, {_pos_sql(2)} AS pos3, {_pos_sql(3)} AS pos4,
                {_FRAMING_SQL} AS framing,
                replace(instruction, '{{X}}', name) AS f_instr, replace(initial_prompt, '{{X}}', name) AS f_prompt
         FROM dt),
so AS (SELECT *, {_at_pos(1, _FILLED_O)} AS s1, {_at_pos(2, _FILLED_O)} AS s2,
                 {_at_pos(3, _FILLED_O)} AS s3, {_at_pos(4, _FILLED_O)} AS s4 FROM sh)
SELECT {K}, framing, {sql_render_by('framing', 'f_instr', 'f_prompt', ['s1', 's2', 's3', 's4'])} AS prompt FROM so
""")
def prompt_render(t):
    """P18-P22 + F14: options shuffled per trial, rendered in the template's framing.

    Everything that depends only on the template (framing header, instruction,
    statement) is pre-rendered once on the small template table; per trial
    the plan only fills the name, orders the four options and concatenates.
    """
    tm = G.templates(t)
    tm = tm.withColumn("framing", F.element_at(F.array(*[F.lit(f) for f in FRAMINGS]),
                                               (F.col("template_id") % len(FRAMINGS) + 1).cast("int")))
    tm = tm.select("template_id", "framing", "o1", "o2", "o3", "o4",
                   *template_parts(F.col("framing"), F.col("instruction"), F.col("initial_prompt")))
    g = G.drawn_trials(t, tm, for_texts=True)
    sh = shuffle_texts(trial_id(), _keys(), [F.col(f"o{k}") for k in range(1, 5)], GLOBAL_SEED)
    g = g.withColumn("_sh", sh)                        # one permutation per row, read four times
    o = [F.col("_sh").getItem(i)["text"] for i in range(4)]
    body = F.when(F.col("has_options"), options_block(o)).otherwise(F.lit(""))
    prompt = F.concat(F.replace(F.col("pre"), F.lit("{X}"), F.col("name")), body, F.col("tail"))
    return g.select(*TRIAL_KEY, "framing", prompt.alias("prompt"))


AO_CTES = f"""
WITH b AS (SELECT (SELECT max(n_nationkey) + 1 FROM nation) AS nn,
                  (SELECT max(c_custkey) + 1 FROM customer) AS ck),
nm AS (SELECT c.c_custkey, c.c_name AS name,
              CASE WHEN c.c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
              n.n_name AS nationality, CAST(n.n_nationkey AS BIGINT) AS nat_ord
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
ga AS (SELECT nm.*, bm.item_id AS template_id, bm.text,
              CAST((bm.item_id * b.nn + nm.nat_ord) * b.ck + nm.c_custkey AS BIGINT) AS idx
       FROM nm, benchmark bm, b)
"""


@register("trial_generate_all", AO_CTES + """
SELECT idx, template_id, gender, nationality, name FROM ga
""")
def trial_generate_all(t):
    """Ungendered (actor/observer) templates x every name."""
    return G.generate_all(t).select("idx", "template_id", "gender", "nationality", "name")


_AO_SCEN = "replace(replace('{X} talked with {Y}. ' || text, '{X}', name), '{Y}', '" + SECOND_NAME + "')"
_AO_DIAL = f"replace(replace('{G.AO_DIALOGUE}', '{{X}}', name), '{{Y}}', '{SECOND_NAME}')"
_AO_Q = f"replace('{G.AO_QUESTION}', '{{X}}', name)"


@register("template_fill2", DRAWN_CTES + f"""
, f AS (SELECT {K}, name, {_AO_SCEN} AS scenario, {_AO_DIAL} AS dialogue, {_AO_Q} AS question,
               'What ' || name || ' said' AS option1, 'What {SECOND_NAME} said' AS option2
        FROM dt JOIN benchmark bm ON bm.item_id = dt.template_id)
SELECT {K}, scenario, dialogue, question, option1, option2,
       {sql_render_actor('scenario', 'dialogue', 'question', 'name', "'" + SECOND_NAME + "'")} AS prompt
FROM f
""")
def template_fill2(t):
    """P2 + F17 + P20: two placeholders ({Y} fixed) and the actor/observer prompt."""
    scenes = t.benchmark.select(F.col("item_id").alias("template_id"), "text")
    f = G.fill_actor_observer(G.drawn_trials(t, scenes, for_texts=True))
    return f.select(*TRIAL_KEY, "scenario", "dialogue", "question", "option1", "option2",
                    render_actor(F.col("scenario"), F.col("dialogue"), F.col("question"),
                                 F.col("name"), F.lit(SECOND_NAME)).alias("prompt"))


@register("stratified_sample", f"""
WITH nm AS (SELECT c.c_custkey, c.c_name AS name,
              CASE WHEN c.c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
              n.n_name AS nationality
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY nationality, gender
                 ORDER BY md5(concat_ws('|', '{GLOBAL_SEED}', CAST(c_custkey AS VARCHAR))), c_custkey) AS rk FROM nm)
SELECT nationality, gender, name, c_custkey, CAST(rk AS BIGINT) AS rank FROM r WHERE rk <= 3
""")
def stratified_sample(t):
    """W2 + F13: 3 names per (nationality, gender) in seeded hash order."""
    s = G.stratified_sample(G.names(t), ["nationality", "gender"], "c_custkey", 3)
    return s.select("nationality", "gender", "name", "c_custkey", "rank")


ALLOWED_REGIONS = ["REGION_0", "REGION_3"]
ALLOWED_NATIONS = ["NATION_1", "NATION_7"]


@register("allow_list", """
SELECT c.c_custkey, c.c_name AS name, n.n_name AS nationality, r.r_name AS region
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
WHERE r.r_name IN ('""" + "', '".join(ALLOWED_REGIONS) + """') OR n.n_name IN ('""" + "', '".join(ALLOWED_NATIONS) + """')
""")
def allow_list(t):
    """Names of allowed regions or allowed sub-regions (small IN lists,
    evaluated on the broadcast dimension before the join)."""
    dims = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .filter(F.col("r_name").isin(ALLOWED_REGIONS) | F.col("n_name").isin(ALLOWED_NATIONS))
            .select("n_nationkey", F.col("n_name").alias("nationality"), F.col("r_name").alias("region")))
    return (t.customer.join(dims, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("c_name").alias("name"), "nationality", "region"))


_WHOLE_NAMES = """
WITH nm AS (SELECT c.c_custkey, c.c_name AS name, n.n_name AS nationality,
              CASE WHEN c.c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT nationality, gender,
       CAST(row_number() OVER (PARTITION BY nationality, gender ORDER BY c_custkey) - 1 AS BIGINT) AS name_ord, name
FROM nm
"""


@register("name_flatten", _WHOLE_NAMES)
def name_flatten(t):
    """S2 + F6: nested ``{nationality: {Gender: [names]}}`` JSON documents
    flattened to rows with lower-cased gender keys, the names of a list
    numbered over all documents that hold a part of it.

    The documents are built from the customer table in blocks of at most
    BLOCK names, so each one is bounded."""
    return N.number_names(materialize(N.flatten_names(N.name_documents(G.names(t)), "doc", extra=["block"]), "names"))


@register("name_flatten_whole", _WHOLE_NAMES)
def name_flatten_whole(t):
    """S2 + F6: ``name_flatten`` under its former name."""
    return name_flatten(t)


DEEP_REGIONS = ["ASIA", "EUROPE"]                    # regions whose names are kept by nation
ALLOWED_SUBREGIONS = [f"NATION_{k}" for k in (2, 3, 7, 8, 12)]


@register("names_irregular", f"""
WITH nm AS (SELECT c.c_custkey, c.c_name AS name, n.n_name AS nation, r.r_name AS region,
              CASE WHEN c.c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT CAST(c_custkey // {N.BLOCK} AS BIGINT) AS block, region,
       CASE WHEN region IN ('{"', '".join(DEEP_REGIONS)}') THEN nation END AS subregion, gender, name,
       CAST(row_number() OVER (PARTITION BY c_custkey // {N.BLOCK}, region, CASE WHEN region IN ('{"', '".join(DEEP_REGIONS)}') THEN nation END, gender
            ORDER BY c_custkey) - 1 AS BIGINT) AS name_ord
FROM nm WHERE region NOT IN ('{"', '".join(DEEP_REGIONS)}') OR nation IN ('{"', '".join(ALLOWED_SUBREGIONS)}')
""")
def names_irregular(t):
    """S3 + U5 + P9 + P16: dictionaries whose regions hold genders, or
    subregions that hold genders; the depth is found in the data.  Regions
    count as they are, subregions if allowed."""
    region = t.region.select("r_regionkey", F.col("r_name").alias("region"))
    nation = t.nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nationality"), "region")
    names = G.names(t).join(nation, "nationality").withColumn("block", F.floor(F.col("c_custkey") / N.BLOCK))
    deep = F.col("region").isin(DEEP_REGIONS)
    lists = (names.groupBy("block", "region", F.when(deep, F.col("nationality")).alias("sub"), F.initcap("gender").alias("gender"))
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "name"))), lambda x: x["name"]).alias("names")))
    inner = F.create_map("gender", "names")
    doc = F.when(F.col("sub").isNull(), F.to_json(F.create_map("region", inner))).otherwise(
        F.to_json(F.create_map("region", F.create_map("sub", inner))))
    flat = N.flatten_names_by_depth(lists.select("block", doc.alias("doc")), extra=["block"])
    flat = flat.where((F.size("keys") == 2) | F.get("keys", F.lit(1)).isin(ALLOWED_SUBREGIONS))
    return flat.select("block", F.get("keys", F.lit(0)).alias("region"), F.when(F.size("keys") > 2, F.get("keys", F.lit(1))).alias("subregion"),
                       F.lower(F.get("keys", F.size("keys") - 1)).alias("gender"), "name", "name_ord")


_KEY_NAMES = OPTION_KEYS["Success"]
_HEAD_TID = "concat_ws('|', set_id, nationality, name)"
_HEAD_H = [f"md5(concat_ws('|', '{GLOBAL_SEED}', {_HEAD_TID}, '{k}'))" for k in _KEY_NAMES]
_HEAD_POS = ["(1 + " + " + ".join(f"CAST({_HEAD_H[j]} < {h} AS INTEGER)" for j in range(4) if j != k) + ")"
             for k, h in enumerate(_HEAD_H)]
# which fields a stored prompt lacks
_NO_INSTRUCTION, _NO_OPTIONS, _NO_OPTION = "doc_id % 5 = 0", "doc_id % 13 = 0", "(doc_id + {k}) % 7 = 0"


def _head_option(p: int, what: str) -> str:
    return "CASE " + " ".join(f"WHEN pos{k} = {p} THEN {what.format(k=k, key=_KEY_NAMES[k - 1])}" for k in range(1, 5)) + " END"


@register("prompt_head", f"""
WITH b AS (SELECT max(item_id) + 1 AS nt FROM benchmark),
lib AS (SELECT doc_id, source AS domain, text, CASE WHEN doc_id % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
               n_chars * count(n_chars) OVER () < sum(n_chars) OVER () AS short
        FROM documents WHERE source IS NOT NULL),
hd AS (SELECT *, row_number() OVER (PARTITION BY gender, domain ORDER BY doc_id) - 1 AS pos
       FROM lib WHERE short AND domain IN ('{"', '".join(N.ALLOWED_DOMAINS)}')),
nm AS (SELECT c.c_custkey, c.c_name AS name,
              CASE WHEN c.c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender, n.n_name AS nationality
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey),
sm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nationality, gender
          ORDER BY md5(concat_ws('|', '{GLOBAL_SEED}', CAST(c_custkey AS VARCHAR))), c_custkey) AS rk FROM nm) WHERE rk <= 3),
j AS (SELECT hd.*, sm.nationality, sm.name, hd.gender || '_' || hd.domain || '_short_set' || CAST(hd.pos AS VARCHAR) AS set_id
      FROM hd JOIN sm ON hd.gender = sm.gender WHERE hd.pos < 2 AND NOT ({_NO_OPTIONS})),
o AS (SELECT j.*, {", ".join(f"CASE WHEN {_NO_OPTION.format(k=k)} THEN 'Missing: {key}' ELSE b{k}.text END AS o{k}" for k, key in enumerate(_KEY_NAMES, 1))},
             {", ".join(f"{p} AS pos{k}" for k, p in enumerate(_HEAD_POS, 1))}
      FROM j, b {" ".join(f"JOIN benchmark b{k} ON b{k}.item_id = (j.doc_id + {k}) % b.nt" for k in range(1, 5))})
SELECT set_id, gender, domain, 'short' AS length, nationality, name,
       CASE WHEN {_NO_INSTRUCTION} THEN '{DEFAULT_INSTRUCTION}' ELSE replace('{G.CHOICE_INSTRUCTION}', '{{X}}', name) END AS instruction,
       replace('{{X}} ' || text, '{{X}}', name) AS initial_prompt,
       {", ".join(f"{_head_option(p, '{key!r}')} AS key_{L}, {_head_option(p, 'o{k}')} AS opt_{L}" for p, L in enumerate("ABCD", 1))}
FROM o
""")
def prompt_head(t):
    """S4 + P6 + P9 + P10 + P15 + J4 + W4 + W8: the first two short prompts per
    (gender, domain) of the allowed domains of a nested JSON library, crossed
    with the sampled names of the same gender; the name filled in, the options
    shuffled, defaults for absent fields, a composite set id.

    "Short" is below the corpus' mean length.  Absent instruction: the default
    text; absent option: ``Missing: <key>``; no options at all: passed over."""
    d = t.documents.where("source is not null")
    n, total = d.agg(F.count("n_chars")).scalar(), d.agg(F.sum("n_chars")).scalar()
    nt = t.benchmark.agg(F.max("item_id") + 1).scalar()
    rows = d.select("doc_id", F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 2 == 0, "male").otherwise("female").alias("gender"),
                    F.col("source").alias("domain"), F.when(F.col("n_chars") * n < total, "short").otherwise("long").alias("length"),
                    F.concat(F.lit("{X} "), F.col("text")).alias("initial_prompt"),
                    F.expr(f"CASE WHEN NOT ({_NO_INSTRUCTION}) THEN '{G.CHOICE_INSTRUCTION}' END").alias("instruction"),
                    F.when(~F.expr(_NO_OPTIONS), F.array(*[F.lit(k) for k in _KEY_NAMES])).alias("options"),
                    *[((F.col("doc_id") + k) % nt).alias(f"_o{k}") for k in range(1, 5)])
    for k, key in enumerate(_KEY_NAMES, 1):
        item = t.benchmark.select(F.col("item_id").alias(f"_o{k}"), F.col("text").alias(key))
        rows = rows.join(item, f"_o{k}").withColumn(key, F.expr(f"CASE WHEN NOT ({_NO_OPTION.format(k=k)}) THEN {key} END"))
    head = N.library_head(N.library_documents(rows), N.ALLOWED_DOMAINS, "short", 2)
    sm = G.stratified_sample(G.names(t), ["nationality", "gender"], "c_custkey", 3)
    j = head.where("options is not null").join(sm.select("gender", "nationality", "name"), "gender")
    j = j.withColumn("set_id", F.format_string("%s_%s_short_set%d", F.col("gender"), F.col("domain"), F.col("pos")))
    texts = [F.coalesce(F.col(k), F.lit(MISSING_PREFIX + k)) for k in _KEY_NAMES]
    j = j.withColumn("_sh", shuffle_texts(F.concat_ws("|", "set_id", "nationality", "name"), _KEY_NAMES, texts, GLOBAL_SEED))
    return j.select("set_id", "gender", "domain", F.lit("short").alias("length"), "nationality", "name",
                    F.coalesce(fill("instruction", F.col("name")), F.lit(DEFAULT_INSTRUCTION)).alias("instruction"),
                    fill("initial_prompt", F.col("name")).alias("initial_prompt"),
                    *[c for i, L in enumerate("ABCD") for c in (F.col("_sh").getItem(i)["key"].alias(f"key_{L}"),
                                                               F.col("_sh").getItem(i)["text"].alias(f"opt_{L}"))])


def _run_pos_sql(k: int) -> str:
    hs = [f"md5(concat_ws('|', CAST(seed AS VARCHAR), {TID}, {KEYS[j]}))" for j in range(4)]
    return "(1 + " + " + ".join(f"CAST({hs[j]} < {hs[k]} AS INTEGER)" for j in range(4) if j != k) + ")"


@register("run_option_shuffle", DRAWN_CTES + f"""
, r AS (SELECT CAST(range AS INTEGER) AS run FROM range(1, {N_RUNS + 1})),
rs AS (SELECT {K}, mode, run,
              CAST(CAST('0x' || substr(md5(concat_ws('|', '{GLOBAL_SEED}', CAST(run AS VARCHAR))), 1, 8) AS BIGINT)
                   % 100001 AS BIGINT) AS seed FROM dt, r),
ps AS (SELECT *, {_run_pos_sql(0)} AS pos1, {_run_pos_sql(1)} AS pos2, {_run_pos_sql(2)} AS pos3,
              {_run_pos_sql(3)} AS pos4 FROM rs)
SELECT {K}, run, seed, {_at_pos(1, KEYS)} AS key_A, {_at_pos(2, KEYS)} AS key_B,
       {_at_pos(3, KEYS)} AS key_C, {_at_pos(4, KEYS)} AS key_D FROM ps
""")
def run_option_shuffle(t):
    """W3 + R1 + R3: each run permutes every trial's options with its own
    seed (md5(run seed | trial | key)), so runs differ but each is
    reproducible and retry-safe."""
    g = G.with_runs(_drawn(t).select(*TRIAL_KEY, "mode"), N_RUNS)
    g = g.withColumn("_sh", shuffle_texts(trial_id(), _keys(), _keys(), F.col("seed")))
    return g.select(*TRIAL_KEY, "run", "seed",
                    *[F.col("_sh").getItem(i)["key"].alias(f"key_{L}") for i, L in enumerate("ABCD")])
