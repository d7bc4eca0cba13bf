"""Option shuffle, choice, letter mapping, probability expansion and
likelihood / perplexity queries (stage 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_even_2, softmax
from ..functions.text import parse_letter
from ..operators import options as O
from ..operators import scoring as S
from ..operators.generate import CHOICE_INSTRUCTION, fill_actor_observer, fill_choice, templates
from ..operators.metrics import internal_external
from ..operators.trials import TRIAL_KEY, option_key, trial_id, trial_lines, people, trials
from ..schemas import GLOBAL_SEED, LETTERS, OPTION_KEYS, SECOND_NAME
from .registry import register, round_doubles
from .sql import KEY_CASE, TRIALS, r6

K = ", ".join(TRIAL_KEY)
TID = "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in TRIAL_KEY) + ")"


def _h(k: int) -> str:
    return f"md5(concat_ws('|', '{GLOBAL_SEED}', {TID}, {KEY_CASE('mode', str(k))}))"


def _pos(k: int) -> str:
    return "(1 + " + " + ".join(f"CAST({_h(j)} < {_h(k)} AS INTEGER)" for j in range(1, 5) if j != k) + ")"


def _at(p: int, vals: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN pos{k} = {p} THEN {vals[k - 1]}" for k in range(1, 5)) + " END"


_KEYS = [KEY_CASE("mode", str(k)) for k in range(1, 5)]
SHUF = f""", sh AS (SELECT *, {_pos(1)} AS pos1, {_pos(2)} AS pos2, {_pos(3)} AS pos3, {_pos(4)} AS pos4 FROM tl),
lt AS (SELECT *, {_at(1, _KEYS)} AS key_A, {_at(2, _KEYS)} AS key_B, {_at(3, _KEYS)} AS key_C,
              {_at(4, _KEYS)} AS key_D,
              {_at(1, ['s1', 's2', 's3', 's4'])} AS sa, {_at(2, ['s1', 's2', 's3', 's4'])} AS sb,
              {_at(3, ['s1', 's2', 's3', 's4'])} AS sc, {_at(4, ['s1', 's2', 's3', 's4'])} AS sd,
              {_at(1, ['p1', 'p2', 'p3', 'p4'])} AS pa, {_at(2, ['p1', 'p2', 'p3', 'p4'])} AS pb,
              {_at(3, ['p1', 'p2', 'p3', 'p4'])} AS pc, {_at(4, ['p1', 'p2', 'p3', 'p4'])} AS pd
       FROM sh),
ch AS (SELECT *, CASE WHEN s1 IS NULL OR s2 IS NULL OR s3 IS NULL OR s4 IS NULL THEN NULL
                      WHEN sa >= sb AND sa >= sc AND sa >= sd THEN 1 WHEN sb >= sc AND sb >= sd THEN 2
                      WHEN sc >= sd THEN 3 ELSE 4 END AS cpos FROM lt),
cc AS (SELECT *, chr(CAST(64 + cpos AS INTEGER)) AS chosen_letter,
              CASE cpos WHEN 1 THEN key_A WHEN 2 THEN key_B WHEN 3 THEN key_C WHEN 4 THEN key_D END AS chosen_key,
              CASE cpos WHEN 1 THEN pa WHEN 2 THEN pb WHEN 3 THEN pc WHEN 4 THEN pd END AS chosen_prob FROM ch)
"""


def _shuffled(li):
    """Per-trial shuffled option array over the trial lines (no shuffle stage)."""
    keys = [option_key(F.col("mode"), F.lit(i)) for i in range(1, 5)]
    return O.shuffle_options(trial_id(), keys,
                             {"score": [F.col(f"s{i}") for i in range(1, 5)],
                              "prob": [F.col(f"p{i}") for i in range(1, 5)]}, GLOBAL_SEED)


@register("option_shuffle", f"WITH {TRIALS} {SHUF} SELECT {K}, key_A, key_B, key_C, key_D FROM cc")
def option_shuffle(t):
    """W3-W5 + F9 + R3: seeded permutation of each trial's four options;
    ``key_<letter>`` names the option shown under that letter."""
    li = trial_lines(t)
    li = li.withColumn("_sh", _shuffled(li))
    return li.select(*TRIAL_KEY, *[F.col("_sh").getItem(i)["key"].alias(f"key_{L}")
                                   for i, L in enumerate(LETTERS)])


def _chosen(li):
    li = li.withColumn("_sh", _shuffled(li))
    li = li.withColumn("_pos", O.first_argmax_pos(F.col("_sh")))
    # NULL when there is no position: get passes it on, element_at does not here
    ch = F.get(F.col("_sh"), (F.col("_pos") - 1).cast("int"))
    return li.select("*", O.letter(F.col("_pos")).alias("chosen_letter"), ch["key"].alias("chosen_key"),
                     ch["prob"].alias("chosen_prob"))


@register("choose_option", f"WITH {TRIALS} {SHUF} SELECT {K}, chosen_letter, chosen_key, chosen_prob FROM cc")
def choose_option(t):
    """W6 + O6: first argmax over the shuffled letters on unrounded scores."""
    return _chosen(trial_lines(t)).select(*TRIAL_KEY, "chosen_letter", "chosen_key", "chosen_prob")


_RESP_SQL = ("CASE l_linenumber % 4 WHEN 0 THEN chosen_letter "
             "WHEN 1 THEN '(' || lower(chosen_letter) || ').' "
             "WHEN 2 THEN 'A good reason is ' || chosen_letter "
             "ELSE ' ' || chosen_letter || ':' || chr(10) END")
_U = "upper(regexp_replace(response, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g'))"
_PAT = "^[ (]*([A-D])[ ).:]*$"


@register("letter_to_key", f"""WITH {TRIALS} {SHUF}
, rs AS (SELECT *, {_RESP_SQL} AS response FROM cc),
pl AS (SELECT *, CASE WHEN regexp_matches({_U}, '{_PAT}') THEN regexp_extract({_U}, '{_PAT}', 1) END AS parsed_letter
       FROM rs)
SELECT {K}, response, parsed_letter,
       CASE parsed_letter WHEN 'A' THEN key_A WHEN 'B' THEN key_B WHEN 'C' THEN key_C WHEN 'D' THEN key_D END
         AS parsed_key
FROM pl
""")
def letter_to_key(t):
    """F16 + J8: a letter read from a free-text answer, mapped to its option
    key through the trial's letter -> key map (NULL when no letter is read)."""
    c = _chosen(trial_lines(t))
    L = F.col("chosen_letter")
    resp = (F.when(F.col("l_linenumber") % 4 == 0, L)
            .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("("), F.lower(L), F.lit(").")))
            .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("A good reason is "), L))
            .otherwise(F.concat(F.lit(" "), L, F.lit(":\n"))))
    c = c.withColumn("response", resp).withColumn("parsed_letter", parse_letter(F.col("response")))
    return c.select(*TRIAL_KEY, "response", "parsed_letter",
                    F.element_at(O.letter_map(F.col("_sh")), F.col("parsed_letter")).alias("parsed_key"))


@register("expand_probs", f"""WITH {TRIALS}
SELECT {K}, mode, p1 AS opt1, p2 AS opt2, p3 AS opt3, p4 AS opt4, {r6('p1 + p2 - p3 - p4', 'metric')} FROM tl
""")
def expand_probs(t):
    """J7 + P23: ``{letter: prob}`` of the shuffled view mapped back through
    ``{letter: option}`` to one column per option in fixed order, then the
    metric."""
    li = trial_lines(t)
    li = li.withColumn("_sh", _shuffled(li))
    letters = F.array(*[F.lit(x) for x in LETTERS])
    letter_probs = F.map_from_arrays(letters, F.transform("_sh", lambda o: o["prob"]))
    letter_ord = F.map_from_arrays(letters, F.transform("_sh", lambda o: o["ord"]))
    by_ord = F.map_from_arrays(F.transform(F.map_keys(letter_probs), lambda l: F.element_at(letter_ord, l)),
                               F.map_values(letter_probs))
    out = li.select(*TRIAL_KEY, "mode", *[F.element_at(by_ord, F.lit(k)).alias(f"opt{k}") for k in range(1, 5)])
    return round_doubles(out.withColumn("metric", internal_external(
        *[F.col(f"opt{k}") for k in range(1, 5)])))


@register("attach_attrs", f"""WITH {TRIALS} {SHUF}
SELECT cc.l_orderkey, cc.l_linenumber, cc.l_partkey, cc.l_suppkey, cc.chosen_letter, cc.chosen_key,
       tr.gender, tr.nationality, tr.name
FROM cc JOIN people tr ON cc.l_orderkey = tr.o_orderkey
""")
def attach_attrs(t):
    """Scored rows re-attached to their order's attributes by key, never
    by position; lineitem is read and shuffled once."""
    scored = _chosen(trial_lines(t)).select(*TRIAL_KEY, "chosen_letter", "chosen_key")
    return (scored.join(people(t), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(*TRIAL_KEY, "chosen_letter", "chosen_key", "gender", "nationality", "name"))


_NORM = [f"s{k} / (s1 + s2 + s3 + s4)" for k in range(1, 5)]


@register("round_probs", f"""WITH {TRIALS}
SELECT {K}, {", ".join(f"round_even({_NORM[k - 1]}, 2) AS r{k}" for k in range(1, 5))} FROM tl
""")
def round_probs(t):
    """normalised scores rounded to 2 decimals, ties to even (NumPy)."""
    li = trial_lines(t)
    tot = F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")
    return li.select(*TRIAL_KEY, *[round_half_even_2(F.col(f"s{k}") / tot).alias(f"r{k}") for k in range(1, 5)])


def _mode_cols(mode: str) -> str:
    return ", ".join(f"p{k} AS {key}" for k, key in enumerate(OPTION_KEYS[mode], start=1))


@register("union_modes", f"""WITH {TRIALS}
SELECT {K}, mode, {_mode_cols('Success')}, {r6('metric', 'metric')} FROM tl WHERE mode = 'Success'
UNION ALL BY NAME
SELECT {K}, mode, {_mode_cols('Failure')}, {r6('metric', 'metric')} FROM tl WHERE mode = 'Failure'
""")
def union_modes(t):
    """Per-mode result tables with mode-specific option columns, unioned
    by name (absent columns NULL)."""
    li = trial_lines(t)

    def part(mode):
        return li.filter(F.col("mode") == mode).select(
            *TRIAL_KEY, "mode", *[F.col(f"p{k}").alias(key) for k, key in enumerate(OPTION_KEYS[mode], 1)],
            "metric")
    return round_doubles(part("Success").unionByName(part("Failure"), allowMissingColumns=True))


_MX = "greatest(s1, s2, s3, s4)"
_EX = [f"exp(s{k} - {_MX})" for k in range(1, 5)]


@register("softmax_scores", f"""WITH {TRIALS}
SELECT {K}, {", ".join(r6(f"{_EX[k - 1]} / ({' + '.join(_EX)})", f"sm{k}") for k in range(1, 5))} FROM tl
""")
def softmax_scores(t):
    """softmax of each trial's raw score vector (array transform + fold)."""
    li = trial_lines(t)
    sm = softmax(F.array(*[F.col(f"s{k}") for k in range(1, 5)]))
    return round_doubles(li.select(*TRIAL_KEY, *[sm.getItem(k - 1).alias(f"sm{k}") for k in range(1, 5)]))


_TOK = """
dt AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS token FROM documents),
vt AS (SELECT token, count(*) AS cnt FROM dt WHERE token <> '' GROUP BY token),
nv AS (SELECT CAST(sum(cnt) + count(*) AS DOUBLE) AS denom FROM vt),
vm AS (SELECT token, ln(CAST(cnt + 1 AS DOUBLE) / denom) AS lp FROM vt, nv)
"""


@register("perplexity_docs", f"""WITH {_TOK},
dc AS (SELECT doc_id, token, count(*) AS c FROM dt WHERE token <> '' GROUP BY doc_id, token),
ds AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_tokens, sum(c * lp) AS log_prob
       FROM dc JOIN vm USING (token) GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, CASE WHEN n_tokens IS NULL THEN 'no token' END AS reason,
       {r6("CASE WHEN n_tokens IS NULL THEN NULL WHEN -log_prob / n_tokens < 20 THEN exp(-log_prob / n_tokens) ELSE 'inf'::DOUBLE END", 'perplexity', 4)},
       {r6('log_prob', 'log_prob', 4)}
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN ds USING (doc_id)
""", headline=True)
def perplexity_docs(t):
    """A20 + A21 + F11: per-document perplexity and log-probability under a
    unigram model of the whole corpus (every token of every document).  A
    document without a token keeps its row, with NULL measures and a reason."""
    seq = S.corpus_logprob(t.documents.select("doc_id", "text"), ["doc_id"])
    out = seq.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"),
                     F.when(F.col("n_tokens") == 0, "no token").alias("reason"),
                     F.when(F.col("n_tokens") > 0, S.perplexity(F.col("n_tokens"), F.col("log_prob"))).alias("perplexity"), "log_prob")
    return round_doubles(out, 4)


_N, _LP = "(u.n + a.n)", "(u.lp + a.lp)"


@register("perplexity_pairs", f"""WITH {_TOK},
ct AS (SELECT conv_id, turn, role, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS token
       FROM conversations WHERE role IN ('user', 'assistant')),
cc AS (SELECT conv_id, turn, role, token, count(*) AS c FROM ct WHERE token <> '' GROUP BY ALL),
cs AS (SELECT conv_id, turn, role, sum(c) AS n, sum(c * coalesce(vm.lp, ln(1.0 / nv.denom))) AS lp
       FROM cc LEFT JOIN vm USING (token), nv GROUP BY conv_id, turn, role),
tu AS (SELECT DISTINCT conv_id, turn, role FROM conversations
       WHERE text IS NOT NULL AND role IN ('user', 'assistant')),
ts AS (SELECT conv_id, turn, role, coalesce(n, 0) AS n, coalesce(lp, CAST(0 AS DOUBLE)) AS lp
       FROM tu LEFT JOIN cs USING (conv_id, turn, role))
SELECT u.conv_id, u.turn, CAST({_N} AS BIGINT) AS n_tokens,
       {r6(f"CASE WHEN {_N} = 0 THEN NULL WHEN -{_LP} / {_N} < 20 THEN exp(-{_LP} / {_N}) ELSE 'inf'::DOUBLE END",
           'perplexity', 4)},
       {r6('a.lp', 'log_prob', 4)}, {r6('exp(a.lp)', 'probability', 4)}
FROM ts u JOIN ts a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
""")
def perplexity_pairs(t):
    """X5 + A20 + A21: each user turn with the assistant turn that follows it:
    perplexity of both together, (log-)probability of the response alone.

    Turns are scored one by one and only their sums are joined, by
    conversation and turn.  A NULL text makes no pair; an empty response has
    probability 1; without any token the perplexity is NULL."""
    keys = ["conv_id", "turn", "role"]
    c = t.conversations.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull()).select(*keys, "text")
    corpus = S.token_counts(S.tokens(t.documents.select("text"), []), [])
    model, unseen = S.unigram_model(corpus)
    seq = S.sequence_logprob(S.token_counts(S.tokens(c, keys), keys), model, unseen, keys)
    turns = c.select(*keys).distinct().join(seq, keys, "left").select(
        *keys, F.coalesce("n_tokens", F.lit(0)).alias("n"), F.coalesce("log_prob", F.lit(0.0)).alias("lp"))
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("n").alias("un"), F.col("lp").alias("ulp"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "n", "lp")
    n = F.col("un") + F.col("n")
    out = user.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", n.cast("bigint").alias("n_tokens"),
        F.when(n > 0, S.perplexity(n, F.col("ulp") + F.col("lp"))).alias("perplexity"),
        F.col("lp").alias("log_prob"), F.exp("lp").alias("probability"))
    return round_doubles(out, 4)


@register("option_likelihood", f"""WITH {_TOK},
b AS (SELECT max(item_id) + 1 AS nt FROM benchmark),
ot AS (SELECT t0.item_id AS template_id, k AS ord, o.text
       FROM benchmark t0, b, (SELECT unnest([1, 2, 3, 4]) AS k) ks, benchmark o
       WHERE o.item_id = (t0.item_id + ks.k) % b.nt),
tk AS (SELECT template_id, ord, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS token FROM ot),
tc AS (SELECT template_id, ord, token, count(*) AS c FROM tk WHERE token <> '' GROUP BY ALL),
sq AS (SELECT template_id, ord, sum(c) AS n, sum(c * coalesce(vm.lp, ln(1.0 / nv.denom))) AS lp
       FROM tc LEFT JOIN vm USING (token), nv GROUP BY template_id, ord),
lk AS (SELECT *, exp(lp / n) AS lik FROM sq)
SELECT template_id, CAST(ord AS INTEGER) AS ord, {r6('lik / sum(lik) OVER (PARTITION BY template_id)', 'prob')} FROM lk
""")
def option_likelihood(t):
    """Each template's four options scored by mean token log-probability
    under the corpus unigram model, normalised to sum 1 per template."""
    tm = templates(t)
    opts = tm.select("template_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("ord"), F.col(f"o{k}").alias("text")) for k in range(1, 5)])))
    # the corpus only feeds the vocabulary here: count tokens directly (one shuffle)
    corpus = S.token_counts(S.tokens(t.documents.select("text"), []), [])
    model, unseen = S.unigram_model(corpus)
    opt_counts = S.token_counts(S.tokens(opts, ["template_id", "ord"]), ["template_id", "ord"])
    seq = S.sequence_logprob(opt_counts, model, unseen, ["template_id", "ord"])
    out = S.normalised_likelihood(seq, ["template_id"])
    return round_doubles(out.select("template_id", "ord", "prob"))


def _normalising_scorer(pdf):
    """Stand-in batch scorer (pandas, vectorised): raw option scores of each
    trial -> probabilities, one list per row.  A real deployment passes a
    model here."""
    import numpy as np
    sc = np.vstack(pdf["scores"].to_numpy())
    return list(sc / sc.sum(axis=1, keepdims=True))


_SC = ["sa", "sb", "sc", "sd"]
_PR = [f"({x} / ({' + '.join(_SC)}))" for x in _SC]


@register("scorer_choice", f"""WITH {TRIALS} {SHUF}
, pr AS (SELECT *, {_PR[0]} AS qa, {_PR[1]} AS qb, {_PR[2]} AS qc, {_PR[3]} AS qd FROM cc),
am AS (SELECT *, CASE WHEN qa >= qb AND qa >= qc AND qa >= qd THEN 1 WHEN qb >= qc AND qb >= qd THEN 2
                      WHEN qc >= qd THEN 3 ELSE 4 END AS qpos FROM pr)
SELECT {K}, chr(CAST(64 + qpos AS INTEGER)) AS chosen_letter,
       round_even(CASE qpos WHEN 1 THEN qa WHEN 2 THEN qb WHEN 3 THEN qc ELSE qd END, 2) AS chosen_prob,
       CAST(NULL AS VARCHAR) AS error
FROM am
""")
def scorer_choice(t):
    """X3 + X7 + W6 + F10: a caller-supplied pandas scorer run over Arrow
    batches (pandas UDF, result kept in its row), then the first-argmax
    choice and the half-even rounded probability."""
    li = trial_lines(t)
    li = li.withColumn("_sh", _shuffled(li))
    scored = li.withColumn("_r", S.score_column(_normalising_scorer,
                                                scores=F.transform("_sh", lambda o: o["score"])))
    probs = F.col("_r.probs")
    pos = F.array_position(probs, F.array_max(probs))
    return scored.select(*TRIAL_KEY, O.letter(pos).alias("chosen_letter"),
                         round_half_even_2(F.element_at(probs, pos.cast("int"))).alias("chosen_prob"),
                         F.col("_r.error").alias("error"))


_AO_P = "(s1 + s2) / (s1 + s2 + s3 + s4)"


@register("actor_choice", f"""WITH {TRIALS}
, p AS (SELECT tr.*, {_AO_P} AS pa, (s3 + s4) / (s1 + s2 + s3 + s4) AS pb, bm.item_id AS scene, bm.text
        FROM trials tr JOIN benchmark bm ON bm.item_id = tr.l_partkey % (SELECT max(item_id) + 1 FROM benchmark))
SELECT {K}, scene, replace(replace('{{X}} talked with {{Y}}. ' || text, '{{X}}', name), '{{Y}}', '{SECOND_NAME}') AS scenario,
       CASE WHEN pa IS NULL THEN NULL WHEN pa >= pb THEN 'A' ELSE 'B' END AS chosen_letter,
       CASE WHEN pa IS NULL THEN NULL WHEN pa >= pb THEN 'What ' || name || ' said' ELSE 'What {SECOND_NAME} said' END AS chosen_sentence,
       round_even(pa, 2) AS prob_A, round_even(pb, 2) AS prob_B, gender, nationality, name
FROM p
""")
def actor_choice(t):
    """F17 + D8 + P20 + W6: the choice between the two sayings of an
    actor/observer trial, from scores supplied for A and B (here the internal
    and the external share): first argmax on unrounded probabilities, the
    chosen sentence with the name in it, the trial's attributes kept.  A trial
    without scores chooses nothing."""
    scores = trial_lines(t).select(*TRIAL_KEY, (F.col("s1") + F.col("s2")).alias("a"), (F.col("s3") + F.col("s4")).alias("b"),
                                   (F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")).alias("all"),
                                   (F.col("l_partkey") % t.benchmark.agg(F.max("item_id") + 1).scalar()).alias("scene"))
    scenes = t.benchmark.select(F.col("item_id").alias("scene"), "text")
    who = people(t).select("o_orderkey", "name", "gender", "nationality")
    f = fill_actor_observer(scores.join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(scenes, "scene"))
    f = f.withColumn("pa", F.col("a") / F.col("all")).withColumn("pb", F.col("b") / F.col("all"))
    first = F.when(F.col("pa").isNotNull(), F.when(F.col("pa") >= F.col("pb"), 1).otherwise(2))
    return f.select(*TRIAL_KEY, "scene", "scenario", O.letter(first).alias("chosen_letter"),
                    F.when(first == 1, F.col("option1")).when(first == 2, F.col("option2")).alias("chosen_sentence"),
                    round_half_even_2(F.col("pa")).alias("prob_A"), round_half_even_2(F.col("pb")).alias("prob_B"),
                    "gender", "nationality", "name")


_ROWS_SQL = f"""WITH {TRIALS} {SHUF}
, b AS (SELECT max(item_id) + 1 AS nt FROM benchmark),
tm AS (SELECT t0.item_id AS tid, '{{X}} ' || t0.text AS prompt, {", ".join(f"b{k}.text AS o{k}" for k in range(1, 5))}
       FROM benchmark t0, b {" ".join(f"JOIN benchmark b{k} ON b{k}.item_id = (t0.item_id + {k}) % b.nt" for k in range(1, 5))}),
rw AS (SELECT cc.*, pe.gender, pe.nationality, pe.name, tm.tid, replace(tm.prompt, '{{X}}', pe.name) AS initial_prompt,
              tm.o1, tm.o2, tm.o3, tm.o4, {", ".join(f"round_even({e}, 2) AS q{k}" for k, e in enumerate(_NORM, 1))}
       FROM cc JOIN people pe ON cc.l_orderkey = pe.o_orderkey, b JOIN tm ON tm.tid = cc.l_partkey % b.nt),
rs AS (SELECT *, {_at(1, ['q1', 'q2', 'q3', 'q4'])} AS qa, {_at(2, ['q1', 'q2', 'q3', 'q4'])} AS qb,
              {_at(3, ['q1', 'q2', 'q3', 'q4'])} AS qc, {_at(4, ['q1', 'q2', 'q3', 'q4'])} AS qd,
              CASE cpos {" ".join(f"WHEN {p} THEN {_at(p, ['o1', 'o2', 'o3', 'o4'])}" for p in range(1, 5))} END AS chosen_sentence FROM rw)
"""


@register("choice_rows", _ROWS_SQL + f"""
SELECT {K}, mode, replace('{CHOICE_INSTRUCTION}', '{{X}}', name) AS instruction, initial_prompt, chosen_letter, chosen_key, chosen_sentence,
       {", ".join(f"key_{L}" for L in LETTERS)}, qa AS prob_A, qb AS prob_B, qc AS prob_C, qd AS prob_D,
       {GLOBAL_SEED} AS seed, gender, nationality, name,
       q1 AS opt1, q2 AS opt2, q3 AS opt3, q4 AS opt4, {r6('q1 + q2 - q3 - q4', 'metric')}
FROM rs
""")
def choice_rows(t):
    """The full scored row of every trial: filled texts, the shuffled view
    (keys and rounded probabilities by letter), first argmax on unrounded
    scores, the chosen sentence, the options' probabilities in fixed order and
    the metric.  A row without scores keeps its texts and chooses nothing."""
    nt = t.benchmark.agg(F.max("item_id") + 1).scalar()
    li = trial_lines(t).select(*TRIAL_KEY, "mode", *[f"s{k}" for k in range(1, 5)], (F.col("l_partkey") % nt).alias("template_id"))
    who = people(t).select("o_orderkey", "name", "gender", "nationality")
    rows = (li.join(who, F.col("l_orderkey") == F.col("o_orderkey")).join(templates(t).drop("gender"), "template_id"))
    total = F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")
    rows = fill_choice(rows).select("*", *[round_half_even_2(F.col(f"s{k}") / total).alias(f"opt{k}") for k in range(1, 5)])
    keys = [option_key(F.col("mode"), F.lit(k)) for k in range(1, 5)]
    fields = {n: [F.col(f"{c}{k}") for k in range(1, 5)] for n, c in (("score", "s"), ("prob", "opt"), ("text", "o"))}
    rows = rows.withColumn("_sh", O.shuffle_options(trial_id(), keys, fields, GLOBAL_SEED))
    rows = rows.withColumn("_pos", O.first_argmax_pos(F.col("_sh")))
    ch = F.get(F.col("_sh"), (F.col("_pos") - 1).cast("int"))
    at = lambda i, what: F.get(F.col("_sh"), F.lit(i))[what]
    out = rows.select(*TRIAL_KEY, "mode", "instruction", "initial_prompt", O.letter(F.col("_pos")).alias("chosen_letter"),
                      ch["key"].alias("chosen_key"), ch["text"].alias("chosen_sentence"),
                      *[at(i, "key").alias(f"key_{L}") for i, L in enumerate(LETTERS)],
                      *[at(i, "prob").alias(f"prob_{L}") for i, L in enumerate(LETTERS)],
                      F.lit(GLOBAL_SEED).alias("seed"), "gender", "nationality", "name", "opt1", "opt2", "opt3", "opt4")
    return round_doubles(out.withColumn("metric", internal_external(*[F.col(f"opt{k}") for k in range(1, 5)])))
