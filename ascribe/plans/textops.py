"""Text extraction, literal decoding, defaults and failure side tables (stage 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import latter_text as latter
from ..functions.text import response_extract as extract
from ..schemas import DEFAULT_INSTRUCTION, NO_RESPONSE, RESPONSE_MARKER, SECTION_MARKER
from ..sources.results import decode_literal, failed_side_table
from ..operators import generate as G
from ..operators.scoring import generate_column
from ..operators.trials import TRIAL_KEY
from .registry import register
from .sql import TRIALS

_STRIP = "regexp_replace({x}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x=x)


@register("latter_text", """
SELECT doc_id, regexp_extract(text, '(?s)^[ \\t\\r\\n]*[^ \\t\\r\\n]+[ \\t\\r\\n]+(.*)$', 1) AS latter FROM documents
""")
def latter_text(t):
    """P7 + F2: the whole text after its first whitespace-delimited token."""
    return t.documents.select("doc_id", latter("text").alias("latter"))


@register("response_extract", f"""
WITH a AS (SELECT doc_id, CASE WHEN contains(text, '{RESPONSE_MARKER}')
                          THEN {_strip(f"split_part(text, '{RESPONSE_MARKER}', 2)")} ELSE text END AS a
           FROM documents)
SELECT doc_id, {_strip(f"split_part(a, '{SECTION_MARKER}', 1)")} AS response FROM a
""")
def response_extract(t):
    """Text after the response marker, cut at the next section, stripped."""
    return t.documents.select("doc_id", extract("text").alias("response"))


@register("decode_props", """
WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS prop_key FROM events)
SELECT event_id, prop_key, CAST(json_extract_string(props, '$."' || prop_key || '"') AS BIGINT) AS prop_value FROM k
""")
def decode_props(t):
    """A serialised dict column decoded into (key, value) rows."""
    m = decode_literal(F.col("props"), "map<string,bigint>")
    return t.events.select("event_id", F.explode(m).alias("prop_key", "prop_value"))


@register("failed_rows", """
SELECT d.doc_id, d.source, 'no score for document ' || CAST(d.doc_id AS VARCHAR) AS error
FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id
""")
def failed_rows(t):
    """P14 + X7: rows whose score is missing, kept in a side table with the
    reason (the scored table itself keeps only non-NULL scores)."""
    scored = t.documents.select("doc_id", "source").join(
        t.labels.select("doc_id", F.col("quality").alias("score")), "doc_id", "left")
    _, failed = failed_side_table(scored, "score", F.concat(F.lit("no score for document "),
                                                              F.col("doc_id").cast("string")))
    return failed.select("doc_id", "source", "error")


@register("default_fill", f"""
SELECT conv_id,
       coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '{DEFAULT_INSTRUCTION}') AS instruction,
       coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '{NO_RESPONSE}') AS response
FROM conversations GROUP BY conv_id
""")
def default_fill(t):
    """P15 + F15: first user turn as the instruction and first assistant turn
    as the response of each conversation, with the fixed defaults when absent.

    ``min(struct(turn, text))`` keeps O(1) state per group, so a huge
    conversation never gathers its turns in one place."""
    c = t.conversations
    first = {r: F.min(F.when(F.col("role") == r, F.struct("turn", "text")))["text"] for r in ("user", "assistant")}
    return c.groupBy("conv_id").agg(
        F.coalesce(first["user"], F.lit(DEFAULT_INSTRUCTION)).alias("instruction"),
        F.coalesce(first["assistant"], F.lit(NO_RESPONSE)).alias("response"))


def _echo_generator(pdf):
    """Stand-in text generator (pandas, vectorised): like a causal LM decode
    it returns the prompt followed by a continuation; a deployment passes a
    model or a service client here."""
    p = pdf["prompt"]
    return list(p + p.str.replace("\n", " ", regex=False) + "\n### End")


_GEN_SQL = ("WITH " + TRIALS + """,
b AS (SELECT max(item_id) + 1 AS nt FROM benchmark),
g AS (SELECT {K}, replace('{X} ' || bm.text, '{X}', tr.name) || chr(10) || chr(10) || '### Response:' || chr(10) AS prompt
      FROM trials tr, b JOIN benchmark bm ON bm.item_id = tr.l_partkey % b.nt),
o AS (SELECT {K}, prompt || replace(prompt, chr(10), ' ') || chr(10) || '### End' AS text FROM g),
a AS (SELECT {K}, CASE WHEN contains(text, '{RM}') THEN {S1} ELSE text END AS a FROM o)
SELECT {K}, {S2} AS response, CAST(NULL AS VARCHAR) AS error FROM a
""").replace("{K}", ", ".join(TRIAL_KEY)).replace("{RM}", RESPONSE_MARKER).replace(
    "{S1}", _strip(f"split_part(text, '{RESPONSE_MARKER}', 2)")).replace(
    "{S2}", _strip(f"split_part(a, '{SECTION_MARKER}', 1)"))


@register("generated_responses", _GEN_SQL)
def generated_responses(t):
    """X4 + P21 + F3-F5: minimal prompts of every trial through a
    caller-supplied generator (Arrow batches), then the response cut out of
    the decoded text (after the response marker, before the next section)."""
    g = G.fill_choice(G.drawn_trials(t, G.templates(t).drop("gender"), for_texts=True))
    prompt = F.concat(F.col("initial_prompt"), F.lit("\n\n### Response:\n"))
    out = g.select(*TRIAL_KEY, generate_column(_echo_generator, prompt=prompt).alias("_g"))
    return out.select(*TRIAL_KEY, extract(F.col("_g.response")).alias("response"), F.col("_g.error").alias("error"))
