"""Prompt rendering for each framing (P18-P22) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: prompt formats of the audited experiments ---
CHOICE_HEAD = ("Below is an instruction and a statement paired with multiple-choice options."
               "Respond by choosing one of the provided options as the reason to the statement.")
CHOICE_HEAD_SPACED = ("Below is an instruction and a statement paired with multiple-choice options. "
                      "Respond by choosing one of the provided options as the reason to the statement.")
STORY_HEAD = ("Below is an instruction and an incomplete story paired with multiple possible completions."
              "Complete the story by choosing one of the provided options.")
CONTINUATION_HEAD = ("Below is an incomplete story with multiple possible completions."
                     "Continue the story after the word 'because' by using one of the following completions.")
REMOTE_HEAD = "Below is an instruction and a statement paired with multiple-choice options."
REMOTE_TAIL = "ONLY respond with a single letter (A, B, C, or D)."
ACTOR_HEAD = ("Below is a scenario and a dialogue paired with a question. "
              "Respond by choosing one of the provided options.")
RESPONSE_TAG = "### Response:\n"
INSTRUCTION_TAG = "### Instruction:\n"
STATEMENT_TAG = "### Statement:\n"
OPTIONS_TAG = "Options:\n"
# --- end of fixed values ---

FRAMINGS = ["choice", "choice_spaced", "story", "continuation", "remote", "minimal"]
NL = "\n"


def _lit(s: str) -> Column:
    return F.lit(s)


def options_block(o: list[Column], letters=("A", "B", "C", "D")) -> Column:
    """``A. <o1>\\nB. <o2>\\n...`` with a trailing newline after each option."""
    parts = []
    for letter, text in zip(letters, o):
        parts += [_lit(f"{letter}. "), text, _lit(NL)]
    return F.concat(*parts)


def render_parts(framing: str, instruction: Column, initial_prompt: Column) -> tuple[Column, str, bool]:
    """(text before the options, text after them, whether options are shown)
    of one framing; lets a template table pre-render everything except the
    per-trial option order."""
    instr = F.concat(_lit(INSTRUCTION_TAG), instruction, _lit("\n\n"))
    stmt = F.concat(_lit(STATEMENT_TAG), initial_prompt, _lit("\n\n"))
    heads = {"choice": CHOICE_HEAD, "choice_spaced": CHOICE_HEAD_SPACED, "story": STORY_HEAD,
             "remote": REMOTE_HEAD}
    if framing in heads:
        pre = F.concat(_lit(heads[framing] + "\n\n"), instr, stmt, _lit(OPTIONS_TAG))
        tail = "\n" + REMOTE_TAIL if framing == "remote" else RESPONSE_TAG
        return pre, tail, True
    if framing == "continuation":
        return F.concat(_lit(CONTINUATION_HEAD + "\n\n"), stmt, _lit(OPTIONS_TAG)), RESPONSE_TAG, True
    if framing == "minimal":
        return initial_prompt, "\n\n" + RESPONSE_TAG, False
    raise ValueError(f"unknown framing {framing}")


def template_parts(framing_col: Column, instruction: Column, initial_prompt: Column) -> list[Column]:
    """Per-row framing -> [pre, tail, has_options] columns (CASE over framings)."""
    pre = tail = opt = None
    for fr in FRAMINGS:
        p, tl, o = render_parts(fr, instruction, initial_prompt)
        c = framing_col == fr
        pre = F.when(c, p) if pre is None else pre.when(c, p)
        tail = F.when(c, F.lit(tl)) if tail is None else tail.when(c, F.lit(tl))
        opt = F.when(c, F.lit(o)) if opt is None else opt.when(c, F.lit(o))
    return [pre.alias("pre"), tail.alias("tail"), opt.alias("has_options")]


def render_actor(scenario: Column, dialogue: Column, question: Column, name: Column,
                 other: Column) -> Column:
    """Two-option actor/observer prompt; the options name both speakers."""
    return F.concat(_lit(ACTOR_HEAD + "\n\n"),
                    _lit("### Scenario:\n"), scenario, _lit("\n\n"),
                    _lit("### Dialogue:\n"), dialogue, _lit("\n\n"),
                    _lit("### Question:\n"), question, _lit("\n\n"),
                    _lit(OPTIONS_TAG),
                    _lit("A. What "), name, _lit(" said\n"),
                    _lit("B. What "), other, _lit(" said\n"),
                    _lit(RESPONSE_TAG))


def sql_options_block(o: list[str]) -> str:
    parts = []
    for letter, text in zip("ABCD", o):
        parts.append(f"'{letter}. ' || {text} || chr(10)")
    return " || ".join(parts)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def sql_render(framing: str, instruction: str, initial_prompt: str, o: list[str]) -> str:
    """DuckDB SQL twin of ``render``."""
    instr = f"{_q('### Instruction:' + NL)} || {instruction} || {_q(NL + NL)}"
    stmt = f"{_q('### Statement:' + NL)} || {initial_prompt} || {_q(NL + NL)}"
    ob = sql_options_block(o)
    if framing == "choice":
        return f"{_q(CHOICE_HEAD + NL + NL)} || {instr} || {stmt} || {_q('Options:' + NL)} || {ob} || {_q(RESPONSE_TAG)}"
    if framing == "choice_spaced":
        return f"{_q(CHOICE_HEAD_SPACED + NL + NL)} || {instr} || {stmt} || {_q('Options:' + NL)} || {ob} || {_q(RESPONSE_TAG)}"
    if framing == "story":
        return f"{_q(STORY_HEAD + NL + NL)} || {instr} || {stmt} || {_q('Options:' + NL)} || {ob} || {_q(RESPONSE_TAG)}"
    if framing == "continuation":
        return f"{_q(CONTINUATION_HEAD + NL + NL)} || {stmt} || {_q('Options:' + NL)} || {ob} || {_q(RESPONSE_TAG)}"
    if framing == "remote":
        return f"{_q(REMOTE_HEAD + NL + NL)} || {instr} || {stmt} || {_q('Options:' + NL)} || {ob} || {_q(NL + REMOTE_TAIL)}"
    if framing == "minimal":
        return f"{initial_prompt} || {_q(NL + NL + RESPONSE_TAG)}"
    raise ValueError(framing)


def sql_render_by(framing_col: str, instruction: str, initial_prompt: str, o: list[str]) -> str:
    whens = " ".join(f"WHEN {framing_col} = '{fr}' THEN {sql_render(fr, instruction, initial_prompt, o)}"
                     for fr in FRAMINGS)
    return f"CASE {whens} END"


def sql_render_actor(scenario: str, dialogue: str, question: str, name: str, other: str) -> str:
    return (f"{_q(ACTOR_HEAD + NL + NL)} || {_q('### Scenario:' + NL)} || {scenario} || {_q(NL + NL)} || "
            f"{_q('### Dialogue:' + NL)} || {dialogue} || {_q(NL + NL)} || "
            f"{_q('### Question:' + NL)} || {question} || {_q(NL + NL)} || {_q('Options:' + NL)} || "
            f"'A. What ' || {name} || ' said' || chr(10) || 'B. What ' || {other} || ' said' || chr(10) || "
            f"{_q(RESPONSE_TAG)}")
