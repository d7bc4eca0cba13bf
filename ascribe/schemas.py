"""Fixed values, Spark schemas and the required-column check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- fixed values (must equal the audited pipeline's for identical results) ---
# Option keys per mode, in their canonical order.  Keys 1-2 are internal
# causes (effort, ability), keys 3-4 external ones (task difficulty, luck).
OPTION_KEYS = {
    "Success": ["opt1_higheffort", "opt2_highability", "opt3_easytask", "opt4_goodluck"],
    "Failure": ["opt1_loweffort", "opt2_lowability", "opt3_difficulttask", "opt4_badluck"],
}
ROLES = ["internal", "internal", "external", "external"]
SIGNS = [1.0, 1.0, -1.0, -1.0]
LETTERS = ["A", "B", "C", "D"]
GENDERS = ["male", "female"]
GLOBAL_SEED = 42
SECOND_NAME = "Alex"                      # fixed {Y} of the actor/observer templates
DEFAULT_INSTRUCTION = "No instruction provided"
DEFAULT_PROMPT = "No initial prompt provided"
NO_RESPONSE = "No response"
MISSING_PREFIX = "Missing: "
PERPLEXITY_LOSS_CAP = 20.0                # loss >= 20 -> perplexity = inf
RESPONSE_MARKER = "### Response:"
SECTION_MARKER = "###"
# --- end of fixed values ---

WS = "[ \\t\\r\\n]"   # explicit whitespace class: Java and RE2 differ on \s

OPTION = T.StructType([
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("key", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])

TEMPLATE = T.StructType([
    T.StructField("template_id", T.LongType()),
    T.StructField("mode", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("framing", T.StringType()),
    T.StructField("initial_prompt", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("options", T.ArrayType(OPTION)),
])

# Raw template record as stored in a JSON array file (choice / story).
def raw_template_schema(mode: str) -> T.StructType:
    return T.StructType(
        [T.StructField("initial_prompt", T.StringType()),
         T.StructField("instruction", T.StringType())]
        + [T.StructField(k, T.StringType()) for k in OPTION_KEYS[mode]])


ACTOR_OBSERVER = T.StructType([T.StructField(c, T.StringType()) for c in
                               ("scenario", "dialogue", "question", "option1", "option2")])

NAME_ROW = T.StructType([
    T.StructField("nationality", T.StringType()),
    T.StructField("nat_ord", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("name_ord", T.IntegerType()),
    T.StructField("name", T.StringType()),
])

# One scored choice row (wide option columns are added per mode).
CHOICE_RESULT = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("initial_prompt", T.StringType()),
    T.StructField("chosen_letter", T.StringType()),
    T.StructField("chosen_key", T.StringType()),
    T.StructField("chosen_sentence", T.StringType()),
    T.StructField("shuffled_options", T.StringType()),
    T.StructField("option_probs", T.StringType()),
    T.StructField("run", T.IntegerType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("gender", T.StringType()),
    T.StructField("nationality", T.StringType()),
    T.StructField("name", T.StringType()),
])


def choice_result_schema(mode: str) -> T.StructType:
    fields = list(CHOICE_RESULT.fields)
    fields += [T.StructField(k, T.DoubleType()) for k in OPTION_KEYS[mode]]
    fields.append(T.StructField("metric", T.DoubleType()))
    return T.StructType(fields)


GENERATION_RESULT = T.StructType([
    T.StructField("index", T.IntegerType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("initial_prompt", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("nationality", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("run", T.IntegerType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("response", T.StringType()),
])

PERPLEXITY_RESULT = T.StructType(GENERATION_RESULT.fields + [
    T.StructField("perplexity", T.DoubleType()),
    T.StructField("probability", T.DoubleType()),
])


def require_columns(df: DataFrame, required) -> DataFrame:
    """Raise ``ValueError`` naming the required columns when any is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"need columns {list(required)}, lacking {missing}")
    return df
