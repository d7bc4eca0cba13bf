"""Option permutation, letters, argmax choice and letter -> key lookup
(W3-W6, J8, F9, X8).

A trial's four options live in one array column, so permuting, choosing and
mapping letters are per-row expressions: no shuffle on the trial key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import hash_key
from ..schemas import LETTERS


def shuffle_options(trial_id: Column, keys, fields: dict[str, list[Column]], seed) -> Column:
    """Seeded permutation of the options of one trial.

    Each option gets the order key md5(seed|trial|key); sorting the array of
    structs by it gives a permutation that is deterministic, uniform, the same
    on retries and reproducible in SQL.  Returns
    ``array<struct<h, ord, key, letter?, <fields>...>>`` in letter order.
    ``seed`` may be a literal or a column (per-run seeds).
    """
    items = []
    for i, k in enumerate(keys):
        key_c = k if isinstance(k, Column) else F.lit(k)
        cols = [hash_key(seed, trial_id, key_c).alias("h"), F.lit(i + 1).alias("ord"), key_c.alias("key")]
        cols += [vals[i].alias(name) for name, vals in fields.items()]
        items.append(F.struct(*cols))
    # sort_array compares structs field by field with a codegen'd ordering
    # (array_sort goes through an interpreted comparator lambda)
    return F.sort_array(F.array(*items))


def shuffle_texts(trial_id: Column, keys, texts: list[Column], seed) -> Column:
    return shuffle_options(trial_id, keys, {"text": texts}, seed)


def letter(pos: Column) -> Column:
    """1-based position -> 'A', 'B', ... (``chr(64 + pos)``)."""
    return F.char(F.lit(64) + pos)


def letter_map(shuffled: Column, value: str = "key") -> Column:
    """``{letter: <value>}`` for a shuffled option array (D7's mapping)."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in LETTERS]),
                             F.transform(shuffled, lambda o: o[value]))


def first_argmax_pos(shuffled: Column, score: str = "score") -> Column:
    """1-based position of the first maximal score in letter order.

    ``array_position`` returns the first equal element, so ties go to the
    earlier letter, like NumPy's argmax; ``max_by`` would not guarantee it.
    A NULL score makes the trial a failed row: the position is NULL.
    """
    scores = F.transform(shuffled, lambda o: o[score])
    known = ~F.exists(scores, lambda s: s.isNull())
    return F.when(known, F.array_position(scores, F.array_max(scores)))
