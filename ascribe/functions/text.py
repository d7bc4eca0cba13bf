"""Text column functions: placeholders, strip, splits, letter parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RESPONSE_MARKER, SECTION_MARKER, WS


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def fill(text, value, placeholder: str = "{X}") -> Column:
    """Replace every literal ``placeholder`` in ``text`` by ``value``."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.replace(_c(text), F.lit(placeholder), v)


def strip_ws(text) -> Column:
    """Python ``str.strip()`` for space, tab, CR and LF (``trim`` only strips spaces)."""
    return F.regexp_replace(_c(text), f"^{WS}+|{WS}+$", "")


def latter_text(text) -> Column:
    """``s.split(maxsplit=1)[1]`` or '' : everything after the first token.

    Leading whitespace of the remainder is consumed, trailing whitespace kept.
    """
    return F.regexp_extract(_c(text), f"(?s)^{WS}*[^ \\t\\r\\n]+{WS}+(.*)$", 1)


def response_extract(text) -> Column:
    """Keep the text after the first response marker (when present), cut at
    the next section marker and strip it."""
    t = _c(text)
    after = F.when(F.contains(t, F.lit(RESPONSE_MARKER)),
                   strip_ws(F.split_part(t, F.lit(RESPONSE_MARKER), F.lit(2)))).otherwise(t)
    return strip_ws(F.split_part(after, F.lit(SECTION_MARKER), F.lit(1)))


def parse_letter(text, letters: str = "A-D") -> Column:
    """Option letter from a free-text answer, or NULL.

    Anchored on the whole stripped, upper-cased answer (``B``, ``(b)``,
    ``C.``, ``D:``); a loose word match would read the article in
    "A good reason is B" as option A.
    """
    up = F.upper(strip_ws(text))
    pat = f"^[ (]*([{letters}])[ ).:]*$"
    return F.when(up.rlike(pat), F.regexp_extract(up, pat, 1))
