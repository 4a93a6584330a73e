"""Text checks, search patterns and identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: what an identifier may hold.
CODE = r"^[0-9A-Za-z_.:-]{1,96}$"


def safe_text(c: Column, most: int, required: bool = True) -> Column:
    """Trimmed text, or null where it is too long, has control characters or is missing."""
    t = F.trim(c)
    ok = (F.length(t) <= most) & ~t.rlike("[\\x00-\\x1f\\x7f]")
    return F.when(ok & (F.length(t) > 0) if required else ok, t)


def safe_code(c: Column) -> Column:
    return F.when(c.rlike(CODE), c)


def like_literal(value: str) -> str:
    """A contains-pattern in which % and _ are ordinary."""
    for mark in ("\\", "%", "_"):
        value = value.replace(mark, "\\" + mark)
    return f"%{value}%"


def contains_any(columns: list[str], values: list[str]) -> Column:
    """Case-blind: one of the columns contains one of the values."""
    out = F.lit(False)
    for c in columns:
        for v in values:
            out = out | F.ilike(F.col(c), F.lit(like_literal(v)), F.lit("\\"))
    return out


def spelling_variants(value: str, swaps: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """The text, the text without white space, and both with each spelling swapped; first come first."""
    base = [value.strip(), "".join(value.split())]
    out = [*base]
    for a, b in swaps:
        out += [v.replace(a, b) for v in base] + [v.replace(b, a) for v in base]
    return [v for v in dict.fromkeys(out) if v]


@F.pandas_udf(T.StringType())
def name_key(names: pd.Series) -> pd.Series:
    """NFKC, case-folded, without white space: no built-in function normalises Unicode."""
    return names.map(lambda s: None if s is None else "".join(unicodedata.normalize("NFKC", s).casefold().split()))


def namespaced_id(provider: Column, kind: str, raw: Column) -> Column:
    """A stable id of bounded length for an id that is unique in its provider only."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(F.concat_ws("\x1f", provider, F.lit(kind), raw), 256), 1, 20))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def control_free(c: Column) -> Column:
    return ~c.rlike("[\\x00-\\x1f\\x7f]")
