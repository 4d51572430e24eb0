"""Quality bit sets kept in a long column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_any(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask).cast("long")) != 0


def bit_if(condition: Column, mask: int) -> Column:
    """The mask where the condition holds, else 0."""
    return F.when(condition, F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long"))


def combine(*parts: Column) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def flag_names(flags: Column, vocabulary: list[str]) -> Column:
    """Comma list of the set bits, `none` when no known bit is set."""
    named = F.array(*[F.when(has_any(flags, 1 << i), F.lit(n)) for i, n in enumerate(vocabulary)])
    joined = F.array_join(F.array_compact(named), ",")
    return F.when(joined == "", F.lit("none")).otherwise(joined)
