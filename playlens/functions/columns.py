"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results are compared across engines at 6 decimals.
DECIMALS = 6


def round6(c: Column) -> Column:
    return F.round(c.cast("double"), DECIMALS)


def repaired_text(col: str, shadow: str) -> Column:
    """Text that a spreadsheet turned into scientific notation is replaced by
    its exact shadow copy. Matched case-insensitively ('e+' as 'E+'), as a
    case-insensitive collation would."""
    c = F.col(col)
    return F.when(F.upper(c).contains("E+"), F.col(shadow)).otherwise(c)


def success_flag(c: Column) -> Column:
    """Normalised outcome text: 'TRUE' / 'FALSE' / NULL."""
    return F.upper(F.trim(c))


def ratio(num: Column, den: Column) -> Column:
    """num * 1.0 / den as DOUBLE rounded to 6 decimals; NULL when den is 0."""
    return round6(F.try_divide(num.cast("double"), den.cast("double")))


def level_gap_pick(prev_level: Column, next_level: Column, ts: Column, user: Column,
                   batch_index: Column) -> Column:
    """A level strictly between ``prev_level`` and ``next_level``.

    The reference draws it with a fresh random number per run; this picks it
    from an arithmetic hash of the row instead, so that runs and engines
    agree. Requires ``abs(next - prev) > 1``.
    """
    h = ((F.coalesce(ts, F.lit(0)) % 1000003) * 7919
         + (F.coalesce(user, F.lit(0)) % 1000003) * 31
         + F.coalesce(batch_index, F.lit(0)).cast("long"))
    width = F.abs(next_level - prev_level) - 1
    return (F.least(prev_level, next_level) + 1 + F.pmod(h, width.cast("long"))).cast("int")
