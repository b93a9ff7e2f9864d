"""Reasons as columns: rejected rows say why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def every_reason(rules: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds, in the order given. A null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(code)) for code, c in rules.items()]))


def first_reason(rules: dict[str, Column]) -> Column:
    """The first code whose condition holds, else null."""
    return F.coalesce(*[F.when(c, F.lit(code)) for code, c in rules.items()])


def ratio(a: Column, b: Column) -> tuple[Column, Column]:
    """a / b and the reason why there is none: the input is missing only if a is, else the denominator is missing or zero."""
    reason = first_reason({"INPUT_MISSING": a.isNull(), "DENOMINATOR_MISSING_OR_ZERO": b.isNull() | (b == 0)})
    return F.when(reason.isNull(), F.try_divide(a, b)), reason
