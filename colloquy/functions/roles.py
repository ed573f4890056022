"""Roles and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of roles; what is in none of them is an assistant's.
ROLES = {
    "user": ("human", "user", "input"),
    "assistant": ("assistant", "ai", "model", "output", "bot"),
    "system": ("system", "developer"),
    "tool": ("tool", "toolresult", "tool_result", "tool-call", "function"),
}
#: Numbers below are seconds, others milliseconds.
SECONDS_BELOW = 1e12


def normal_role(role: Column) -> Column:
    lower = F.lower(F.coalesce(role, F.lit("")))
    out = F.when(lower.isin(*ROLES["user"]), "user")
    for name in ("assistant", "system", "tool"):
        out = out.when(lower.isin(*ROLES[name]), name)
    return out.otherwise("assistant")


def number_ms(value: Column) -> Column:
    """Milliseconds of a number that may be seconds; null for what isn't finite and positive."""
    scaled = F.when(value < SECONDS_BELOW, value * 1000).otherwise(value)
    return F.when((value > 0) & (value < float("inf")), F.round(scaled).cast("long"))


def epoch_ms(value: Column) -> Column:
    """Milliseconds of a text that holds seconds, milliseconds or an ISO date and time; else null.

    Accepted forms are yyyy-MM-dd and yyyy-MM-dd[T ]HH:mm[:ss[.fff]] with or without a zone; without one it is UTC.
    """
    numeric = value.rlike(r"^\d+(\.\d+)?\z")
    return F.when(numeric, number_ms(value.try_cast("double"))).otherwise(F.unix_millis(F.try_to_timestamp(value)))
