"""Deal arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gross_spread(offer: Column, current: Column) -> Column:
    return F.try_divide(offer - current, current)


def break_adjusted_ev(offer: Column, current: Column, unaffected: Column, p_break: Column) -> Column:
    """Expected gain per share: the upside if the deal closes, the downside if it breaks."""
    return (1 - p_break) * (offer - current) - p_break * (current - unaffected)


def breakeven_p(upside: Column, downside: Column) -> Column:
    """The break probability at which the expected value is zero."""
    return F.try_divide(upside, upside + downside)


def offer_value(kind: Column, cash: Column, ratio: Column, acquirer: Column) -> tuple[Column, Column]:
    """Value per share of what is offered, and what it rests on; null where an input is missing."""
    value = F.when(kind == "cash", cash).when(kind == "stock", ratio * acquirer).when(kind == "mixed", cash + ratio * acquirer)
    basis = F.when(kind.isin("cash", "stock", "mixed"), kind).otherwise("unknown_consideration")
    return value, basis


def price_agreement(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """EXACT, TOLERABLE or CONFLICT."""
    gap, scale = F.abs(a - b), F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
    return F.when(a == b, "EXACT").when((gap <= absolute) | (gap / scale <= relative), "TOLERABLE").otherwise("CONFLICT")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    """ln(p / (1 - p)) of a probability kept off 0 and 1 by 1e-9."""
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.ln(q / (1 - q))


def log_value(x: Column) -> Column:
    """ln of a positive amount; null otherwise."""
    return F.when(x > 0, F.ln(x))
