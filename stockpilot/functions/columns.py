"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lead-time bands as (upper bound in weeks, label); the last
# band has no upper bound.
LT_BANDS: tuple[tuple[int | None, str], ...] = (
    (13, "<=13w"),
    (26, "14-26w"),
    (52, "27-52w"),
    (78, "53-78w"),
    (None, ">78w"),
)

# Neutral codes used in place of the display labels.
TREND_UP, TREND_DOWN, TREND_FLAT = "UP", "DOWN", "FLAT"
LEVEL_NONE, LEVEL_LIGHT, LEVEL_MEDIUM, LEVEL_HEAVY = "NONE", "LIGHT", "MEDIUM", "HEAVY"
CERTAIN, EXPECTED, NEGOTIABLE = "CERTAIN", "EXPECTED", "NEGOTIABLE"
PRODUCIBLE, PARTIAL, BLOCKED = "PRODUCIBLE", "PARTIAL", "BLOCKED"
EV_ON_HAND, EV_CONSUMPTION, EV_RECEIPT = "ON_HAND", "CONSUMPTION", "RECEIPT"


def d(day: dt.date) -> Column:
    """Date literal (constant-folded by Catalyst)."""
    return F.lit(day)


def band(value: Column, bands=LT_BANDS) -> Column:
    """Value -> label by ascending inclusive upper bounds."""
    expr = None
    for upper, label in bands:
        if upper is None:
            return expr.otherwise(F.lit(label)) if expr is not None else F.lit(label)
        cond = value <= upper
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def trend(cur: Column, past: Column) -> Column:
    """'' when there is no past value, else UP / DOWN / FLAT."""
    return (
        F.when(past.isNull(), F.lit(""))
        .when(cur > past, F.lit(TREND_UP))
        .when(cur < past, F.lit(TREND_DOWN))
        .otherwise(F.lit(TREND_FLAT))
    )


def clamp(x: Column, lo: int, hi: int) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def month_key(date_col: Column) -> Column:
    """'yyyy-MM' string key of a date."""
    return F.date_format(date_col, "yyyy-MM")


def policy_status(stock: Column, min_qty: Column, max_qty: Column) -> Column:
    return (
        F.when(stock <= 0, F.lit("ZERO"))
        .when(stock < min_qty, F.lit("UNDER"))
        .when(stock > max_qty, F.lit("OVER"))
        .otherwise(F.lit("OK"))
    )


# Display labels of the codes (routes, action levels as the
# dashboard shows them, demand sources).
ROUTE_LABELS = {
    "CUSTOMER_STOCK": "Customer stock",
    "DISTRIBUTOR_FREE": "Free stock",
    "EXISTING_PO": "PO backlog",
    "NEW_ORDER": "New order",
}
LEVEL_LABELS = {"NONE": "OK", "LIGHT": "Medium", "MEDIUM": "High", "HEAVY": "Critical"}
SOURCE_LABELS = {"FCST_AUTO": "Auto from sales forecast", "EMERGENCY_MANUAL": "Emergency manual entry"}


def label(code: Column, mapping: dict[str, str]) -> Column:
    """Code -> display label through a literal map (unknown codes stay as is)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, code), code)
