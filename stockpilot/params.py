"""Run parameters.

One frozen object carries every date and threshold a computation needs, so
no operator reads a global clock or module constant.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # as-of date that drives every "days to ..." and every window
    as_of: dt.date = dt.date(1998, 6, 15)
    # last month (first day) of the stock projection
    projection_end: dt.date = dt.date(1999, 2, 1)
    # breach report keeps months <= this 'yyyy-MM' key
    breach_cutoff: str = "1998-12"
    # months of history before the as-of month that the projection shows
    projection_history_months: int = 3
    # policy defaults when a component has no min / max stock
    default_min_stock: int = 100
    default_max_stock: int = 1000
    # free stock ships to the customer in this many days
    free_transit_days: int = 3
    # new orders assume this lead time (weeks) when the master has none
    default_new_order_lt_weeks: int = 20
    # forecast-driven ordering assumes this lead time when the master has none
    default_forecast_lt_weeks: int = 12
    # stock value conversion rate (currency units per USD)
    fx_rate: int = 150
    # the distributor hub's warehouse id (excluded from customer rankings)
    hub_warehouse_id: str = "0"
    # action queue sizes
    queue_orders: int = 20
    queue_lead_time: int = 10
    queue_breaches: int = 10


DEFAULT = Params()
