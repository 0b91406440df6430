"""Table-level analytics re-aimed from the application layer: forecast
ordering risk, available stock, KPI counters, demand views, commit lists,
coverage and capacity metrics.  Every function is a lazy DataFrame over
whole tables; all per-component inputs are pre-aggregated before joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockpilot.functions.columns import d
from stockpilot.operators.summary import items_by_flag
from stockpilot.params import Params

L = "bigint"
FCST, EMERGENCY = "FCST_AUTO", "EMERGENCY_MANUAL"
# Status lists used by the stock analytics.
ALLOCATING_ORDER_STATUS = ("open", "confirmed", "shipped_partial", "in_production")
BACKLOG_ORDER_STATUS = ("confirmed", "picking", "backorder")
INCOMING_PO_STATUS = ("placed", "acknowledged", "in_production", "shipped", "partial_received")


def _fold(parts: list[DataFrame]) -> DataFrame:
    """Stack one-row aggregates and fold them into one row (no cross join)."""
    cols = [c for p in parts for c in p.columns]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def forecast_status(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit("Normal"))
        .when(days <= 3, F.lit("Critical"))
        .when(days <= 7, F.lit("High"))
        .when(days <= 14, F.lit("Medium"))
        .otherwise(F.lit("Normal"))
    )


def forecast_risk(
    forecasts: DataFrame,
    bom: DataFrame,
    components: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    purchase_orders: DataFrame,
    p: Params,
) -> DataFrame:
    """Forecast exploded through the BOM; order-by date = month - 7 * LT;
    ordered = all outstanding PO quantity of the component (not netted
    between forecast rows); status by days left.

    The masters join the BOM rows, and the forecast months come last: no row
    of the result, which has many per BOM row, goes through a shuffle.  The
    BOM rows are dealt over all tasks before, since the few bytes that they
    have say nothing of the rows that come from them."""
    comp = components.select(
        "component_id", "part_number", "component_name", "component_category", "supplier_name",
        F.coalesce(F.col("base_lead_time_weeks"), F.lit(p.default_forecast_lt_weeks)).alias("base_lead_time_weeks"),
    )
    prod = products.select("product_id", "product_name", F.col("customer_id").alias("prod_customer_id"))
    cust = customers.select(F.col("customer_id").alias("prod_customer_id"), "customer_name")
    po = purchase_orders.groupBy("component_id").agg(F.sum("outstanding_qty").cast(L).alias("ordered"))
    # products are few: the customer joins them, not the BOM rows
    prod = prod.join(cust, "prod_customer_id", "left")
    tasks = int(forecasts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    used = (
        bom.select("product_id", "component_id", "quantity_per_unit")
        .join(comp, "component_id", "left")
        .join(po, "component_id", "left")
        .join(prod, "product_id", "left")
        .repartition(tasks, "product_id", "component_id")
    )
    j = used.join(forecasts.select("product_id", "forecast_month", "forecast_qty"), "product_id")
    demand = (F.coalesce(F.col("forecast_qty"), F.lit(0)) * F.coalesce(F.col("quantity_per_unit"), F.lit(1))).cast(L)
    ord_date = F.date_sub("forecast_month", F.col("base_lead_time_weeks") * 7)
    days = F.datediff(ord_date, d(p.as_of))
    ordered = F.coalesce(F.col("ordered"), F.lit(0).cast(L))
    return j.select(
        "product_id", "component_id", "customer_name", "product_name", "part_number", "component_name",
        "component_category", "supplier_name", "forecast_month", demand.alias("component_demand_qty"),
        "base_lead_time_weeks", ord_date.alias("order_required_date"), days.alias("days_remaining"),
        ordered.alias("ordered_qty"), F.greatest(F.lit(0).cast(L), demand - ordered).alias("unordered_qty"),
        forecast_status(days).alias("status"),
    )


def available_stock(components: DataFrame, stock: DataFrame, sales_orders: DataFrame, p: Params) -> DataFrame:
    """On hand minus allocated (open-type orders); spot capacity; status
    Shortage (<0), Low (< min stock, default 100), Available."""
    alloc = (
        sales_orders.filter(F.col("status").isin(*ALLOCATING_ORDER_STATUS))
        .groupBy("component_id")
        .agg(F.sum(F.coalesce("component_required_qty", F.lit(0))).cast(L).alias("allocated"))
    )
    c = components.select(
        "component_id", "part_number", "component_name", "component_category", "supplier_name",
        F.coalesce(F.col("min_stock"), F.lit(p.default_min_stock)).alias("min_stock"),
    )
    j = c.join(stock, "component_id", "left").join(alloc, "component_id", "left")
    on_hand = F.coalesce(F.col("stock"), F.lit(0).cast(L))
    allocated = F.coalesce(F.col("allocated"), F.lit(0).cast(L))
    avail = on_hand - allocated
    status = F.when(avail < 0, F.lit("Shortage")).when(avail < F.col("min_stock"), F.lit("Low")).otherwise(
        F.lit("Available")
    )
    return j.select(
        "component_id", "part_number", "component_name", "component_category", "supplier_name", "min_stock",
        on_hand.alias("month_end_inventory"), allocated.alias("allocated_qty"), avail.alias("available_inventory"),
        F.greatest(avail, F.lit(0).cast(L)).alias("spot_order_capacity"), status.alias("inventory_status"),
    )


def overview_kpis(frisk: DataFrame, delivery: DataFrame, avail: DataFrame, balance: DataFrame) -> DataFrame:
    """Ten counters over the four risk views, as one row."""
    s, ds, inv = F.col("status"), F.col("delivery_status"), F.col("inventory_status")
    one = _fold([
        frisk.agg(
            F.count_if(s == "Critical").alias("forecast_critical"),
            F.count_if(s == "High").alias("forecast_high"),
            F.count_if(s == "Medium").alias("forecast_medium"),
        ),
        delivery.agg(
            F.count_if(ds == "Critical").alias("delivery_critical"),
            F.count_if(ds == "High").alias("delivery_high"),
            F.count_if(ds == "Medium").alias("delivery_medium"),
            F.count_if(F.col("days_to_delivery") < 0).alias("delivery_overdue"),
        ),
        avail.agg(
            F.count_if(inv == "Shortage").alias("inventory_shortage"),
            F.count_if(inv == "Low").alias("inventory_low"),
        ),
        balance.agg(F.count_if(F.col("balance_status") == "SHORT").alias("months_with_shortage")),
    ])
    return one.select(*[F.col(c).cast(L).alias(c) for c in one.columns])


def filter_period(df: DataFrame, date_col: str, p: Params, period_days: int, past_buffer_days: int = 30) -> DataFrame:
    """Rows dated in [T - buffer, T + period]."""
    T = d(p.as_of)
    return df.filter(F.col(date_col).between(F.date_sub(T, past_buffer_days), F.date_add(T, period_days)))


def demand_kpis(demand: DataFrame, p: Params, period_days: int = 90) -> DataFrame:
    """Total, emergency, due in [T, T+30], overdue -- over the period filter."""
    T = d(p.as_of)
    f = filter_period(demand, "requested_date", p, period_days)
    rd = F.col("requested_date")
    return f.agg(
        F.count(F.lit(1)).cast(L).alias("total"),
        F.count_if(F.col("source_type") == EMERGENCY).cast(L).alias("emergency"),
        F.count_if(rd.between(T, F.date_add(T, 30))).cast(L).alias("upcoming_30d"),
        F.count_if(rd < T).cast(L).alias("overdue"),
    )


def stock_kpis(inventory_current: DataFrame, free_inventory: DataFrame) -> DataFrame:
    return _fold([
        inventory_current.agg(
            F.coalesce(F.sum("stock_qty"), F.lit(0)).cast(L).alias("customer_total_qty"),
            F.count_distinct("component_id").cast(L).alias("customer_components"),
        ),
        free_inventory.agg(
            F.coalesce(F.sum("qty_available"), F.lit(0)).cast(L).alias("free_total_qty"),
            F.count_distinct("component_id").cast(L).alias("free_components"),
        ),
    ])


# Due buckets (label, lower bound, upper bound) in days.
DUE_BUCKETS = (
    ("overdue", None, -1),
    ("d0_3", 0, 3),
    ("d0_7", 0, 7),
    ("d0_14", 0, 14),
    ("d0_30", 0, 30),
    ("d0_60", 0, 60),
    ("d0_90", 0, 90),
)


def due_bucket_counts(order_risk: DataFrame) -> DataFrame:
    """Order lines per due bucket (nested buckets, as the page filters)."""
    days = F.col("days_to_due")
    aggs = []
    for label, lo, hi in DUE_BUCKETS:
        cond = days <= hi if lo is None else days.between(lo, hi)
        aggs.append(F.count_if(cond).cast(L).alias(label))
    return order_risk.agg(*aggs)


def search(df: DataFrame, term: str, cols: list[str]) -> DataFrame:
    """Case-insensitive literal substring match over any of ``cols``."""
    t = F.lit(term.lower())
    cond = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), t), F.lit(False))
                                      for c in cols])
    return df.filter(cond)


def monthly_demand(demand: DataFrame, p: Params, months_ahead: int = 6) -> DataFrame:
    """Demand from T to T + 30 * months, per month and source (pivot) with
    a row total."""
    T = d(p.as_of)
    f = demand.filter(F.col("requested_date").between(T, F.date_add(T, months_ahead * 30)))
    piv = (
        f.groupBy(F.date_format("requested_date", "yyyy-MM").alias("month"))
        .pivot("source_type", [FCST, EMERGENCY])
        .agg(F.sum("requested_qty"))
    )
    fc = F.coalesce(F.col(FCST), F.lit(0)).cast(L)
    em = F.coalesce(F.col(EMERGENCY), F.lit(0)).cast(L)
    return piv.select("month", fc.alias("fcst_auto_qty"), em.alias("emergency_qty"), (fc + em).alias("total_qty"))


def forecast_accuracy(forecasts: DataFrame, actuals: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """Per product over months up to the as-of month:
    (1 - |sum F - sum A| / max(sum F, 1)) * 100, with sums and difference."""
    cutoff = F.trunc(d(p.as_of), "MM")
    fc = forecasts.filter(F.col("forecast_month") <= cutoff).select(
        "product_id", F.col("forecast_month").alias("month"), "forecast_qty"
    )
    ac = actuals.filter(F.col("month") <= cutoff).select("product_id", "month", "actual_qty")
    j = fc.join(ac, ["product_id", "month"], "left")
    g = j.groupBy("product_id").agg(
        F.coalesce(F.sum("forecast_qty"), F.lit(0)).cast(L).alias("forecast_total"),
        F.coalesce(F.sum("actual_qty"), F.lit(0)).cast(L).alias("actual_total"),
    )
    f, a = F.col("forecast_total"), F.col("actual_total")
    acc = F.round((1 - F.abs(f - a) / F.greatest(f, F.lit(1)).cast("double")) * 100, 1)
    return g.join(products.select("product_id", "product_name"), "product_id", "left").select(
        "product_id", "product_name", "forecast_total", "actual_total", (a - f).alias("difference"),
        acc.alias("accuracy_pct"),
    )


def commit_list(order_risk: DataFrame, k: int = 100) -> DataFrame:
    """Order list by priority then days to due (NULL days sort as 0), one
    row per order, first k.  The per-order pick is a partial aggregate."""
    r = F.col("priority_rank")
    prio = F.when(r == "Critical", 0).when(r == "High", 1).when(r == "Mid", 2).when(r == "Low", 3).otherwise(9)
    days0 = F.coalesce(F.col("days_to_due"), F.lit(0))
    keyed = order_risk.select(
        "sales_order_id",
        F.struct(prio.alias("prio"), days0.alias("days"), F.col("component_id").alias("cid")).alias("k"),
        F.struct("customer_name", "product_name", "part_number", "component_id", "adjustment_action",
                 "priority_rank", days0.alias("days_to_due"),
                 F.coalesce(F.col("remaining_qty"), F.lit(0)).alias("remaining_qty")).alias("v"),
    )
    one = keyed.groupBy("sales_order_id").agg(F.min_by("v", "k").alias("v"), F.min("k").alias("k"))
    return (
        one.orderBy(F.col("k.prio"), F.col("k.days"), F.col("sales_order_id"))
        .limit(k)
        .select("sales_order_id", "v.*")
    )


def best_route_per_component(options: DataFrame) -> DataFrame:
    """Per component, the route row with the smallest shortage over all its
    demands (ties: demand id, then route order)."""
    rank = F.when(F.col("route_type") == "CUSTOMER_STOCK", 0).when(F.col("route_type") == "DISTRIBUTOR_FREE", 1).when(
        F.col("route_type") == "EXISTING_PO", 2
    ).otherwise(3)
    o = options.select(
        "component_id",
        F.struct(F.coalesce(F.col("shortage_qty"), F.lit(0).cast(L)).alias("s"), F.col("demand_id").alias("d"),
                 rank.alias("r")).alias("k"),
        F.struct("route_type", "available_qty", "shortage_qty", "action_level").alias("v"),
    )
    return o.groupBy("component_id").agg(F.min_by("v", "k").alias("v")).select("component_id", "v.*")


def critical_lines(order_risk: DataFrame, k: int = 10) -> DataFrame:
    """The k Critical order lines that are due first."""
    return order_risk.filter(F.col("priority_rank") == "Critical").orderBy(
        F.coalesce(F.col("days_to_due"), F.lit(0)), "sales_order_id", "component_id"
    ).limit(k)


def commit_bottleneck(order_risk: DataFrame, options: DataFrame, k: int = 10) -> DataFrame:
    """Top-k Critical order lines by days to due, each with the best route of
    its component and who/what advice; stock versus required quantity.
    ``options`` needs the rows of these lines' components only."""
    crit = critical_lines(order_risk, k)
    best = best_route_per_component(options)
    j = crit.join(best, "component_id", "left")
    req = F.coalesce(F.col("component_required_qty"), F.lit(0)).cast(L)
    stock = F.coalesce(F.col("current_customer_stock"), F.lit(0)).cast(L)
    avail = F.coalesce(F.col("available_qty"), F.lit(0)).cast(L)
    short = req - avail
    lv = F.col("action_level")
    has_route = F.col("route_type").isNotNull()
    who = (
        F.when(~has_route, F.col("adjustment_action"))
        .when((lv == "NONE") | (short <= 0), F.lit("NO_ACTION"))
        .when(lv.isin("LIGHT", "MEDIUM"), F.lit("CONTACT_DISTRIBUTOR_SALES"))
        .otherwise(F.lit("EMERGENCY_ORDER_REQUEST"))
    )
    what = (
        F.when(~has_route, F.col("risk_reason"))
        .when((lv == "NONE") | (short <= 0), F.lit("covered by customer stock"))
        .when(lv.isin("LIGHT", "MEDIUM") & (F.col("route_type") == "DISTRIBUTOR_FREE"),
              F.concat(F.lit("allocate free stock "), avail.cast("string"), F.lit(" pcs today")))
        .when(lv.isin("LIGHT", "MEDIUM"), F.lit("expedite the open PO this week"))
        .otherwise(F.concat(F.lit("new order needed, short "), F.greatest(short, F.lit(0).cast(L)).cast("string"),
                            F.lit(" pcs")))
    )
    status = F.when(stock >= req, F.lit("OK")).otherwise(
        F.concat(F.lit("SHORT "), F.greatest(F.lit(0).cast(L), req - stock).cast("string"))
    )
    return j.select(
        "sales_order_id", "component_id", "part_number", "days_to_due", req.alias("required_qty"),
        stock.alias("customer_stock"), F.col("route_type").alias("best_route"), avail.alias("route_available_qty"),
        F.col("action_level").alias("route_action_level"), who.alias("action_who"), what.alias("action_what"),
        status.alias("stock_status"),
    )


# -- coverage, capacity and stock balance metrics ------------------------------------


def forecast_component_monthly(forecasts: DataFrame, bom: DataFrame) -> DataFrame:
    """Forecast demand per (component, month): pre-aggregated per (product,
    month), then exploded through the BOM and summed."""
    fp = forecasts.groupBy("product_id", "forecast_month").agg(F.sum("forecast_qty").alias("fq"))
    j = fp.join(bom.select("product_id", "component_id", "quantity_per_unit"), "product_id")
    return j.groupBy("component_id", "forecast_month").agg(
        F.sum(F.col("fq") * F.col("quantity_per_unit")).cast(L).alias("qty")
    )


def daily_demand(components: DataFrame, comp_monthly: DataFrame, p: Params) -> DataFrame:
    """3-month forecast demand from the as-of month (4 month starts, both
    ends included) and the daily rate = demand / 90."""
    start = F.trunc(d(p.as_of), "MM")
    m = comp_monthly.filter(F.col("forecast_month").between(start, F.add_months(start, 3)))
    g = m.groupBy("component_id").agg(F.sum("qty").alias("demand_3m"))
    j = components.select("component_id").join(g, "component_id", "left")
    dm = F.coalesce(F.col("demand_3m"), F.lit(0)).cast(L)
    return j.select("component_id", dm.alias("demand_3m"), F.round(dm / 90.0, 6).alias("daily_demand"))


def backlog(components: DataFrame, sales_orders: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    """Order backlog (confirmed/picking/backorder) and incoming PO quantity
    per component, from one union + group-by."""
    so = sales_orders.filter(F.col("status").isin(*BACKLOG_ORDER_STATUS)).select(
        "component_id", F.col("component_required_qty").cast(L).alias("so"), F.lit(None).cast(L).alias("po")
    )
    po = purchase_orders.filter(F.col("status").isin(*INCOMING_PO_STATUS)).select(
        "component_id", F.lit(None).cast(L).alias("so"), F.col("outstanding_qty").cast(L).alias("po")
    )
    g = so.unionByName(po).groupBy("component_id").agg(F.sum("so").alias("so"), F.sum("po").alias("po"))
    j = components.select("component_id").join(g, "component_id", "left")
    return j.select(
        "component_id",
        F.coalesce(F.col("so"), F.lit(0).cast(L)).alias("so_backlog"),
        F.coalesce(F.col("po"), F.lit(0).cast(L)).alias("po_incoming"),
    )


def effective_stock(backlog_df: DataFrame, stock: DataFrame) -> DataFrame:
    j = backlog_df.join(stock, "component_id", "left")
    st = F.coalesce(F.col("stock"), F.lit(0).cast(L))
    return j.select(
        "component_id", st.alias("stock"), "po_incoming", "so_backlog",
        (st + F.col("po_incoming") - F.col("so_backlog")).alias("effective_stock"),
    )


def peak_consumption(comp_monthly: DataFrame, p: Params) -> DataFrame:
    """Peak monthly forecast consumption per component over months after T."""
    return (
        comp_monthly.filter(F.col("forecast_month") > d(p.as_of))
        .groupBy("component_id")
        .agg(F.max("qty").alias("peak_monthly_qty"))
    )


def route_capacity(
    components: DataFrame, stock: DataFrame, free_inventory: DataFrame, purchase_orders: DataFrame
) -> DataFrame:
    """Customer, free and open-PO quantity per component, their total and
    the largest single route."""
    z = F.lit(None).cast(L)
    rows = (
        stock.select("component_id", F.col("stock").alias("cust"), z.alias("free"), z.alias("po"))
        .unionByName(free_inventory.select("component_id", z.alias("cust"), F.col("qty_available").cast(L).alias("free"),
                                           z.alias("po")))
        .unionByName(purchase_orders.filter(F.col("outstanding_qty") > 0).select(
            "component_id", z.alias("cust"), z.alias("free"), F.col("outstanding_qty").cast(L).alias("po")))
    )
    g = rows.filter(F.col("component_id").isNotNull()).groupBy("component_id").agg(
        F.sum("cust").alias("cust"), F.sum("free").alias("free"), F.sum("po").alias("po")
    )
    j = components.select("component_id").join(g, "component_id", "left")
    c, f, po = [F.coalesce(F.col(x), F.lit(0).cast(L)) for x in ("cust", "free", "po")]
    return j.select(
        "component_id", c.alias("cust_qty"), f.alias("free_qty"), po.alias("po_qty"),
        (c + f + po).alias("total_cap"), F.greatest(c, f, po).alias("max_single_route"),
    )


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """num / den rounded half away from zero to ``digits`` places, in exact
    integer arithmetic (den > 0), so every engine gives the same double."""
    scale = 10**digits
    a = F.abs(num).cast(L)
    q = (F.lit(2 * scale) * a + den).cast(L)
    q = F.floor(q.cast("decimal(38,0)") / (F.lit(2) * den).cast("decimal(38,0)"))
    return F.signum(num) * q / float(scale)


def coverage_weeks(proj: DataFrame, p: Params) -> DataFrame:
    """Current stock / mean weekly use, where weekly use = mean monthly
    production use over the projection months from the as-of month on,
    * 12 / 52.  Ratios are rounded in integer arithmetic."""
    cur = F.lit(p.as_of.strftime("%Y-%m"))
    # one pass: the current month's stock is a conditional aggregate of the
    # same group (one row per item and month)
    j = proj.filter(F.col("month_end_date") >= cur).groupBy("item_id").agg(
        F.sum("production_use_qty").cast(L).alias("s"),
        F.count(F.lit(1)).cast(L).alias("n"),
        F.max(F.when(F.col("month_end_date") == cur, F.col("customer_stock_proj"))).alias("stock_now"),
    )
    s, n, st = F.col("s"), F.col("n"), F.col("stock_now")
    return j.select(
        "item_id",
        "stock_now",
        F.when(n > 0, round_ratio(s * 12, n * 52, 2)).alias("weekly_use"),
        F.when(s > 0, round_ratio(st * 52 * n, s * 12, 1)).alias("coverage_weeks"),
    )


def breach_3m(brc: DataFrame, p: Params) -> DataFrame:
    """Items breaching within the next three months (as-of month through
    as-of month + 3): any type, ZERO, OVER."""
    lo = p.as_of.strftime("%Y-%m")
    y, m = divmod(p.as_of.month - 1 + 3, 12)
    hi = f"{p.as_of.year + y:04d}-{m + 1:02d}"
    b = brc.filter(F.col("breach_date").between(lo, hi))
    t = F.col("breach_type")
    return items_by_flag(b, breach_items_3m=F.lit(True), stockout_items_3m=t == "ZERO", excess_items_3m=t == "OVER")


def filter_lists(df: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Global filter: for every non-empty list whose column exists, keep
    rows whose value is in the list (``isin`` on literals)."""
    out = df
    for col, values in lists.items():
        if values and col in df.columns:
            out = out.filter(F.col(col).isin(*values))
    return out


def actual_forecast_flag(df: DataFrame, date_col: str, p: Params) -> DataFrame:
    """Row flag: ACTUAL when dated on or before T, else FORECAST (undated
    rows are FORECAST)."""
    on_or_before = F.coalesce(F.col(date_col) <= d(p.as_of), F.lit(False))
    return df.withColumn("phase", F.when(on_or_before, F.lit("ACTUAL")).otherwise(F.lit("FORECAST")))


def split_actual_forecast(df: DataFrame, date_col: str, p: Params) -> tuple[DataFrame, DataFrame]:
    """(rows dated <= T, rows dated >= T): T itself is in both."""
    T = d(p.as_of)
    return df.filter(F.col(date_col) <= T), df.filter(F.col(date_col) >= T)


def items_with_status(proj: DataFrame, status: str) -> DataFrame:
    """All projection rows of the items that have at least one row with
    ``status``.  A per-item window flag instead of a semi join of the
    projection with itself: one pass, on the item partitioning the
    projection already has (a dozen rows per item)."""
    from pyspark.sql import Window

    hit = F.max((F.col("policy_status") == status).cast("int")).over(Window.partitionBy("item_id"))
    return proj.withColumn("_hit", hit).filter(F.col("_hit") == 1).drop("_hit")


def busiest_item(rows: DataFrame) -> DataFrame:
    """The item with the most rows of a ledger or of its events (ties:
    smallest id), picked by Spark: top-1 of a grouped count."""
    n = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "item_id").limit(1).select("item_id")


def busiest_item_ledger(tl: DataFrame) -> DataFrame:
    """Ledger of the item with the most events, in ledger order -- the
    per-item drill-down, with the item joined back; nothing goes through the
    driver."""
    return tl.join(busiest_item(tl), "item_id", "left_semi")


def whatif_verdicts(wf: DataFrame) -> DataFrame:
    """One row per scenario: overall verdict, remaining gap and the verdict
    of each route side by side (pivot over the four fixed routes)."""
    routes = ["CUSTOMER_STOCK", "DISTRIBUTOR_FREE", "EXISTING_PO", "NEW_ORDER"]
    piv = wf.groupBy("scenario_id", "overall_verdict", "gap_after_three_routes").pivot("route_type", routes).agg(
        F.max("route_verdict")
    )
    return piv.select(
        "scenario_id", "overall_verdict", "gap_after_three_routes",
        *[F.col(r).alias(f"{r.lower()}_verdict") for r in routes],
    )
