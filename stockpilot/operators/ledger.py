"""Signed event ledger with running balance, monthly stock projection,
policy breaches and the inventory views built on them.

The ledger's running sum is a distributed prefix sum over range-partitioned
slices, so a component holding a large share of all events (even on one
day) is never ordered inside one task; see ``timeline``.

The projection runs its window over a dense component x month grid (a
dozen rows per component), built by ``explode`` on each component row
instead of a join, and gets all monthly flows from one union + group-by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockpilot.functions.columns import EV_CONSUMPTION, EV_ON_HAND, EV_RECEIPT, d, month_key, policy_status
from stockpilot.params import Params

# PO statuses that count as inbound (the timeline also counts
# partial_received; the projection does not).
TIMELINE_PO_STATUS = ("placed", "acknowledged", "in_production", "shipped", "partial_received")
PROJECTION_PO_STATUS = ("placed", "acknowledged", "in_production", "shipped")


def events(inventory_current: DataFrame, sales_orders: DataFrame, purchase_orders: DataFrame, p: Params) -> DataFrame:
    T = d(p.as_of)
    on_hand = inventory_current.groupBy("component_id").agg(F.sum("stock_qty").cast("bigint").alias("quantity"))
    on_hand = on_hand.select(
        F.col("component_id").alias("item_id"),
        T.alias("event_date"),
        F.lit(EV_ON_HAND).alias("event_type"),
        F.lit("").alias("order_no"),
        "quantity",
        F.lit(False).alias("production_use_flag"),
        F.lit(False).alias("inbound_flag"),
        F.lit(0).alias("event_seq"),
    )
    use = sales_orders.select(
        F.col("component_id").alias("item_id"),
        F.col("requested_delivery_date").alias("event_date"),
        F.lit(EV_CONSUMPTION).alias("event_type"),
        F.col("sales_order_id").alias("order_no"),
        (-F.col("component_required_qty").cast("bigint")).alias("quantity"),
        F.lit(True).alias("production_use_flag"),
        F.lit(False).alias("inbound_flag"),
        F.lit(1).alias("event_seq"),
    )
    receipt = purchase_orders.filter(F.col("status").isin(*TIMELINE_PO_STATUS)).select(
        F.col("component_id").alias("item_id"),
        F.col("expected_delivery_date").alias("event_date"),
        F.lit(EV_RECEIPT).alias("event_type"),
        F.col("purchase_order_id").alias("order_no"),
        F.col("outstanding_qty").cast("bigint").alias("quantity"),
        F.lit(False).alias("production_use_flag"),
        F.lit(True).alias("inbound_flag"),
        F.lit(1).alias("event_seq"),
    )
    return on_hand.unionByName(use).unionByName(receipt)


def timeline(
    inventory_current: DataFrame,
    sales_orders: DataFrame,
    purchase_orders: DataFrame,
    p: Params,
    chunks: int | None = None,
) -> DataFrame:
    """Running balance per item in ledger order (seq, date, type, order no),
    as a distributed prefix sum that never orders a hot item -- or a hot
    (item, day) -- in one task:

    1. the events are range-partitioned on (item, ledger order) into
       ``chunks`` contiguous slices (default: the session's shuffle
       partitions), each row tagged with its slice, and checkpointed in the
       shared checkpoint folder so the tag is fixed for every later read and
       any recomputation;
    2. running sum per (slice, item) -- a slice is at most one task's worth of
       rows;
    3. per (item, slice) totals (at most items + slices rows); the balance
       before a slice is a window per item over its slices;
    4. balance = offset of the slice + running sum inside the slice.

    A count of non-NULL quantities keeps SQL's "SUM of only NULLs is NULL"."""
    return with_balance(events(inventory_current, sales_orders, purchase_orders, p), p, chunks)


def with_balance(ev: DataFrame, p: Params, chunks: int | None = None) -> DataFrame:
    """The running balance of ``events`` rows, as ``timeline`` describes it."""
    from stockpilot.session import ensure_checkpoint_dir

    spark = ev.sparkSession
    ensure_checkpoint_dir(spark)
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["event_seq", "event_date", "event_type", "order_no"]
    c0 = F.lit(0).cast("bigint")
    ev = (
        ev.repartitionByRange(n, F.col("item_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
        .withColumn("chunk", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    w_in = Window.partitionBy("chunk", "item_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("in_qty", F.coalesce(F.sum("quantity").over(w_in), c0)).withColumn(
        "in_n", F.count("quantity").over(w_in)
    )
    tot = ev.groupBy("item_id", "chunk").agg(F.sum("quantity").alias("t_qty"), F.count("quantity").alias("t_n"))
    w_off = Window.partitionBy("item_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(
        "item_id",
        "chunk",
        F.coalesce(F.sum("t_qty").over(w_off), c0).alias("off_qty"),
        F.coalesce(F.sum("t_n").over(w_off), c0).alias("off_n"),
    )
    e, o = ev.alias("e"), off.alias("o")
    j = e.join(o, (F.col("e.chunk") == F.col("o.chunk")) & F.col("e.item_id").eqNullSafe(F.col("o.item_id")), "left")
    seen = F.coalesce(F.col("o.off_n"), c0) + F.col("e.in_n")
    bal = F.when(seen > 0, F.coalesce(F.col("o.off_qty"), c0) + F.col("e.in_qty"))
    q = F.col("e.quantity")
    return j.select(
        d(p.as_of).alias("snapshot_date"),
        F.col("e.item_id").alias("item_id"),
        F.col("e.event_date").alias("event_date"),
        F.col("e.event_type").alias("event_type"),
        F.col("e.order_no").alias("order_no"),
        F.lit("").alias("sd_no"),
        q.alias("quantity"),
        F.col("e.production_use_flag").alias("production_use_flag"),
        F.col("e.inbound_flag").alias("inbound_flag"),
        bal.cast("bigint").alias("cumulative_balance"),
        F.when((q < 0) & (bal >= 0), F.abs(q)).otherwise(c0).alias("allocated_qty"),
    )


def month_grid(components: DataFrame, p: Params) -> DataFrame:
    """Dense component x month grid: one explode per component row (narrow,
    no join); the month list is bounded by the parameters (~a dozen)."""
    first = F.trunc(F.add_months(d(p.as_of), -p.projection_history_months), "MM")
    months = F.sequence(first, d(p.projection_end), F.expr("INTERVAL 1 MONTH"))
    return components.select(
        "component_id",
        "part_number",
        "component_name",
        F.coalesce(F.col("min_stock"), F.lit(p.default_min_stock)).alias("min_qty"),
        F.coalesce(F.col("max_stock"), F.lit(p.default_max_stock)).alias("max_qty"),
        F.explode(months).alias("month_start"),
    )


def projection(
    components: DataFrame,
    inventory_current: DataFrame,
    sales_orders: DataFrame,
    purchase_orders: DataFrame,
    forecasts: DataFrame,
    bom: DataFrame,
    p: Params,
) -> DataFrame:
    """Month by month stock per component over the grid's months.  Rows of other
    months can't reach the result, so the sources are read between the grid's
    first and last day only (literals: the bounds reach the scans)."""
    first = F.trunc(F.add_months(d(p.as_of), -p.projection_history_months), "MM")
    after = F.add_months(F.trunc(d(p.projection_end), "MM"), 1)
    zero = F.lit(None).cast("bigint")

    def in_grid(day):
        return (F.col(day) >= first) & (F.col(day) < after)

    def flow(df, month, init=zero, so=zero, po=zero, fc=zero):
        return df.select(
            F.col("component_id"),
            month.alias("month_start"),
            F.lit(False).alias("grid"),
            F.lit(None).cast("int").alias("min_qty"),
            F.lit(None).cast("int").alias("max_qty"),
            init.cast("bigint").alias("init"),
            so.cast("bigint").alias("so"),
            po.cast("bigint").alias("po"),
            fc.cast("bigint").alias("fc"),
        )

    # only fixed-width columns go through the group-by (hash aggregation,
    # no sort); the names are joined after the window, on the component key
    # the window already partitioned by
    grid = month_grid(components, p).select(
        "component_id", "month_start", F.lit(True).alias("grid"),
        "min_qty", "max_qty", zero.alias("init"), zero.alias("so"), zero.alias("po"), zero.alias("fc"),
    )
    init = flow(inventory_current, first, init=F.col("stock_qty"))
    so = flow(
        sales_orders.filter(in_grid("requested_delivery_date")),
        F.trunc("requested_delivery_date", "MM"),
        so=F.col("component_required_qty"),
    )
    po = flow(
        purchase_orders.filter(F.col("status").isin(*PROJECTION_PO_STATUS) & in_grid("expected_delivery_date")),
        F.trunc("expected_delivery_date", "MM"),
        po=F.col("outstanding_qty"),
    )
    # forecast is per product: pre-aggregate per (product, month), then
    # explode through the BOM
    fc_prod = forecasts.filter(in_grid("forecast_month")).groupBy("product_id", "forecast_month").agg(F.sum("forecast_qty").alias("fq"))
    fc = fc_prod.join(bom.select("product_id", "component_id", "quantity_per_unit"), "product_id")
    fc = flow(fc, F.col("forecast_month"), fc=F.col("fq") * F.col("quantity_per_unit"))

    rows = grid.unionByName(init).unionByName(so).unionByName(po).unionByName(fc)
    c0 = F.lit(0).cast("bigint")
    m = (
        rows.groupBy("component_id", "month_start")
        .agg(
            F.max("grid").alias("grid"),
            F.max("min_qty").alias("min_qty"),
            F.max("max_qty").alias("max_qty"),
            F.coalesce(F.sum("init"), c0).alias("init"),
            F.coalesce(F.sum("so"), c0).alias("so"),
            F.coalesce(F.sum("po"), c0).alias("po"),
            F.coalesce(F.sum("fc"), c0).alias("fc"),
        )
        .filter(F.col("grid"))
    )
    future = F.col("month_start") >= F.trunc(d(p.as_of), "MM")
    use = F.when(future, F.greatest("so", "fc")).otherwise(c0)
    net = F.col("init") + F.when(future, F.col("po") - F.greatest("so", "fc")).otherwise(c0)
    w = Window.partitionBy("component_id").orderBy("month_start").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("customer_stock_proj", F.sum(net).over(w))
    names = components.select("component_id", "part_number", "component_name")
    m = m.join(names, "component_id", "left")
    return m.select(
        month_key(F.col("month_start")).alias("month_end_date"),
        F.col("component_id").alias("item_id"),
        F.col("part_number").alias("item_code"),
        F.col("component_name").alias("product_name"),
        F.col("customer_stock_proj").cast("bigint").alias("customer_stock_proj"),
        F.col("so").alias("confirmed_order_qty"),
        F.col("fc").alias("forecast_qty"),
        F.col("po").alias("inbound_qty_order_linked"),
        use.alias("production_use_qty"),
        "min_qty",
        "max_qty",
        policy_status(F.col("customer_stock_proj"), F.col("min_qty"), F.col("max_qty")).alias("policy_status"),
    )


def breach(proj: DataFrame, p: Params) -> DataFrame:
    """Non-OK months up to the cutoff (no lower bound), with each item's
    first breach month.  The window is on item_id, the partitioning the
    projection already has, so it adds no shuffle."""
    b = proj.filter((F.col("policy_status") != "OK") & (F.col("month_end_date") <= F.lit(p.breach_cutoff)))
    w = Window.partitionBy("item_id")
    prio = F.when(F.col("policy_status") == "ZERO", 1).when(F.col("policy_status") == "UNDER", 2).when(
        F.col("policy_status") == "OVER", 3
    )
    return b.select(
        d(p.as_of).alias("snapshot_date"),
        "item_id",
        "item_code",
        "product_name",
        F.col("policy_status").alias("breach_type"),
        F.col("month_end_date").alias("breach_date"),
        F.col("customer_stock_proj").alias("projected_stock"),
        "min_qty",
        "max_qty",
        F.min("month_end_date").over(w).alias("first_breach"),
        prio.alias("priority_order"),
    )


# -- views over the ledger and projection ------------------------------------


def balance_status(proj: DataFrame) -> DataFrame:
    """Projected stock minus the minimum: SHORT / SURPLUS / EVEN per month."""
    gap = F.col("customer_stock_proj") - F.col("min_qty")
    return proj.select(
        "month_end_date",
        "item_id",
        "item_code",
        F.col("customer_stock_proj").alias("supply_available"),
        gap.alias("shortage_surplus"),
        F.when(gap < 0, F.lit("SHORT")).when(gap > 0, F.lit("SURPLUS")).otherwise(F.lit("EVEN")).alias(
            "balance_status"
        ),
    )


def inbound_outbound(tl: DataFrame) -> DataFrame:
    """Ledger rows labelled IN (on-hand, receipts) or OUT (consumption)."""
    return tl.select(
        "item_id",
        "event_date",
        "event_type",
        "order_no",
        "quantity",
        "cumulative_balance",
        F.when(F.col("event_type").isin(EV_ON_HAND, EV_RECEIPT), F.lit("IN")).otherwise(F.lit("OUT")).alias(
            "direction"
        ),
    )


def item_ledger(tl: DataFrame, item_id: str) -> DataFrame:
    """One item's events in date order (the per-item drill-down)."""
    return tl.filter(F.col("item_id") == item_id).orderBy(
        F.col("event_date").asc_nulls_first(), "event_type", "order_no"
    )


def inventory_health(proj: DataFrame, p: Params) -> DataFrame:
    """OK share of item x month rows from the as-of month on, items managed,
    and breach row counts per type (the breach report's rows: non-OK months
    up to the cutoff); one row, one pass over the projection."""
    s = F.col("policy_status")
    current = F.col("month_end_date") >= F.lit(p.as_of.strftime("%Y-%m"))
    in_breach = (s != "OK") & (F.col("month_end_date") <= F.lit(p.breach_cutoff))
    cols = ["evaluated_rows", "ok_rows", "managed_items", "zero_rows", "under_rows", "over_rows"]
    both = proj.agg(
        F.count_if(current).alias("evaluated_rows"),
        F.count_if(current & (s == "OK")).alias("ok_rows"),
        F.count_distinct(F.when(current, F.col("item_id"))).alias("managed_items"),
        F.count_if(in_breach & (s == "ZERO")).alias("zero_rows"),
        F.count_if(in_breach & (s == "UNDER")).alias("under_rows"),
        F.count_if(in_breach & (s == "OVER")).alias("over_rows"),
    )
    n, ok = F.col("evaluated_rows"), F.col("ok_rows")
    return both.select(
        *[F.col(c).cast("bigint").alias(c) for c in cols],
        F.when(n > 0, F.round(ok * 100.0 / n, 1)).otherwise(F.lit(0.0)).cast("double").alias("health_pct"),
    )


def item_status(proj: DataFrame, p: Params) -> DataFrame:
    """Per item over months from the as-of month on: worst status
    (ZERO < UNDER < OVER < OK), most frequent status (ties -> smallest
    label), and months per status."""
    cur = proj.filter(F.col("month_end_date") >= F.lit(p.as_of.strftime("%Y-%m")))
    s = F.col("policy_status")
    rank = F.when(s == "ZERO", 0).when(s == "UNDER", 1).when(s == "OVER", 2).otherwise(3)
    g = cur.groupBy("item_id").agg(
        F.min(rank).alias("_worst"),
        F.mode(s, deterministic=True).alias("mode_status"),
        F.count_if(s == "ZERO").cast("bigint").alias("zero_months"),
        F.count_if(s == "UNDER").cast("bigint").alias("under_months"),
        F.count_if(s == "OVER").cast("bigint").alias("over_months"),
        F.count_if(s == "OK").cast("bigint").alias("ok_months"),
    )
    worst = F.when(F.col("_worst") == 0, "ZERO").when(F.col("_worst") == 1, "UNDER").when(
        F.col("_worst") == 2, "OVER"
    ).otherwise("OK")
    return g.select("item_id", worst.alias("worst_status"), "mode_status", "zero_months", "under_months",
                    "over_months", "ok_months")
