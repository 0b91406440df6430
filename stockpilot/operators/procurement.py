"""Procurement options: four supply routes per demand, action level, and the
product-level build readiness built on them.

Plan shape (Spark-first rewrite of a theta self-join and a 4-way union):

1. One union of small per-key rows -- demand day totals keyed
   (component, date) and per-component route inputs (customer stock, free
   stock, open POs, lead time) keyed (component) -- and one group-by.  Every
   source is pre-aggregated map-side, so a hot component costs one row per
   task before the shuffle.
2. A window per component over that aggregate gives (a) the running sum of
   forecast demand by date (RANGE semantics: ties share one day row) and
   (b) the route inputs, carried to every day row of the component by a
   running max/min (the component row sorts first).  A
   component has at most one row per calendar day here, whatever its demand
   volume.
3. Each demand joins its (component, date) row once: one shuffle of the
   demand rows (AQE splits a skewed key, or broadcasts the aggregate side
   when its runtime size is small).  Consumption of earlier forecast
   demand = prefix sum - own quantity (for a repeated demand_id: what all of
   its rows hold up to the date; only such rows are grouped again).
4. All route values and per-demand flags are row-local; the four routes are
   an ``array(struct)`` that ``inline`` turns into rows only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockpilot.functions.columns import (
    BLOCKED,
    CERTAIN,
    EXPECTED,
    LEVEL_HEAVY,
    LEVEL_LIGHT,
    LEVEL_MEDIUM,
    LEVEL_NONE,
    NEGOTIABLE,
    PARTIAL,
    PRODUCIBLE,
    d,
)
from stockpilot.params import Params

FCST, EMERGENCY = "FCST_AUTO", "EMERGENCY_MANUAL"
L = "bigint"

# Route notes (neutral English).
NOTE_FREE = "distributor stock already allocated to the customer"
NOTE_PO_DELAYED = "open PO is delayed; confirm the date with the maker"
NOTE_PO = "expedite the open PO backlog"
NOTE_NEW = "new order (lead time applies; confirm with the maker)"

ROUTE_FIELDS = ("route_type", "available_qty", "eta_date", "confidence", "note", "shortage_qty", "is_in_time", "days_late")


def _component_rows(
    inventory_current: DataFrame, free_inventory: DataFrame, purchase_orders: DataFrame, components: DataFrame,
    p: Params,
) -> DataFrame:
    """Per-component route inputs as union-ready rows (not yet aggregated:
    the one group-by of ``demand_wide`` sums them, map-side first)."""
    nul = {
        "stock": F.lit(None).cast(L),
        "free_avail": F.lit(None).cast(L),
        "po_avail": F.lit(None).cast(L),
        "po_eta": F.lit(None).cast("date"),
        "po_delayed": F.lit(None).cast("int"),
        "base_lt": F.lit(None).cast("int"),
    }

    def rows(df: DataFrame, **vals: Column) -> DataFrame:
        cols = {**nul, **{k: v for k, v in vals.items()}}
        return df.filter(F.col("component_id").isNotNull()).select(
            "component_id", *[c.alias(k) for k, c in cols.items()]
        )

    po = purchase_orders.filter((F.col("outstanding_qty") > 0) & (F.col("expected_delivery_date") >= d(p.as_of)))
    return (
        rows(inventory_current, stock=F.col("stock_qty").cast(L))
        .unionByName(rows(free_inventory, free_avail=F.coalesce(F.col("qty_available"), F.lit(0)).cast(L)))
        .unionByName(
            rows(
                po,
                po_avail=F.col("outstanding_qty").cast(L),
                po_eta=F.col("expected_delivery_date"),
                po_delayed=F.col("is_delayed").cast("int"),
            )
        )
        .unionByName(rows(components, base_lt=F.col("base_lead_time_weeks")))
    )


def _fq(prefix: str = "") -> Column:
    """Quantity a demand contributes to the consumption seen by others."""
    is_fcst = (
        (F.col(f"{prefix}source_type") == FCST)
        & F.col(f"{prefix}component_id").isNotNull()
        & F.col(f"{prefix}requested_date").isNotNull()
    )
    return F.when(is_fcst, F.coalesce(F.col(f"{prefix}requested_qty"), F.lit(0))).otherwise(F.lit(0)).cast(L)


def repeated_quantities(demand: DataFrame) -> DataFrame:
    """demand_id, component_id, requested_date, own_fq for the demand_ids on
    several rows: the id's forecast quantity of the component up to the date.

    The ids are counted by a partial aggregate; only repeated ones go on, one
    row per (id, component, day), so a hot id is no long window."""
    many = demand.groupBy("demand_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("demand_id")
    days = demand.join(many, "demand_id", "left_semi").groupBy("demand_id", "component_id", "requested_date").agg(
        F.sum(_fq()).alias("fq")
    )
    upto = Window.partitionBy("demand_id", "component_id").orderBy(F.col("requested_date").asc_nulls_first())
    return days.select("demand_id", "component_id", "requested_date", F.sum("fq").over(upto).alias("own_fq"))


def demand_wide(
    demand: DataFrame,
    inventory_current: DataFrame,
    free_inventory: DataFrame,
    purchase_orders: DataFrame,
    components: DataFrame,
    p: Params,
) -> DataFrame:
    """One row per demand row with consumption and every route input."""
    day_rows = demand.select(
        "component_id",
        "requested_date",
        F.lit(True).alias("is_day"),
        _fq().alias("fq"),
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("stock", L), ("free_avail", L), ("po_avail", L), ("po_eta", "date"), ("po_delayed", "int"), ("base_lt", "int")
        )],
    )
    comp_rows = _component_rows(inventory_current, free_inventory, purchase_orders, components, p).select(
        "component_id",
        F.lit(None).cast("date").alias("requested_date"),
        F.lit(False).alias("is_day"),
        F.lit(None).cast(L).alias("fq"),
        "stock", "free_avail", "po_avail", "po_eta", "po_delayed", "base_lt",
    )
    g = day_rows.unionByName(comp_rows).groupBy("component_id", "requested_date", "is_day").agg(
        F.sum("fq").alias("fq"),
        F.sum("stock").alias("stock"),
        F.sum("free_avail").alias("free_avail"),
        F.sum("po_avail").alias("po_avail"),
        F.min("po_eta").alias("po_eta"),
        F.max("po_delayed").alias("po_delayed"),
        F.max("base_lt").alias("base_lt"),
    )
    # One window spec: the component row (is_day = false) sorts first, so a
    # running max/min carries its route inputs to every day row, and the
    # running sum of fq over the day rows is the prefix by date.  NULL
    # component ids are one partition with no route inputs (filtered above)
    # and no forecast quantity (fq = 0).
    prefix = (
        Window.partitionBy("component_id")
        .orderBy(F.col("is_day").asc(), F.col("requested_date").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    days = g.select(
        "component_id",
        "requested_date",
        "is_day",
        F.sum(F.coalesce("fq", F.lit(0).cast(L))).over(prefix).alias("prefix_fq"),
        *[F.max(c).over(prefix).alias(c) for c in ("stock", "free_avail", "po_avail", "po_delayed", "base_lt")],
        F.min("po_eta").over(prefix).alias("po_eta"),
    ).filter(F.col("is_day"))

    dm, dy = demand.alias("dm"), days.alias("dy")
    cond = [F.col("dm.component_id").eqNullSafe(F.col("dy.component_id")),
            F.col("dm.requested_date").eqNullSafe(F.col("dy.requested_date"))]
    rp = repeated_quantities(demand).alias("rp")
    same = [F.col(f"dm.{c}").eqNullSafe(F.col(f"rp.{c}")) for c in ("demand_id", "component_id", "requested_date")]
    j = dm.join(dy, cond, "left").join(rp, same, "left")
    has_key = F.col("dm.component_id").isNotNull() & F.col("dm.requested_date").isNotNull()
    own = F.coalesce(F.col("rp.own_fq"), _fq("dm."))
    consumption = F.when(has_key, F.col("dy.prefix_fq") - own).otherwise(F.lit(0).cast(L))
    return j.select(
        F.col("dm.demand_id").alias("demand_id"),
        F.col("dm.component_id").alias("component_id"),
        F.col("dm.requested_date").alias("requested_date"),
        F.col("dm.requested_qty").alias("requested_qty"),
        F.col("dm.source_type").alias("source_type"),
        F.col("dm.product_id").alias("product_id"),
        F.col("dm.customer_id").alias("customer_id"),
        F.coalesce(consumption, F.lit(0).cast(L)).alias("consumption"),
        F.coalesce(F.col("dy.stock"), F.lit(0).cast(L)).alias("current_stock"),
        F.coalesce(F.col("dy.free_avail"), F.lit(0).cast(L)).alias("free_avail"),
        F.coalesce(F.col("dy.po_avail"), F.lit(0).cast(L)).alias("po_avail"),
        F.col("dy.po_eta").alias("po_eta"),
        F.col("dy.po_delayed").alias("po_delayed"),
        F.col("dy.base_lt").alias("base_lt"),
    )


def _route(route_type: str, avail: Column, eta: Column, confidence: Column, note: Column) -> Column:
    req_qty, req_date = F.col("requested_qty").cast(L), F.col("requested_date")
    avail = avail.cast(L)
    return F.struct(
        F.lit(route_type).alias("route_type"),
        avail.alias("available_qty"),
        eta.alias("eta_date"),
        confidence.alias("confidence"),
        note.alias("note"),
        (req_qty - avail).alias("shortage_qty"),
        (eta <= req_date).alias("is_in_time"),
        F.when(eta > req_date, F.datediff(eta, req_date)).otherwise(F.lit(0)).alias("days_late"),
    )


def with_routes(wide: DataFrame, p: Params) -> DataFrame:
    """Adds the four route structs, the per-demand flags and the level."""
    T = d(p.as_of)
    cust_avail = F.greatest(F.lit(0).cast(L), F.col("current_stock") - F.col("consumption"))
    cust_note = F.concat(
        F.lit("customer stock (current "),
        F.col("current_stock").cast("string"),
        F.lit(" - planned consumption "),
        F.col("consumption").cast("string"),
        F.lit(" = effective)"),
    )
    delayed = F.col("po_delayed") == 1
    routes = F.array(
        _route("CUSTOMER_STOCK", cust_avail, T, F.lit(CERTAIN), cust_note),
        _route("DISTRIBUTOR_FREE", F.col("free_avail"), F.date_add(T, p.free_transit_days), F.lit(CERTAIN),
               F.lit(NOTE_FREE)),
        _route("EXISTING_PO", F.col("po_avail"), F.col("po_eta"),
               F.when(delayed, F.lit(NEGOTIABLE)).otherwise(F.lit(EXPECTED)),
               F.when(delayed, F.lit(NOTE_PO_DELAYED)).otherwise(F.lit(NOTE_PO))),
        _route("NEW_ORDER", F.col("requested_qty"),
               F.date_add(T, F.coalesce(F.col("base_lt"), F.lit(p.default_new_order_lt_weeks)) * 7),
               F.lit(NEGOTIABLE), F.lit(NOTE_NEW)),
    )
    w = wide.withColumn("routes", routes)
    r = F.col("routes")
    single = F.exists(r, lambda x: F.coalesce((x["shortage_qty"] <= 0) & x["is_in_time"], F.lit(False)))
    alone = F.coalesce(r[0]["shortage_qty"] <= 0, F.lit(False))
    combo_total = r[0]["available_qty"] + r[1]["available_qty"] + r[2]["available_qty"]
    w = w.withColumn("any_single_route_ok", single.cast("int")).withColumn(
        "customer_stock_alone_ok", alone.cast("int")
    ).withColumn("combo_total_avail", combo_total).withColumn(
        "combo_ok", F.coalesce(F.col("combo_total_avail") >= F.col("requested_qty"), F.lit(False)).cast("int")
    )
    level = (
        F.when(F.col("customer_stock_alone_ok") == 1, F.lit(LEVEL_NONE))
        .when(F.col("any_single_route_ok") == 1, F.lit(LEVEL_LIGHT))
        .when(F.col("combo_ok") == 1, F.lit(LEVEL_MEDIUM))
        .otherwise(F.lit(LEVEL_HEAVY))
    )
    return w.withColumn("action_level", level).withColumn("needs_action", F.col("action_level") != LEVEL_NONE)


def options(routed: DataFrame) -> DataFrame:
    """Four rows per demand."""
    return routed.select(
        "demand_id", "component_id", "requested_date", "requested_qty", F.inline("routes"),
        "any_single_route_ok", "customer_stock_alone_ok", "combo_ok", "combo_total_avail", "action_level",
        "needs_action",
    ).select(
        "demand_id", "component_id", "requested_date", "requested_qty", *ROUTE_FIELDS,
        "any_single_route_ok", "customer_stock_alone_ok", "combo_ok", "combo_total_avail", "action_level",
        "needs_action",
    )


def fulfillment(routed: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """Product x month build readiness from the per-demand rows (no 4x
    blow-up, no distinct)."""
    dm = routed.filter(
        (F.col("source_type") == FCST) & F.col("product_id").isNotNull() & (F.col("requested_date") >= d(p.as_of))
    )
    lv = F.col("action_level")
    g = dm.groupBy("product_id", F.date_format("requested_date", "yyyy-MM").alias("requested_month")).agg(
        F.count("component_id").alias("total_components"),
        F.count_if(lv == LEVEL_NONE).alias("self_sufficient_components"),
        F.count_if(lv == LEVEL_LIGHT).alias("light_action_components"),
        F.count_if(lv == LEVEL_MEDIUM).alias("medium_action_components"),
        F.count_if(lv == LEVEL_HEAVY).alias("heavy_action_components"),
        F.count_if(F.col("combo_ok") == 1).alias("fulfillable_components"),
        F.min("requested_date").alias("earliest_requested_date"),
    )
    tot, ful = F.col("total_components"), F.col("fulfillable_components")
    rate = F.round(F.try_divide(ful.cast("double"), tot.cast("double")), 3)
    g = g.select(
        "*",
        (ful == tot).alias("is_all_fulfilled"),
        (tot - ful).alias("shortage_components"),
        rate.alias("fulfillment_rate"),
    ).withColumn(
        "production_status",
        F.when(F.col("is_all_fulfilled"), F.lit(PRODUCIBLE))
        .when(F.col("fulfillment_rate") >= 0.8, F.lit(PARTIAL))
        .otherwise(F.lit(BLOCKED)),
    )
    prod = products.select("product_id", "product_name", "product_category")
    return g.join(prod, "product_id", "left")


# -- per-demand views over the routes -------------------------------------------

LEVEL_ORDER = {LEVEL_HEAVY: 0, LEVEL_MEDIUM: 1, LEVEL_LIGHT: 2, LEVEL_NONE: 3}


def best_route_col() -> Column:
    """struct(score, route_rank, r) of the best route of the row's demand:
    lowest max(shortage, 0) * 1000 + days_late, ties to the earlier route in
    the fixed route order (``array_min`` over the row's own route array)."""
    scored = F.transform(
        F.col("routes"),
        lambda x, i: F.struct(
            (F.greatest(F.coalesce(x["shortage_qty"], F.lit(0).cast(L)), F.lit(0).cast(L)) * 1000
             + F.coalesce(x["days_late"], F.lit(0))).alias("score"),
            i.alias("route_rank"),
            x.alias("r"),
        ),
    )
    return F.array_min(scored)


def best_route(routed: DataFrame) -> DataFrame:
    """Best route per demand.  Row-local: the four routes are in one row, so
    no regrouping."""
    best = best_route_col()
    return routed.select(
        "demand_id", "component_id", "requested_date", "requested_qty", "source_type",
        best["score"].cast(L).alias("route_score"),
        *[best["r"][f].alias(f) for f in ROUTE_FIELDS],
        "any_single_route_ok", "customer_stock_alone_ok", "combo_ok", "combo_total_avail", "action_level",
        "needs_action",
    )


def needs_action(best: DataFrame) -> DataFrame:
    return best.filter(F.col("needs_action"))


def level_counts(best: DataFrame) -> DataFrame:
    """Demands per action level; every level present (zero-filled)."""
    lv = F.col("action_level")
    one = best.agg(*[F.count_if(lv == k).alias(k) for k in LEVEL_ORDER])
    stack = ", ".join(f"'{k}', `{k}`" for k in LEVEL_ORDER)
    return one.selectExpr(f"stack({len(LEVEL_ORDER)}, {stack}) AS (action_level, demands)").select(
        "action_level", F.col("demands").cast(L).alias("demands")
    )


def filter_levels(best: DataFrame, levels: list[str]) -> DataFrame:
    return best.filter(F.col("action_level").isin(*levels))


def needs_top(best: DataFrame, components: DataFrame, p: Params, horizon_days: int = 90, k: int = 10) -> DataFrame:
    """Dashboard table: demands due within the horizon that need action,
    worst level first, then larger shortage, then later; top k."""
    T = d(p.as_of)
    cand = best.filter(
        F.col("requested_date").between(T, F.date_add(T, horizon_days)) & F.col("needs_action")
    )
    lv = F.col("action_level")
    lv_rank = F.when(lv == LEVEL_HEAVY, 0).when(lv == LEVEL_MEDIUM, 1).when(lv == LEVEL_LIGHT, 2).when(
        lv == LEVEL_NONE, 3
    ).otherwise(9)
    comp = components.select("component_id", "part_number", "component_name")
    top = cand.withColumn("level_rank", lv_rank).orderBy(
        "level_rank", F.col("shortage_qty").desc(), F.col("days_late").desc(), "demand_id"
    ).limit(k)
    return top.join(comp, "component_id", "left").select(
        "demand_id", "part_number", "component_name", "requested_date", "requested_qty", "action_level",
        "route_type", "shortage_qty", "days_late", "level_rank",
    )


def three_route(routed: DataFrame, p: Params) -> DataFrame:
    """Action-center view: sum over the three stock routes, remaining
    shortage, days left."""
    r = F.col("routes")
    total = r[0]["available_qty"] + r[1]["available_qty"] + r[2]["available_qty"]
    return routed.select(
        "demand_id", "component_id", "requested_date", "requested_qty", "source_type",
        r[0]["available_qty"].alias("customer_avail"),
        r[1]["available_qty"].alias("free_avail"),
        r[2]["available_qty"].alias("po_avail"),
        total.alias("three_route_total"),
        F.greatest(F.lit(0).cast(L), F.col("requested_qty").cast(L) - total).alias("three_route_short"),
        F.datediff("requested_date", d(p.as_of)).alias("days_left"),
        "action_level",
    )


def fulfillment_kpi(ful: DataFrame) -> DataFrame:
    """Product-months: total, all fulfilled, partial (rate >= 0.8, not all),
    critical (rate < 0.8)."""
    rate = F.coalesce(F.col("fulfillment_rate"), F.lit(0.0))
    return ful.agg(
        F.count(F.lit(1)).cast(L).alias("total"),
        F.count_if(F.col("is_all_fulfilled")).cast(L).alias("ok"),
        F.count_if((rate >= 0.8) & ~F.col("is_all_fulfilled")).cast(L).alias("partial"),
        F.count_if(rate < 0.8).cast(L).alias("critical"),
    )


def bom_chain(ful: DataFrame) -> DataFrame:
    """HEAVY components summed over product-months with rate < 0.8."""
    rate = F.coalesce(F.col("fulfillment_rate"), F.lit(0.0))
    return ful.filter(rate < 0.8).agg(
        F.count(F.lit(1)).cast(L).alias("blocked_product_months"),
        F.coalesce(F.sum("heavy_action_components"), F.lit(0)).cast(L).alias("short_components"),
    )


def bom_drill(routed: DataFrame, components: DataFrame, p: Params) -> DataFrame:
    """Product x month -> its component demands: names, what the first route
    (customer stock) makes available and leaves short, level and best route."""
    dm = routed.filter(
        (F.col("source_type") == FCST) & F.col("product_id").isNotNull() & (F.col("requested_date") >= d(p.as_of))
    )
    first = F.col("routes")[0]
    rows = dm.select(
        "product_id",
        F.date_format("requested_date", "yyyy-MM").alias("requested_month"),
        "demand_id", "component_id", "requested_date", "requested_qty",
        first["available_qty"].alias("available_qty"), first["shortage_qty"].alias("shortage_qty"),
        "action_level", "combo_ok", best_route_col()["r"]["route_type"].alias("best_route"),
    )
    return rows.join(components.select("component_id", "part_number", "component_name"), "component_id", "left")


def bom_bottleneck(routed: DataFrame, components: DataFrame, p: Params, k: int = 5) -> DataFrame:
    """HEAVY components of each product x month: count and the first k
    names in name order.  The names come from an exact salted top-k (a hot
    product-month is ranked across many tasks), so the collected list is
    bounded by k."""
    from stockpilot.functions.topk import topk_per_group

    dm = routed.filter(
        (F.col("source_type") == FCST) & F.col("product_id").isNotNull()
        & (F.col("requested_date") >= d(p.as_of)) & (F.col("action_level") == LEVEL_HEAVY)
    )
    comp = components.select("component_id", "component_name")
    j = dm.join(comp, "component_id", "left").select(
        "product_id",
        F.date_format("requested_date", "yyyy-MM").alias("requested_month"),
        "demand_id",
        F.coalesce(F.col("component_name"), F.col("component_id")).alias("name"),
    )
    keys = ["product_id", "requested_month"]
    counts = j.groupBy(*keys).agg(F.count(F.lit(1)).cast(L).alias("heavy_components"))
    top = topk_per_group(j, keys, [F.col("name"), F.col("demand_id")], k, ["demand_id"])
    names = top.groupBy(*keys).agg(
        F.concat_ws(", ", F.sort_array(F.collect_list(F.struct("rank", "name"))).getField("name")).alias("first_names")
    )
    return counts.join(names, keys, "left")
