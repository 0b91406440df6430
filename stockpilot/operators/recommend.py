"""Concrete action recommendations per demand, next-month pull-in, and the
batch what-if evaluation of hypothetical requests.

All per-demand logic is row-local: the options of a demand are an
``array(struct)`` sorted by score and exploded once, so ranking needs no
shuffle.  Prefix sums for the what-if consumption run over (component,
day) totals, never over raw rows of one component in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockpilot.functions.columns import CERTAIN, EXPECTED, NEGOTIABLE, d, label
from stockpilot.params import Params

L = "bigint"
FCST = "FCST_AUTO"

# Option codes in the order the rules are evaluated.
OPT_CUSTOMER, OPT_FREE, OPT_PO, OPT_COMBINED, OPT_NEW, OPT_PULL_IN = (
    "CUSTOMER_STOCK", "DISTRIBUTOR_FREE", "EXPEDITE_PO", "CUSTOMER_PLUS_FREE", "NEW_ORDER", "PULL_IN_NEXT_MONTH",
)

# Title of each option (neutral English).
OPT_TITLES = {
    OPT_CUSTOMER: "Allocate from customer stock",
    OPT_FREE: "Request allocation of distributor free stock",
    OPT_PO: "Expedite the open PO backlog",
    OPT_COMBINED: "Combine customer stock and free stock",
    OPT_NEW: "Place a new order with the maker",
    OPT_PULL_IN: "Pull in from next month's forecast",
}


def lt_weeks(col: Column, p: Params) -> Column:
    """Lead time used for new orders: the master value, default when NULL or 0."""
    return F.when(F.coalesce(col, F.lit(0)) == 0, F.lit(p.default_new_order_lt_weeks)).otherwise(col)


def month_totals(demand: DataFrame) -> DataFrame:
    """Forecast demand per component and calendar month."""
    return (
        demand.filter((F.col("source_type") == FCST) & F.col("requested_date").isNotNull())
        .groupBy("component_id", F.trunc("requested_date", "MM").alias("month_start"))
        .agg(F.sum("requested_qty").cast(L).alias("next_month_qty"))
    )


def _with_pull(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """``rows`` and pull_in_qty: half of the next month's total, floored."""
    month = F.add_months(F.trunc("requested_date", "MM"), 1)
    j = rows.withColumn("month_start", month).join(totals, ["component_id", "month_start"], "left")
    half = F.floor(F.coalesce(F.col("next_month_qty"), F.lit(0)) / 2).cast(L)
    return j.withColumn("pull_in_qty", half).drop("month_start", "next_month_qty")


def pull_in(demand: DataFrame) -> DataFrame:
    """Per demand: floor(half of next calendar month's forecast demand of
    the same component).  Monthly totals are pre-aggregated, then joined on
    (component, month)."""
    rows = demand.select("demand_id", "component_id", "requested_date")
    return _with_pull(rows, month_totals(demand)).select("demand_id", "pull_in_qty")


def _opt(code: str, eta: Column, feas: Column, cov: Column, gap: Column, score: Column, cond: Column, steps: list) -> Column:
    return F.when(
        cond,
        F.struct(
            score.cast("int").alias("priority_score"),
            F.lit(code).alias("option_code"),
            eta.alias("eta_date"),
            feas.alias("feasibility"),
            cov.cast(L).alias("coverage_qty"),
            gap.cast(L).alias("gap_qty"),
            F.concat_ws("\n", *steps).alias("steps"),
        ),
    )


def _step(text: str, *values: Column, when: Column | None = None) -> Column:
    """A line of text with each ``{}`` replaced by a value: whole numbers with
    thousands separators, dates in ISO form.  Null (left out) unless ``when``."""
    parts = text.split("{}")
    line = F.concat(F.lit(parts[0]), *(x for v, rest in zip(values, parts[1:]) for x in (v, F.lit(rest))))
    return line if when is None else F.when(when, line)


def _n(col: Column) -> Column:
    return F.format_number(col, 0)


def actions(routed: DataFrame, totals: DataFrame, p: Params) -> DataFrame:
    """Up to six ranked, concrete options per demand.  ``totals``: the
    forecast demand per component and month (``month_totals``)."""
    T = d(p.as_of)
    r = F.col("routes")
    req = F.col("requested_qty").cast(L)

    def avail(i):
        return F.coalesce(r[i]["available_qty"], F.lit(0).cast(L))

    def eta(i):
        return F.coalesce(r[i]["eta_date"], T)

    cust, free, po = avail(0), avail(1), avail(2)
    po_late = F.coalesce(r[2]["days_late"], F.lit(0))
    po_cov = F.least(po, req)
    lt = lt_weeks(F.col("base_lt"), p)
    new_eta = F.date_add(T, lt * 7)
    new_late = F.greatest(F.lit(0), F.datediff(new_eta, F.col("requested_date")))
    pull = F.coalesce(F.col("pull_in_qty"), F.lit(0).cast(L))
    pull_cov = F.least(pull, req)
    none = F.lit(0).cast(L)
    po_gap, pull_gap = F.greatest(none, req - po_cov), F.greatest(none, req - pull_cov)
    both_eta = F.greatest(eta(0), eta(1))
    cust_take = F.least(cust, req)
    day = lambda c: c.cast("string")
    opts = F.array(
        _opt(OPT_CUSTOMER, eta(0), F.lit(CERTAIN), req, none, F.lit(10), cust >= req, [
            _step("allocate {} from own warehouse", _n(req)),
            _step("ship out on {}", day(eta(0))),
        ]),
        _opt(OPT_FREE, eta(1), F.lit(CERTAIN), req, none, F.lit(20), free >= req, [
            _step("ask the distributor to allocate {}", _n(req)),
            _step("arrival on {}, transport included", day(eta(1))),
        ]),
        _opt(OPT_PO, eta(2), F.when(po_late == 0, F.lit(EXPECTED)).otherwise(F.lit(NEGOTIABLE)), po_cov, po_gap,
             F.lit(30), po > 0, [
            _step("confirm and expedite {} of the open PO backlog", _n(po_cov)),
            _step("earliest arrival {}", day(eta(2))),
            _step("cover the missing {} by another route", _n(po_gap), when=po_gap > 0),
        ]),
        _opt(OPT_COMBINED, both_eta, F.lit(CERTAIN), req, none, F.lit(25),
             (cust + free >= req) & (cust > 0) & (free > 0), [
            _step("allocate {} from own warehouse at once", _n(cust_take)),
            _step("ask the distributor for the remaining {} of free stock", _n(F.least(free, req - cust_take))),
            _step("complete on {}", day(both_eta)),
        ]),
        _opt(OPT_NEW, new_eta, F.lit(NEGOTIABLE), req, none, 50 + new_late, F.lit(True), [
            _step("order {} through the distributor", _n(req)),
            _step("lead time {} weeks, arrival {}", lt.cast("string"), day(new_eta)),
            _step("{} days after the requested date", new_late.cast("string"), when=new_late > 0),
        ]),
        _opt(OPT_PULL_IN, T, F.lit(NEGOTIABLE), pull_cov, pull_gap, F.lit(40), pull > 0, [
            _step("pull {} forward from next month's forecast", _n(pull_cov)),
            F.lit("check next month's stock margin and plan its supply"),
            F.coalesce(_step("cover the missing {} by another route", _n(pull_gap), when=pull_gap > 0),
                       F.lit("the whole quantity is pulled in")),
        ]),
    )
    # drop absent options, order by score (scores of present options never tie)
    ranked = F.array_sort(F.filter(opts, lambda x: x.isNotNull()))
    return _with_pull(routed, totals).select(
        "demand_id", "component_id", "requested_date", "requested_qty", F.posexplode(ranked).alias("pos", "o")
    ).select(
        "demand_id", "component_id", "requested_date", "requested_qty",
        (F.col("pos") + 1).alias("option_rank"),
        "o.option_code", label(F.col("o.option_code"), OPT_TITLES).alias("title"), "o.steps", "o.eta_date",
        "o.feasibility", "o.coverage_qty", "o.gap_qty", "o.priority_score",
    )


# -- batch what-if ----------------------------------------------------------------


def scenarios_from_emergencies(demand: DataFrame) -> DataFrame:
    """What-if requests taken from the emergency (manual) demands.  Each is
    itself in the plan: ``own_qty`` is what it must not consume from itself."""
    return demand.filter(F.col("source_type") == "EMERGENCY_MANUAL").select(
        F.col("demand_id").alias("scenario_id"),
        "component_id",
        F.col("requested_qty").alias("req_qty"),
        F.col("requested_date").alias("req_date"),
        F.col("requested_qty").alias("own_qty"),
    )


def whatif(
    scenarios: DataFrame,
    demand: DataFrame,
    inventory_current: DataFrame,
    free_inventory: DataFrame,
    purchase_orders: DataFrame,
    components: DataFrame,
    p: Params,
) -> DataFrame:
    """Four routes for each hypothetical (component, qty, date) request.

    Differs from the options mart on purpose: consumption counts demand of
    every source dated in [T, req_date], but not the request itself
    (``own_qty``; a scenario without that column is not in the plan);
    shortage is clipped at 0; a missing PO eta falls back to T + 7 * lead time.

    Plan: one union of demand day rows, one probe row per scenario key and
    the per-component route inputs, one group-by (map-side partial
    aggregates), one window per component over that aggregate (RANGE by
    date: demand on the request date counts; the inputs sort first and are
    carried by a running max), and one join back to the scenarios.  A
    component has at most one row per calendar day plus one per distinct
    request date, whatever its volume."""
    T = d(p.as_of)
    if "own_qty" not in scenarios.columns:
        scenarios = scenarios.withColumn("own_qty", F.lit(0))
    own = F.when(F.col("sc.req_date") >= T, F.coalesce(F.col("sc.own_qty"), F.lit(0))).otherwise(0)
    n_l, n_i, n_d = F.lit(None).cast(L), F.lit(None).cast("int"), F.lit(None).cast("date")
    cols = ("qty", "stock", "free_qty", "po_qty", "po_eta", "po_delayed", "base_lt")

    def rows(df, kind, date, **vals):
        base = {"qty": n_l, "stock": n_l, "free_qty": n_l, "po_qty": n_l, "po_eta": n_d, "po_delayed": n_i,
                "base_lt": n_i}
        base.update(vals)
        return df.filter(F.col("component_id").isNotNull()).select(
            "component_id", date.alias("k_date"), F.lit(kind).alias("kind"), *[base[c].alias(c) for c in cols]
        )

    po = purchase_orders.filter((F.col("outstanding_qty") > 0) & (F.col("expected_delivery_date") >= T))
    u = (
        rows(demand.filter(F.col("requested_date") >= T), 0, F.col("requested_date"),
             qty=F.col("requested_qty").cast(L))
        .unionByName(rows(scenarios, 1, F.col("req_date")))
        .unionByName(rows(inventory_current, 2, n_d, stock=F.col("stock_qty").cast(L)))
        .unionByName(rows(free_inventory, 2, n_d, free_qty=F.coalesce(F.col("qty_available"), F.lit(0)).cast(L)))
        .unionByName(rows(po, 2, n_d, po_qty=F.col("outstanding_qty").cast(L), po_eta=F.col("expected_delivery_date"),
                          po_delayed=F.col("is_delayed").cast("int")))
        .unionByName(rows(components, 2, n_d, base_lt=F.col("base_lead_time_weeks")))
    )
    g = u.groupBy("component_id", "k_date", "kind").agg(
        F.sum("qty").alias("qty"), F.sum("stock").alias("stock"), F.sum("free_qty").alias("free_qty"),
        F.sum("po_qty").alias("po_qty"), F.min("po_eta").alias("po_eta"), F.max("po_delayed").alias("po_delayed"),
        F.max("base_lt").alias("base_lt"),
    )
    w = (
        Window.partitionBy("component_id")
        .orderBy(F.col("k_date").asc_nulls_first())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    probes = g.select(
        "component_id",
        "k_date",
        "kind",
        F.coalesce(F.sum("qty").over(w), F.lit(0).cast(L)).alias("consumption"),
        *[F.max(c).over(w).alias(c) for c in ("stock", "free_qty", "po_qty", "po_delayed", "base_lt")],
        F.min("po_eta").over(w).alias("po_eta"),
    ).filter(F.col("kind") == 1)
    sc, pr = scenarios.alias("sc"), probes.alias("pr")
    cond = [F.col("sc.component_id").eqNullSafe(F.col("pr.component_id")),
            F.col("sc.req_date").eqNullSafe(F.col("pr.k_date"))]
    s = sc.join(pr, cond, "left").select(
        "sc.*",
        F.when(F.col("sc.req_date").isNotNull(), F.col("pr.consumption") - own).alias("consumption"),
        *[F.col(f"pr.{c}").alias(c) for c in ("stock", "free_qty", "po_qty", "po_eta", "base_lt")],
        (F.col("pr.po_delayed") == 1).alias("po_delayed"),
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast(L))
    lt = lt_weeks(F.col("base_lt"), p)
    s = s.select(
        "scenario_id", "component_id", "req_qty", "req_date",
        z("stock").alias("cust_total"), z("consumption").alias("consumption"),
        F.greatest(F.lit(0).cast(L), z("stock") - z("consumption")).alias("cust_effective"),
        z("free_qty").alias("free_qty"), z("po_qty").alias("po_qty"), "po_eta",
        F.coalesce(F.col("po_delayed"), F.lit(False)).alias("po_delayed"), lt.alias("lt_weeks"),
    )
    req = F.col("req_qty").cast(L)

    def route(code, avail, eta, conf):
        return F.struct(
            F.lit(code).alias("route_type"), avail.cast(L).alias("available_qty"), eta.alias("eta_date"),
            conf.alias("confidence"),
        )

    new_eta = F.date_add(T, F.col("lt_weeks") * 7)
    routes = F.array(
        route("CUSTOMER_STOCK", F.col("cust_effective"), T, F.lit(CERTAIN)),
        route("DISTRIBUTOR_FREE", F.col("free_qty"), F.date_add(T, p.free_transit_days), F.lit(CERTAIN)),
        route("EXISTING_PO", F.col("po_qty"), F.coalesce(F.col("po_eta"), new_eta),
              F.when(F.col("po_delayed"), F.lit(NEGOTIABLE)).otherwise(F.lit(EXPECTED))),
        route("NEW_ORDER", req, new_eta, F.lit(NEGOTIABLE)),
    )
    out = s.select("*", F.inline(routes))
    short = F.greatest(F.lit(0).cast(L), req - F.col("available_qty"))
    late = F.greatest(F.lit(0), F.datediff("eta_date", "req_date"))
    out = out.select("*", short.alias("shortage_qty"), (F.col("eta_date") <= F.col("req_date")).alias("is_in_time"),
                     late.alias("days_late"))
    verdict = (
        F.when((F.col("shortage_qty") <= 0) & F.col("is_in_time"), F.lit("FULL"))
        .when(F.col("shortage_qty") <= 0, F.lit("LATE"))
        .when(F.col("days_late") == 0, F.lit("SHORT"))
        .otherwise(F.lit("SHORT_AND_LATE"))
    )
    certain = F.col("cust_effective") + F.col("free_qty")
    total = (
        F.when(certain >= req, F.lit("IMMEDIATE"))
        .when(certain + F.col("po_qty") >= req, F.lit("WITH_PO"))
        .otherwise(F.lit("GAP"))
    )
    return out.select(
        "scenario_id", "component_id", "req_qty", "req_date", "route_type", "available_qty", "eta_date",
        "confidence", "shortage_qty", "is_in_time", "days_late", verdict.alias("route_verdict"),
        total.alias("overall_verdict"),
        F.greatest(F.lit(0).cast(L), req - certain - F.col("po_qty")).alias("gap_after_three_routes"),
        "cust_total", "consumption", "cust_effective", "free_qty", "po_qty", "lt_weeks",
    )


def where_used(bom: DataFrame, products: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Component -> products that use it (BOM with product names).  When
    ``components`` is given, only those components are kept (semi join)."""
    b = bom.select("component_id", "product_id", "quantity_per_unit")
    if components is not None:
        b = b.join(components.select("component_id").distinct(), "component_id", "left_semi")
    return b.join(products.select("product_id", "product_name", "product_category"), "product_id", "left")


def whatif_brief(wf: DataFrame) -> DataFrame:
    """One text brief per scenario (from its customer-stock route row)."""
    base = wf.filter(F.col("route_type") == "CUSTOMER_STOCK")
    text = F.format_string(
        "request %d pcs by %s; own stock %d (effective %d after %d planned use); free stock %d; open PO %d; "
        "lead time %d weeks; %s",
        F.col("req_qty"), F.col("req_date").cast("string"), F.col("cust_total"), F.col("cust_effective"),
        F.col("consumption"), F.col("free_qty"), F.col("po_qty"), F.col("lt_weeks"),
        F.when(F.col("gap_after_three_routes") <= 0, F.lit("covered by the three existing routes"))
        .otherwise(F.concat(F.lit("short by "), F.col("gap_after_three_routes").cast("string"),
                            F.lit(" pcs: new order needed"))),
    )
    return base.select("scenario_id", "component_id", "overall_verdict", text.alias("brief"))
