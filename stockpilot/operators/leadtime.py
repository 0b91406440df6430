"""Lead-time operators: as-of snapshot with N-1/N-3/N-6 comparison, history
trend, escalations, KPIs and surge insight.

The snapshot needs the latest row on or before four dates per component.
Instead of four ranked scans joined together, one grouped aggregation
computes all four with ``max_by(...) FILTER (WHERE effective_date <= x)``:
one scan, one shuffle of partial aggregates (a hot component is reduced
map-side).  Names are joined after the aggregation, on one row per
component rather than on every history row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.functions.columns import TREND_DOWN, TREND_FLAT, TREND_UP, band, d, trend
from stockpilot.params import Params

# Remark and escalation texts (neutral English).
REMARK_N1 = "lengthening, order early"
REMARK_N3 = "lengthening vs 3M"
REASON_N3 = "up vs 3 months ago"
REASON_N6 = "up vs 6 months ago"

_ORDER = "struct(effective_date, lead_time_weeks, lead_time_id)"


def lt_snapshot(lead_times: DataFrame, p: Params, components: DataFrame | None = None,
                suppliers: DataFrame | None = None) -> DataFrame:
    """``lead_times`` is either the enriched history, or -- when
    ``components`` and ``suppliers`` are given -- the bare history, in which
    case the names are joined after the aggregation (one row per component
    instead of one per history row)."""
    if components is not None:
        agg = _snapshot_agg(lead_times.select("component_id", "supplier_id", "effective_date", "lead_time_weeks",
                                              "lead_time_id"), p, ["lead_time_weeks", "supplier_id"])
        comp = components.select("component_id", "part_number", "component_name", "component_category")
        sup = suppliers.select(F.col("supplier_id").alias("_sid"), "supplier_name")
        agg = (
            agg.join(comp, "component_id", "left")
            .join(sup, F.col("c.supplier_id") == F.col("_sid"), "left")
            .select(
                "component_id", "n1", "n3", "n6",
                F.struct(
                    F.col("c.lead_time_weeks").alias("lead_time_weeks"), "part_number", "component_name",
                    "component_category", "supplier_name", F.col("c.supplier_id").alias("supplier_id"),
                    band(F.col("c.lead_time_weeks")).alias("lt_band"),
                ).alias("c"),
            )
        )
    else:
        agg = _snapshot_agg(lead_times, p, ["lead_time_weeks", "part_number", "component_name", "component_category",
                                            "supplier_name", "supplier_id", "lt_band"])
    return _snapshot_select(agg, p)


def _snapshot_agg(lead_times: DataFrame, p: Params, cur_cols: list[str]) -> DataFrame:
    T = f"DATE '{p.as_of.isoformat()}'"
    past = {
        k: F.expr(f"max_by(lead_time_weeks, {_ORDER}) FILTER (WHERE effective_date <= add_months({T}, -{k}))")
        for k in (1, 3, 6)
    }
    return (
        lead_times.filter(F.col("effective_date") <= d(p.as_of))
        .groupBy("component_id")
        .agg(
            F.expr(f"max_by(struct({', '.join(cur_cols)}), {_ORDER})").alias("c"),
            *[v.alias(f"n{k}") for k, v in past.items()],
        )
    )


def _snapshot_select(agg: DataFrame, p: Params) -> DataFrame:
    cur = F.col("c.lead_time_weeks")
    n1, n3, n6 = F.col("n1"), F.col("n3"), F.col("n6")
    remark = (
        F.when(n1.isNotNull() & (cur > n1), F.lit(REMARK_N1))
        .when(n3.isNotNull() & (cur > n3), F.lit(REMARK_N3))
        .otherwise(F.lit(""))
    )
    return agg.select(
        d(p.as_of).alias("snapshot_date"),
        F.col("component_id").alias("item_id"),
        F.col("c.part_number").alias("item_code"),
        F.col("c.component_name").alias("item_name"),
        F.col("c.supplier_name").alias("manufacturer_name"),
        F.col("c.supplier_name").alias("supplier_name"),
        cur.cast("int").alias("latest_lt_weeks"),
        n1.cast("int").alias("lt_n1_weeks"),
        n3.cast("int").alias("lt_n3_weeks"),
        n6.cast("int").alias("lt_n6_weeks"),
        (cur - n1).cast("int").alias("delta_vs_n1"),
        (cur - n3).cast("int").alias("delta_vs_n3"),
        (cur - n6).cast("int").alias("delta_vs_n6"),
        trend(cur, n1).alias("trend_arrow_n1"),
        trend(cur, n3).alias("trend_arrow_n3"),
        trend(cur, n6).alias("trend_arrow_n6"),
        F.col("c.lt_band").alias("lt_band"),
        remark.alias("remark"),
        F.col("c.component_category").alias("component_category"),
        F.col("c.supplier_id").alias("supplier_id"),
    )


def lt_trend(lead_times: DataFrame) -> DataFrame:
    """Every cleansed history row with its 'yyyy-MM' month (no aggregation)."""
    return lead_times.select(
        F.date_format("effective_date", "yyyy-MM").alias("month"),
        "component_id",
        "part_number",
        "component_name",
        "component_category",
        "supplier_name",
        "lead_time_weeks",
        "lt_band",
        "effective_date",
    )


def lt_escalation(snapshot: DataFrame) -> DataFrame:
    up3 = F.col("trend_arrow_n3") == TREND_UP
    up6 = F.col("trend_arrow_n6") == TREND_UP
    return (
        snapshot.filter(up3 | up6)
        .withColumn("escalation_flag", F.lit(True))
        .withColumn(
            "escalation_reason",
            F.when(up3, F.lit(REASON_N3)).when(up6, F.lit(REASON_N6)).otherwise(F.lit("")),
        )
    )


def lt_kpi(snapshot: DataFrame) -> DataFrame:
    """Monitored items, items up vs 3M and vs 6M, mean current lead time."""
    return snapshot.agg(
        F.count(F.lit(1)).cast("bigint").alias("monitored_items"),
        F.count_if(F.col("trend_arrow_n3") == TREND_UP).cast("bigint").alias("up_vs_n3"),
        F.count_if(F.col("trend_arrow_n6") == TREND_UP).cast("bigint").alias("up_vs_n6"),
        F.round(F.coalesce(F.avg("latest_lt_weeks"), F.lit(0.0)), 4).alias("avg_lt_weeks"),
    )


def lt_surge(escalation: DataFrame, p: Params, k: int = 5) -> DataFrame:
    """Top-k surging items: worst delta, weeks to order earlier, eta at the
    new and at the old lead time."""
    d3 = F.coalesce(F.col("delta_vs_n3"), F.lit(0))
    d6 = F.coalesce(F.col("delta_vs_n6"), F.lit(0))
    latest = F.coalesce(F.col("latest_lt_weeks"), F.lit(0))
    worst = F.greatest(d3, d6)
    old_lt = F.coalesce(F.col("lt_n3_weeks"), latest - d3)
    return (
        escalation.select(
            "item_id",
            "item_code",
            "item_name",
            latest.alias("latest_lt_weeks"),
            worst.alias("worst_delta_weeks"),
            F.greatest(worst + 2, F.lit(2)).alias("order_earlier_weeks"),
            F.date_add(d(p.as_of), latest * 7).alias("eta_at_current_lt"),
            F.date_add(d(p.as_of), F.greatest(old_lt, F.lit(1)) * 7).alias("eta_at_previous_lt"),
            "escalation_reason",
        )
        .orderBy(F.col("worst_delta_weeks").desc(), F.col("item_id").asc())
        .limit(k)
    )


def trend_class(n3: str = "trend_arrow_n3", n6: str = "trend_arrow_n6") -> F.Column:
    """UP if either horizon is up; DOWN if either is down; FLAT if both flat."""
    a, b = F.col(n3), F.col(n6)
    return (
        F.when((a == TREND_UP) | (b == TREND_UP), F.lit(TREND_UP))
        .when((a == TREND_DOWN) | (b == TREND_DOWN), F.lit(TREND_DOWN))
        .when((a == TREND_FLAT) & (b == TREND_FLAT), F.lit(TREND_FLAT))
        .otherwise(F.lit(""))
    )


def filter_band_trend(snapshot: DataFrame, lt_band: str | None = None, trend_sel: str | None = None) -> DataFrame:
    """Snapshot rows in a band and/or a trend selection (UP / DOWN / FLAT as
    defined by the page filter: UP or DOWN on either horizon, FLAT on both)."""
    out = snapshot
    if lt_band is not None:
        out = out.filter(F.col("lt_band") == lt_band)
    a, b = F.col("trend_arrow_n3"), F.col("trend_arrow_n6")
    if trend_sel == TREND_UP:
        out = out.filter((a == TREND_UP) | (b == TREND_UP))
    elif trend_sel == TREND_DOWN:
        out = out.filter((a == TREND_DOWN) | (b == TREND_DOWN))
    elif trend_sel == TREND_FLAT:
        out = out.filter((a == TREND_FLAT) & (b == TREND_FLAT))
    return out


def band_trend_counts(snapshot: DataFrame) -> DataFrame:
    """Items per (band, trend selection); an item can be both UP and DOWN
    (different horizons), as with the page filter."""
    a, b = F.col("trend_arrow_n3"), F.col("trend_arrow_n6")
    return snapshot.groupBy("lt_band").agg(
        F.count(F.lit(1)).cast("bigint").alias("items"),
        F.count_if((a == TREND_UP) | (b == TREND_UP)).cast("bigint").alias("up_items"),
        F.count_if((a == TREND_DOWN) | (b == TREND_DOWN)).cast("bigint").alias("down_items"),
        F.count_if((a == TREND_FLAT) & (b == TREND_FLAT)).cast("bigint").alias("flat_items"),
    )
