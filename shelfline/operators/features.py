"""Daily features. Every feature of day t uses information up to the end of day t-1.

All per-segment features share one window (partition by segment, order by day): one exchange and one sort,
whatever the number of features.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import exact_quantiles, moved, ratio, rel_change
from ..functions import calendar as K
from .. import fixed_values as V
from ..session import settle
from . import cleaning as L
from .grid import build_segments, causal_grid

SEGMENT = ("store", "segment_id")


def _over(keys: Sequence[str]):
    w = Window.partitionBy(*keys).orderBy("date")
    return w, lambda a, b: w.rowsBetween(a, b)


def with_lags(grid: DataFrame, keys: Sequence[str] = SEGMENT, days: Sequence[int] = (1, 7, 15, 30)) -> DataFrame:
    w, _ = _over(keys)
    return grid.withColumns({"base_price": F.lag("R", 1).over(w)} | {f"price_lag_{k}": F.lag("R", k).over(w) for k in days})


def _at_least(n: int, value: Column, frame) -> Column:
    return F.when(F.count("R").over(frame) >= n, value)


def with_rolling(grid: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    w, rows = _over(keys)
    week, month = rows(-7, -1), rows(-30, -1)
    r1 = F.lag("R", 1).over(w)
    return (grid.withColumn("price_7d_mean", _at_least(4, F.avg("R").over(week), week))
            .withColumn("price_7d_std", _at_least(4, F.stddev_samp("R").over(week), week))
            .withColumn("price_30d_mean", _at_least(15, F.avg("R").over(month), month))
            .withColumn("price_momentum_7d", rel_change(r1, F.lag("R", 8).over(w)))
            .withColumn("ratio_lag1_mean30", rel_change(r1, "price_30d_mean")))


def with_changes(grid: DataFrame, keys: Sequence[str] = SEGMENT, tol: float = V.SAME_PRICE_TOL) -> DataFrame:
    """Change flag of day t and what is known of past changes at t-1."""
    w, rows = _over(keys)
    past = rows(Window.unboundedPreceding, -1)
    flagged = (grid.withColumn("_prev", F.lag("R").over(w))
               .withColumn("reg_change", moved("R", "_prev", tol).cast("double"))
               .withColumn("_hit", F.coalesce("reg_change", F.lit(0.0)))
               .withColumn("_size", F.when(F.col("_hit") == 1, rel_change("R", "_prev")))
               .withColumn("_n", F.row_number().over(w)))
    since = F.col("_n") - 1 - F.coalesce(F.last(F.when(F.col("_hit") == 1, F.col("_n")), ignorenulls=True).over(past), F.lit(1))
    return (flagged.withColumn("n_changes_30d", F.sum("_hit").over(rows(-30, -1)))
            .withColumn("n_changes_60d", F.sum("_hit").over(rows(-60, -1)))
            .withColumn("last_change_size", F.last("_size", ignorenulls=True).over(past))
            .withColumn("days_since_change", F.when(F.col("_n") > 1, since).cast("double"))
            .drop("_prev", "_hit", "_size", "_n"))


def with_sale_state(grid: DataFrame, keys: Sequence[str] = SEGMENT, carry: int = V.CARRY_DAYS) -> DataFrame:
    w, rows = _over(keys)
    return (grid.withColumn("shelf_price_lag1", F.last("shelf_price", ignorenulls=True).over(rows(-carry - 1, -1)))
            .withColumn("shelf_to_base_lag1", rel_change("shelf_price_lag1", F.lag("R").over(w)))
            .withColumn("on_sale_lag1", F.lag("on_sale").over(w))
            .withColumn("sale_depth_lag1", F.lag("sale_depth").over(w))
            .withColumn("days_in_sale_lag1", F.lag("days_in_sale").over(w))
            .withColumn("n_sale_days_60d", F.sum("on_sale").over(rows(-60, -1))))


def with_unit_price(grid: DataFrame, keys: Sequence[str] = SEGMENT) -> DataFrame:
    w, _ = _over(keys)
    return grid.withColumn("log_unit_price_lag1", F.ln(F.lag("R").over(w) * F.lag("unit_factor").over(w)))


def with_row_features(rows: DataFrame, keys: Sequence[str], price: str = "price") -> DataFrame:
    """Row-based variant: lags 1/7/14 and full-window means and deviation of earlier rows, gaps ignored."""
    w, span = _over(keys)
    out = {f"price_lag_{k}": F.lag(price, k).over(w) for k in (1, 7, 14)}
    for n in (7, 14):
        frame = span(-n, -1)
        out[f"price_mean_{n}"] = F.when(F.count(price).over(frame) == n, F.avg(price).over(frame))
    week = span(-7, -1)
    out["price_std_7"] = F.when(F.count(price).over(week) == 7, F.stddev_samp(price).over(week))
    return rows.withColumns(out)


# --- cross-section ---------------------------------------------------------------------------------

def repricing_shares(grid: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Share of repriced observations per key and day on a gap-free calendar: yesterday's and the 7-day mean.

    Aggregated to one row per key and day before any window.
    """
    daily = (grid.where(F.col("observed")).where(" and ".join(f"{k} is not null" for k in keys) or "true")
             .groupBy(*keys, "date").agg(F.avg("reg_change").alias("_s")))
    span = daily.select(*keys, "date").unionByName(grid_span(daily, keys))
    filled = span.distinct().join(daily, [*keys, "date"], "left")
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date")
    return filled.select(*keys, "date", F.lag("_s").over(w).alias(f"{out}_reprice_share_1d"),
                         F.avg("_s").over(w.rowsBetween(-7, -1)).alias(f"{out}_reprice_share_7d"))


def grid_span(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All days of the market's calendar for every key (keys beyond the first share the store's calendar)."""
    top = list(keys[:1])
    days = daily.groupBy(*top).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    members = daily.select(*keys).distinct()
    joined = members.join(days, top) if top else members.join(days)
    return joined.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("date"))


def unit_price_medians(grid: DataFrame, keys: Sequence[str] = ("store", "coicop", "unit_basis", "date")) -> DataFrame:
    """Exact cross-sectional median of the log unit price per group and day (``_med``)."""
    known = grid.where(" and ".join(f"{k} is not null" for k in keys))
    return exact_quantiles(known, list(keys), "log_unit_price_lag1", {"_med": 0.5})


def web_index(grid: DataFrame, weights: Mapping[str, float] = V.COICOP_WEIGHTS, keys: Sequence[str] = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """30-day web inflation per (store, category, day) and its fixed-weight store mean, both as of t-1."""
    w = Window.partitionBy(*keys).orderBy("date")
    moves = (grid.withColumn("_m", F.ln(ratio("R", F.lag("R").over(w))))
             .where(F.col("coicop").isNotNull())
             .groupBy("store", "coicop", "date").agg(F.avg(F.when(F.col("observed"), F.col("_m"))).alias("_m")))
    full = grid_span(moves, ["store", "coicop"]).join(moves, ["store", "coicop", "date"], "left")
    per = Window.partitionBy("store", "coicop").orderBy("date")
    category = (full.withColumn("_m", F.coalesce("_m", F.lit(0.0)))
                .select("store", "coicop", "date", F.sum("_m").over(per.rowsBetween(-30, -1)).alias("web_cat_infl_30d")))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("coicop")), F.lit(0.0))
    known = F.col("web_cat_infl_30d").isNotNull()
    store = category.groupBy("store", "date").agg(ratio(
        F.sum(F.when(known, F.col("web_cat_infl_30d") * weight)), F.sum(F.when(known, weight))).alias("web_store_infl_30d"))
    return category, store


def with_cross_section(grid: DataFrame, weights: Mapping[str, float] = V.COICOP_WEIGHTS) -> DataFrame:
    """Joins the daily store and category tables; they hold one row per (category,) day, not per product.

    Every side table is derived from ``grid`` itself, never from a partly joined frame.
    """
    category, store = web_index(grid, weights)
    median_keys = ["store", "coicop", "unit_basis", "date"]
    return (grid.join(repricing_shares(grid, ["store"], "store"), ["store", "date"], "left")
            .join(repricing_shares(grid, ["store", "coicop"], "cat"), ["store", "coicop", "date"], "left")
            .join(unit_price_medians(grid), median_keys, "left")
            .join(category, ["store", "coicop", "date"], "left").join(store, ["store", "date"], "left")
            .withColumn("rel_unit_price_lag1", F.col("log_unit_price_lag1") - F.col("_med")).drop("_med"))


# --- external series -----------------------------------------------------------------------------------

def asof_daily(series: DataFrame, value: str, days: DataFrame) -> DataFrame:
    """Last value dated before each day. ``days`` and ``series`` hold one row per calendar day at most."""
    known = series.where(F.col(value).isNotNull()).groupBy("date").agg(F.min(value).alias("_v"))
    both = days.select("date").distinct().withColumn("_want", F.lit(True)).join(known, "date", "full_outer")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return (both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_want").select("date", value))


def external_changes(series: DataFrame, value: str, days: DataFrame, out: str, shifts: Sequence[int] = (7, 30)) -> DataFrame:
    """As-of level and its relative change against the as-of level ``k`` calendar days earlier."""
    wanted = [days.select("date", F.col("date").alias("_at"), F.lit(0).alias("_k"))] + [
        days.select("date", F.date_sub("date", k).alias("_at"), F.lit(k).alias("_k")) for k in shifts]
    probes = wanted[0]
    for p in wanted[1:]:
        probes = probes.unionByName(p)
    level = asof_daily(series, value, probes.select(F.col("_at").alias("date"))).select(F.col("date").alias("_at"), F.col(value).alias("_v"))
    wide = probes.join(level, "_at", "left").groupBy("date").agg(
        F.max(F.when(F.col("_k") == 0, F.col("_v"))).alias(out),
        *[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_v{k}") for k in shifts])
    return wide.select("date", out, *[rel_change(out, f"_v{k}").alias(f"{out}_change_{k}d" if not out.endswith("_rate")
                                                                     else f"{out[:-5]}_change_{k}d") for k in shifts])


def close_to_close(series: DataFrame, value: str, out: str) -> DataFrame:
    """Relative change between successive observations of a daily series."""
    w = Window.orderBy("date")
    return (series.where(F.col(value).isNotNull())
            .select("date", rel_change(value, F.lag(value).over(w)).alias(out)).where(f"{out} is not null"))


def priced_in(foreign: DataFrame, rate: DataFrame, value: str, rate_col: str, out: str) -> DataFrame:
    return foreign.join(rate, "date").select("date", (F.col(value) * F.col(rate_col)).alias(out))


def compounded(releases: DataFrame, value: str, out: str, periods: int = 3) -> DataFrame:
    """Compounded percentage over the last ``periods`` releases; null when one of them is missing."""
    w = Window.orderBy("release_date").rowsBetween(-(periods - 1), 0)
    total = F.sum(F.ln(1 + F.col(value) / 100)).over(w)
    return releases.withColumn(out, F.when(
        F.count(value).over(w) == F.count(F.lit(1)).over(w), (F.exp(total) - 1) * 100))


def asof_release(days: DataFrame, releases: DataFrame, cols: Sequence[str], lag_days: int = 1) -> DataFrame:
    """Latest release usable on each day (published at least ``lag_days`` earlier) and its age in days."""
    last = (releases.where("release_date is not null").groupBy("release_date").agg(
        F.max_by(F.struct(*cols), F.struct(*cols)).alias("_r")).select(
        F.date_add("release_date", lag_days).alias("date"), F.struct("release_date", "_r").alias("_hit")))
    both = days.select("date").distinct().withColumn("_want", F.lit(True)).join(last, "date", "full_outer")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("_hit", F.last("_hit", ignorenulls=True).over(w)).where("_want")
            .select("date", *[F.col("_hit")["_r"][c].alias(c) for c in cols],
                    F.datediff("date", F.col("_hit")["release_date"]).alias("days_since_release")))


def external_table(days: DataFrame, usd: DataFrame, brent: DataFrame, tuik: DataFrame) -> DataFrame:
    """All external features per calendar day. Every input here is a daily or monthly table."""
    rate = external_changes(usd, "usd_try", days, "usd_try_rate")
    step = asof_daily(close_to_close(usd, "usd_try", "usd_try_rate_change"), "usd_try_rate_change", days)
    oil = external_changes(priced_in(brent, usd, "brent_usd", "usd_try", "brent_try"), "brent_try", days, "brent_try")
    rel = asof_release(days, compounded(tuik, "food_mom_pct", "food_3m"), ["food_mom_pct", "headline_mom_pct", "food_3m"]).select(
        "date", F.col("food_mom_pct").alias("tuik_food_mom_last"), F.col("headline_mom_pct").alias("tuik_headline_mom_last"),
        F.col("food_3m").alias("tuik_food_3m_cum"), F.col("days_since_release").alias("days_since_tuik_release"))
    return rate.join(step, "date", "left").join(oil, "date", "left").join(rel, "date", "left")


def with_external(grid: DataFrame, usd: DataFrame, brent: DataFrame, tuik: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """``days``: the calendar to cover; by default the grid's own."""
    days = grid.select("date").distinct() if days is None else days
    return grid.join(settle(external_table(days, usd, brent, tuik), "external"), "date", "left")


def with_calendar(grid: DataFrame, holidays: Sequence[str] = V.HOLIDAYS_2026) -> DataFrame:
    return K.with_day_flags(K.with_cyclic(grid), holidays=holidays)


def with_targets(grid: DataFrame, outage: tuple | None) -> DataFrame:
    inside = F.col("date").between(*[F.lit(str(d)).cast("date") for d in outage]) if outage else F.lit(False)
    return L.usable_target(grid.withColumn("in_outage", inside).withColumn("target_price", F.col("regular_price"))
                           .withColumn("target_pct_change", rel_change("target_price", "base_price")))


def feature_columns(groups: Sequence[str] | None = None) -> list[str]:
    return [c for g in (groups or V.FEATURE_GROUPS) for c in V.FEATURE_GROUPS[g]]


def build_features(regular: DataFrame, shelf: DataFrame, usd: DataFrame, brent: DataFrame, tuik: DataFrame,
                   outage: tuple | None = None, holidays: Sequence[str] = V.HOLIDAYS_2026,
                   weights: Mapping[str, float] = V.COICOP_WEIGHTS) -> DataFrame:
    """The full feature table, one row per segment and calendar day.

    The grid and the per-segment windows are written to the shared folder. The cross-section reads a few columns
    of them several times and must not repeat the work.
    """
    grid = settle(causal_grid(build_segments(regular, shelf), data_end=shelf.agg(F.max("date")).scalar()), "grid")
    for add in (with_lags, with_rolling, with_changes, with_sale_state, with_unit_price):
        grid = add(grid)
    grid = settle(grid, "windows")
    days = grid.select("date").distinct()
    grid = with_external(with_cross_section(grid, weights), usd, brent, tuik, days)
    return with_targets(with_calendar(grid, holidays), outage)


def select_features(table: DataFrame, groups: Sequence[str] | None = None, categorical: bool = True) -> DataFrame:
    """Keys, targets and the columns of the chosen feature groups."""
    keys = ["store", *[c for c in V.FEATURE_KEYS if c in table.columns]]
    return table.select(*keys, *(V.CATEGORICAL_FEATURES if categorical else ()), *feature_columns(groups))
