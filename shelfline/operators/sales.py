"""Temporary sales in hindsight, regular prices, change counts.

The V-shaped filter is written as window expressions. Outside a sale the reference level of a day is always
the previous observation, so every drop can look for its own return independently. A drop inside a running
sale has a lower bar and returns no later than the sale itself. The union of all [drop, return) intervals
is therefore the walk's result, and no per-series loop is needed.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..common import date_lit, moved, ratio
from .. import fixed_values as V
from .cells import SERIES


def _returns(cells: DataFrame, keys: Sequence[str], horizon: int, max_gap: int | None, outage: tuple | None,
             tol: float) -> DataFrame:
    """Adds day number, island, drop flag and the first day the price is back (at most ``horizon`` days on)."""
    order = Window.partitionBy(*keys).orderBy("_day")
    ahead = order.rangeBetween(1, horizon)
    cut = F.lit(False)
    if max_gap is not None:
        cut = cut | (F.col("_day") - F.col("_prev_day") > max_gap)
    if outage is not None:
        lo, hi = (F.unix_date(date_lit(d)) for d in outage)
        cut = cut | ((F.col("_prev_day") < lo) & (F.col("_day") > hi))
    # a long gap restarts the reference level; an outage only stops the search for a return
    restart = (F.col("_day") - F.col("_prev_day") > max_gap) if max_gap is not None else F.lit(False)
    bar = F.col("_prev_price") * (1 - tol)
    back = F.filter("_ahead", lambda x: (x["i"] == F.col("_island")) & (x["p"] >= bar))
    return (cells.withColumn("_day", F.unix_date("date"))
            .withColumn("_prev_day", F.lag("_day").over(order))
            .withColumn("_prev_price", F.lag("price").over(order))
            .withColumn("_island", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(order))
            .withColumn("_drop", F.coalesce((F.col("price") < bar) & ~restart, F.lit(False)))
            .withColumn("_ahead", F.collect_list(F.struct(
                F.col("_day").alias("d"), F.col("price").alias("p"), F.col("_island").alias("i"))).over(ahead))
            .withColumn("_back", F.when(F.col("_drop"), F.array_min(F.transform(back, lambda x: x["d"]))))
            .drop("_ahead"))


def _covered(keys: Sequence[str], back) -> "F.Column":
    so_far = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.max(back).over(so_far) > F.col("_day"), F.lit(False))


def flag_sales(cells: DataFrame, keys: Sequence[str] = SERIES, window_days: int = V.SALE_WINDOW_DAYS,
               resolve_days: int = V.RESOLVE_MIN_DAYS, max_gap_days: int | None = V.MAX_GAP_DAYS,
               blocked: tuple | None = None, tol: float = V.SAME_PRICE_TOL) -> DataFrame:
    """Adds ``is_sale`` and ``unresolved`` to one-row-per-cell prices.

    ``max_gap_days`` restarts the filter after a scrape gap; ``blocked`` (first, last day of an outage) only
    keeps a return from being looked for across that outage. Use one, or both.
    """
    whole = (Window.partitionBy(*keys).orderBy("_day")
             .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    open_end = (F.col("_drop") & F.col("_back").isNull() & (F.col("_island") == F.max("_island").over(whole))
                & (F.max("_day").over(whole) - F.col("_day") < resolve_days)
                & (F.max("_day").over(whole) - F.col("_day") <= window_days))
    return (_returns(cells, keys, window_days, max_gap_days, blocked, tol)
            .withColumn("is_sale", _covered(keys, F.col("_back")))
            .withColumn("_open", F.when(open_end, F.col("_day")))
            .withColumn("unresolved", F.coalesce(F.col("_day") >= F.min("_open").over(whole), F.lit(False)))
            .select(*cells.columns, "is_sale", "unresolved"))


def carry_regular(flagged: DataFrame, keys: Sequence[str] = SERIES, price: str = "price", sale: str = "is_sale",
                  out: str = "regular") -> DataFrame:
    """Regular price: the shelf price, and the pre-sale level on sale days."""
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return flagged.withColumn(out, F.last(F.when(~F.col(sale), F.col(price)), ignorenulls=True).over(so_far))


def regular_prices(cells: DataFrame, keys: Sequence[str] = SERIES, **kw) -> DataFrame:
    return carry_regular(flag_sales(cells, keys, **kw), keys)


def count_changes(regular: DataFrame, keys: Sequence[str] = SERIES, tol: float = V.SAME_PRICE_TOL) -> DataFrame:
    """Rows whose previous calendar day was observed too, both resolved: change flag and absolute error."""
    w = Window.partitionBy(*keys).orderBy("date")
    compared = (regular.withColumn("_d", F.lag("date").over(w)).withColumn("_r", F.lag("regular").over(w))
                .withColumn("_u", F.lag("unresolved", 1, True).over(w))
                .where((F.datediff("date", "_d") == 1) & ~F.col("unresolved") & ~F.col("_u")
                       & F.col("regular").isNotNull() & F.col("_r").isNotNull()))
    return compared.select(*keys, "date", moved("regular", "_r", tol).alias("changed"),
                           F.abs(F.col("regular") - F.col("_r")).alias("err"))


def daily_rates(changes: DataFrame, store: Sequence[str] = ("store",)) -> DataFrame:
    """Comparable products, changes, persistence error and change rate per store and day."""
    return (changes.groupBy(*store, "date").agg(
        F.count("*").alias("products"), F.sum(F.col("changed").cast("bigint")).alias("changes"),
        F.sum("err").alias("err"))
        .withColumn("rate", ratio("changes", "products"))
        .withColumn("dom", F.dayofmonth("date")).withColumn("dow", F.weekday("date")))


def window_sensitivity(cells: DataFrame, keys: Sequence[str] = SERIES,
                       windows: Sequence[int] = V.SENSITIVITY_WINDOWS, explicit: str | None = None,
                       max_gap_days: int | None = V.MAX_GAP_DAYS, blocked: tuple | None = None,
                       tol: float = V.SAME_PRICE_TOL) -> DataFrame:
    """Sale rows, their share, and the regular-price change rate for several window lengths.

    The first return does not depend on the window, so one pass with the longest window serves all of them.
    """
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    df = _returns(cells, keys, max(windows), max_gap_days, blocked, tol)
    extra = F.col(explicit) if explicit else F.lit(False)
    for w in windows:
        reach = F.when(F.col("_back") - F.col("_day") <= w, F.col("_back"))
        df = df.withColumn(f"_s{w}", _covered(keys, reach) | extra)
    for w in windows:
        prev = F.last(F.when(~F.col(f"_s{w}"), F.col("price")), ignorenulls=True).over(before)
        df = df.withColumn(f"_m{w}", F.when(~F.col(f"_s{w}"), moved("price", prev, tol)))
    wide = df.agg(F.count("*").alias("n"), *[x for w in windows for x in (
        F.count_if(F.col(f"_s{w}")).alias(f"s{w}"), F.avg(F.col(f"_m{w}").cast("double")).alias(f"m{w}"))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(w).alias("window_days"), F.col(f"s{w}").alias("sale_obs"),
        (100 * ratio(f"s{w}", "n")).alias("share_pct"), (100 * F.col(f"m{w}")).alias("change_rate_regular_pct"))
        for w in windows]))
    return wide.select(rows.alias("r")).select("r.*")


def episode_ids(flagged: DataFrame, keys: Sequence[str] = SERIES, sale: str = "is_sale") -> DataFrame:
    """Numbers the sale episodes of a series; rows outside a sale have none."""
    w = Window.partitionBy(*keys).orderBy("date")
    start = F.col(sale) & ~F.lag(sale, 1, False).over(w)
    return (flagged.withColumn("_start", start.cast("int"))
            .withColumn("episode", F.when(F.col(sale), F.sum("_start").over(w))).drop("_start"))


def sale_episodes(flagged: DataFrame, keys: Sequence[str] = SERIES, sale: str = "is_sale") -> DataFrame:
    return (episode_ids(flagged, keys, sale).where("episode is not null").groupBy(*keys, "episode").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("obs"))
        .withColumn("days", F.datediff("end", "start") + 1))
