"""Cell-level panel operators.

A *cell* is one (series, day). Reducing raw rows to cells first is a map-side combined aggregation, so a
series that owns a third of all raw rows still ends with at most one row per calendar day. That bound is
what makes the per-series windows of the other modules safe.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import exact_quantiles, list_chunks, moved, ratio
from ..fixed_values import OUTAGE_FRACTION, SAME_PRICE_TOL

SERIES = ("store", "name")


def shelf_cells(rows: DataFrame, keys: Sequence[str] = (*SERIES, "date"), price: str = "price") -> DataFrame:
    """Highest price per cell; a lower same-day duplicate is a sale tag."""
    return rows.groupBy(*keys).agg(F.max(price).alias(price))


def shelf_cells_with_flag(rows: DataFrame, keys: Sequence[str], price: str, flag: str, first_by: str) -> DataFrame:
    """Highest price and the flag of the first row (by ``first_by``) per cell."""
    return rows.groupBy(*keys).agg(F.max(price).alias("shelf_price"), F.min_by(flag, first_by).alias(flag))


def average_cells(rows: DataFrame, keys: Sequence[str], price: str = "price") -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(price).alias(price))


def top_row_per_cell(rows: DataFrame, keys: Sequence[str], price: str, ties: Sequence[str]) -> DataFrame:
    """The whole row with the highest price per cell; rows without a price never win.

    One ``max_by`` aggregation instead of a ranking window, so a cell with very many copies is combined
    before the shuffle. Ties go to the smallest ``ties`` values.
    """
    others = [c for c in rows.columns if c not in keys]
    pick = F.min_by(F.struct(*others), F.struct(-F.col(price), *ties))
    return (rows.where(F.col(price).isNotNull()).groupBy(*keys).agg(pick.alias("_row"))
            .select(*keys, *[F.col("_row")[c].alias(c) for c in others]))


def duplicate_cells(rows: DataFrame, keys: Sequence[str], price: str = "price", method: str | None = None) -> DataFrame:
    """Cells with more than one row: row count, distinct prices, first method."""
    first = [F.min(method).alias(method)] if method else []
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(price).alias("n_prices"), *first).where("n > 1")


def products_per_day(rows: DataFrame, keys: Sequence[str] = ("store",), name: str = "name") -> DataFrame:
    return rows.groupBy(*keys, "date").agg(F.countDistinct(name).alias("products"))


def scrape_health(rows: DataFrame, keys: Sequence[str] = ("store",)) -> DataFrame:
    """Distinct products per scrape day over the store's median day. Works on days, at most one row each."""
    per_day = products_per_day(rows, keys)
    median = per_day.groupBy(*keys).agg(F.median("products").alias("median_products"))
    return (per_day.join(median, list(keys))
            .withColumn("ratio_to_median", ratio("products", "median_products")))


def monthly_coverage(rows: DataFrame, keys: Sequence[str] = ("store",)) -> DataFrame:
    per_day = products_per_day(rows, keys).withColumn("month", F.date_format("date", "yyyy-MM"))
    return per_day.groupBy(*keys, "month").agg(
        F.count("*").alias("scrape_days"), F.min("products").alias("min_products"),
        F.median("products").alias("median_products"), F.max("products").alias("max_products"))


def outage_window(rows: DataFrame, before, keys: Sequence[str] = ("store",),
                  fraction: float = OUTAGE_FRACTION) -> DataFrame:
    """First and last day with fewer products than ``fraction`` of the median day before ``before``."""
    per_day = products_per_day(rows, keys)
    usual = (per_day.where(F.col("date") < F.lit(before).cast("date"))
             .groupBy(*keys).agg(F.median("products").alias("usual")))
    low = per_day.join(usual, list(keys)).where(F.col("products") < fraction * F.col("usual"))
    return low.groupBy(*keys).agg(F.min("date").alias("outage_start"), F.max("date").alias("outage_end"),
                                  F.count("*").alias("outage_days"), F.median("products").alias("median_inside"))


def persistent_items(rows: DataFrame, lo, hi, share: float = 0.9, keys: Sequence[str] = ("store",)) -> DataFrame:
    """Names seen in [lo, hi] and how many of them appear on at least ``share`` of the scraped days."""
    inside = rows.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    days = inside.groupBy(*keys).agg(F.countDistinct("date").alias("days"))
    seen = inside.groupBy(*keys, "name").agg(F.countDistinct("date").alias("seen"))
    return seen.join(days, list(keys)).groupBy(*keys).agg(
        F.count("*").alias("names"), F.count_if(F.col("seen") >= share * F.col("days")).alias("persistent"))


def first_known(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First non-null value of each column per key in ``order``, combined map-side."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in cols])


def last_known(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last non-null value of each column per key in ``order``, combined map-side."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in cols])


def most_frequent(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Most frequent non-null value per key; ties go to the smallest. Counts first, then picks."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(out or value), F.max("n").alias("n"))


def sorted_sets(df: DataFrame, keys: Sequence[str], value: str, out: str, size: int = 1_000) -> DataFrame:
    """Sorted distinct values per key, in numbered parts of at most ``size``; duplicates vanish before anything is collected."""
    distinct = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return list_chunks(distinct, keys, [value], F.col(value), out, size)


def share_table(df: DataFrame, key: str, rows: str | None = None) -> DataFrame:
    """Count and share of total per class. ``rows`` also sums a row count."""
    aggs = [F.count("*").alias("names")] + ([F.sum(rows).alias("rows")] if rows else [])
    table = df.groupBy(key).agg(*aggs)          # one row per class
    everything = Window.partitionBy(F.lit(1))
    out = table.withColumn("pct_names", 100 * F.col("names") / F.sum("names").over(everything))
    return out.withColumn("pct_rows", 100 * F.col("rows") / F.sum("rows").over(everything)) if rows else out


def previous_price(cells: DataFrame, keys: Sequence[str] = SERIES, price: str = "price") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date")
    return (cells.withColumn("prev_date", F.lag("date").over(w)).withColumn("prev_price", F.lag(price).over(w))
            .withColumn("prev_gap", F.datediff("date", "prev_date"))
            .withColumn("change", ratio(price, "prev_price") - 1))


def change_rate(cells: DataFrame, keys: Sequence[str] = SERIES, price: str = "price",
                tol: float = SAME_PRICE_TOL) -> DataFrame:
    """Share of observations whose price moved since the previous observation of the series."""
    return previous_price(cells, keys, price).where("prev_price is not null").agg(
        F.count("*").alias("observations"), F.avg((F.abs("change") > tol).cast("double")).alias("change_rate"))


def threshold_sensitivity(cells: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = SERIES) -> DataFrame:
    """Observations whose absolute change exceeds each threshold, in one wide aggregation turned long."""
    changed = previous_price(cells, keys).where("change is not null").select(F.abs("change").alias("c"))
    wide = changed.agg(F.count("*").alias("n"), F.count_if(F.col("c") != 0).alias("nz"),
                       *[F.count_if(F.col("c") > t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("over"))
                               for i, t in enumerate(thresholds)]))
    return (wide.select("n", "nz", rows.alias("r")).select(
        F.col("r.threshold"), F.col("r.over").alias("observations"),
        (100 * ratio("r.over", "n")).alias("share_of_all"), (100 * ratio("r.over", "nz")).alias("share_of_nonzero")))


def score_histogram(df: DataFrame, score: str, edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Counts per half-open bin [lo, hi)."""
    ladder: Column | None = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        hit = (F.col(score) >= lo) & (F.col(score) < hi)
        ladder = F.when(hit, label) if ladder is None else ladder.when(hit, label)
    return df.withColumn("bin", ladder).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def boundary_summary(links: DataFrame, keys: Sequence[str], change: str = "boundary_change") -> DataFrame:
    """Price behaviour at link boundaries: unchanged share, large moves, exact median absolute move."""
    known = links.where(F.col(change).isNotNull()).withColumn("_abs", F.abs(change))
    table = known.groupBy(*keys).agg(
        F.count("*").alias("links"), F.avg((F.col("_abs") <= 1e-8).cast("double")).alias("unchanged"),
        F.avg((F.col("_abs") > 0.2).cast("double")).alias("abs_gt_20"),
        F.avg((F.col("_abs") > 0.8).cast("double")).alias("abs_gt_80"))
    return table.join(exact_quantiles(known, keys, "_abs", {"median_abs": 0.5}), list(keys))


def series_flags(df: DataFrame, keys: Sequence[str], sale: str, pack: str, category: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_or(sale).alias("any_sale"), F.countDistinct(pack).alias("packs"),
                                 F.countDistinct(category).alias("categories"))


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, nulls, mean, deviation, extremes and exact quartiles per numeric column, one row each."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                                         for c in cols])).alias("x")).select("x.column", "x.value")
    base = long.groupBy("column").agg(
        F.count("value").alias("count"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    return base.join(exact_quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "column")


def missing_by_group(df: DataFrame, groups: dict) -> DataFrame:
    """Per feature group: % of rows with any null, and the mean null share of its columns."""
    wide = df.agg(F.count("*").alias("n"), *[x for g, cols in groups.items() for x in (
        F.sum(F.greatest(*[F.col(c).isNull().cast("int") for c in cols], F.lit(0))).alias(f"any_{g}"),
        F.sum(sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))).alias(f"all_{g}"))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(g).alias("feature_group"), (100 * ratio(f"any_{g}", "n")).alias("rows_with_null_pct"),
        (100 * ratio(f"all_{g}", F.col("n") * len(cols))).alias("mean_null_share_pct"))
        for g, cols in groups.items()]))
    return wide.select(rows.alias("r")).select("r.*")

