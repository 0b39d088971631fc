"""Leakage audit: features up to a day must not change when everything from that day on does."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .features import build_features, feature_columns


def scrambled(df: DataFrame, price: str, cutoff: str, seed: int = 42) -> DataFrame:
    """Rows up to ``cutoff``; prices of the cutoff day are multiplied by a hashed factor in [0.3, 3)."""
    last = F.lit(cutoff).cast("date")
    noise = 0.3 + 2.7 * (F.pmod(F.xxhash64(F.lit(seed), "store", "series_id"), F.lit(1000)) / 1000.0)
    return df.where(F.col("date") <= last).withColumn(price, F.when(F.col("date") == last, F.col(price) * noise).otherwise(F.col(price)))


def leakage(regular: DataFrame, shelf: DataFrame, series: tuple, cutoff: str, outage=None, holidays=(), eps: float = 1e-9) -> DataFrame:
    """Changed cells per feature up to the cutoff day; every count must be zero."""
    cols, keys = feature_columns(), ["store", "segment_id", "date"]
    last = F.lit(cutoff).cast("date")
    full = build_features(regular, shelf, *series, outage=outage, holidays=holidays).where(F.col("date") <= last).select(*keys, *cols)
    cut = build_features(scrambled(regular, "price", cutoff), scrambled(shelf, "shelf_price", cutoff), *series, outage=outage, holidays=holidays)
    both = settle(full, "full").alias("a").join(settle(cut.select(*keys, *cols), "cut").alias("b"), keys)
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) & ~F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= eps, F.lit(False))
    wide = both.agg(F.count("*").alias("cells"), *[F.count_if(differs(c)).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("changed_cells"), F.col("cells")) for c in cols]))
    return wide.select(rows.alias("r")).select("r.*")
