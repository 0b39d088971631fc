"""Unit prices along a series: returns, pack switches, shrinkflation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T


def with_unit_price(regular: DataFrame) -> DataFrame:
    return (regular.withColumn("pack_key", T.pack_key("pack")).withColumn("unit_price", T.unit_price("price", "pack"))
            .withColumn("unit_basis", T.unit_basis("pack")))


def unit_returns(regular: DataFrame, keys: Sequence[str] = ("store", "series_id")) -> DataFrame:
    """Log returns of price and unit price, and the pack switches between successive observations."""
    w = Window.partitionBy(*keys).orderBy("date")
    return (with_unit_price(regular)
            .withColumn("ret_price", F.ln("price") - F.ln(F.lag("price").over(w)))
            .withColumn("ret_unit", F.ln("unit_price") - F.ln(F.lag("unit_price").over(w)))
            .withColumn("prev_key", F.lag("pack_key").over(w))
            .withColumn("switched", F.coalesce(F.col("pack_key") != F.col("prev_key"), F.lit(False))))


def shrinkflation_summary(regular: DataFrame, keys: Sequence[str] = ("store", "series_id"), eps: float = 1e-9) -> DataFrame:
    """Series with a changing pack, rows that break 'unit return = price return' elsewhere, and days with a
    flat price but a moving unit price."""
    moves = unit_returns(regular, keys)
    packs = moves.groupBy(*keys).agg(F.countDistinct("pack_key").alias("_k"))
    j = moves.join(packs, list(keys))
    many = F.col("_k") > 1
    return j.agg(
        F.countDistinct(F.when(many, F.concat_ws("\x00", *keys))).alias("changing_series"),
        F.count_if(~many & (F.abs(F.col("ret_price") - F.col("ret_unit")) > eps)).alias("broken_rows"),
        F.count_if(many & (F.abs("ret_price") < eps) & (F.abs("ret_unit") > eps)).alias("flat_price_days"))
