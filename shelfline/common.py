"""Helpers shared by the operators: bounded side tables, null-safe ratios, exact quantiles."""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .session import settle

MAX_SIDE_ROWS = 10_000


def side_table(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """A table of caller-given parameters (rules, blocks, thresholds), broadcast after a size check."""
    rows = list(rows)
    if len(rows) > MAX_SIDE_ROWS:
        raise ValueError(f"{len(rows)} parameter rows; pass a DataFrame and a plain join instead")
    return F.broadcast(spark.createDataFrame(rows, schema))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b in doubles; null when b is zero or either side is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def rel_change(new: str | Column, old: str | Column) -> Column:
    return ratio(new, old) - 1


def moved(new: str | Column, old: str | Column, tol: float) -> Column:
    """True when the relative move is larger than ``tol``; null when it is unknown."""
    return F.abs(rel_change(new, old)) > tol


def r6(c: str | Column, digits: int = 6) -> Column:
    """Rounded double; adding 0.0 turns a negative zero into zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def date_lit(value) -> Column:
    return F.lit(str(value)[:10]).cast("date")


def calendar_days(df: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Every calendar day between the first and the last date, per key. Bounded by the calendar."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return (span.where("_lo is not null")
            .select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date)))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles of ``value`` per ``keys`` for groups of any size.

    ``percentile`` keeps every distinct value of a group in one buffer. Here the rows are counted per key and value
    once (map-side), and the counts are dealt out in ranges of key and value. A range runs up its own counts; what
    lies before it in its key is one number per (key, range). A quantile is the smallest value whose running count
    passes the wanted rank, so no task holds more than a range, however large or hot the key.
    """
    by = {f"_k{i}": k for i, k in enumerate(keys)} or {"_k0": None}
    part = [F.col(k) for k in by]
    known = df.where(F.col(value).isNotNull()).select(
        *[(F.col(k) if k else F.lit(0)).alias(a) for a, k in by.items()], F.col(value).cast("double").alias("_v"))
    counts = settle(known.groupBy(*part, "_v").agg(F.count("*").alias("_c")), "counts")
    cut = settle(counts.repartitionByRange(*part, "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*part, "_p").agg(F.sum("_c").alias("_s"))
    before = sizes.select(
        *[F.col(k).alias(f"{k}_") for k in by], F.col("_p").alias("_q"), F.sum("_s").over(Window.partitionBy(*part)).alias("_n"),
        (F.sum("_s").over(Window.partitionBy(*part).orderBy("_p")) - F.col("_s")).alias("_before"))
    same = F.col("_p") == F.col("_q")
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    upto = F.sum("_c").over(Window.partitionBy(*part, "_p").orderBy("_v"))
    ran = cut.withColumn("_upto", upto).join(before, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    rank = {name: F.lit(float(q)) * (F.col("_n") - 1) for name, q in probs.items()}
    passed = lambda at: F.min(F.when(F.col("_upto") > at, F.col("_v")))
    found = ran.groupBy(*part).agg(F.first("_n").alias("_n"), *[
        x for i, at in enumerate(rank.values()) for x in (passed(F.floor(at)).alias(f"_lo{i}"), passed(F.ceil(at)).alias(f"_hi{i}"))])
    between = lambda i, at: F.col(f"_lo{i}") + (at - F.floor(at)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
    return found.select(*[F.col(a).alias(k) for a, k in by.items() if k], *[between(i, at).alias(n) for i, (n, at) in enumerate(rank.items())])


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Adds the place of every row within its key, dense from 0 in ``order``; no key meets in one task.

    Rows are dealt out in ranges of key and order; a range numbers its own rows, and what lies before it in its key
    is one number per (key, range). Rows that are equal in ``keys`` and ``order`` may swap places.
    """
    cut = settle(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = cut.groupBy(*keys, "_p").agg(F.count("*").alias("_s"))
    before = sizes.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.col("_p").alias("_q"),
                          (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_s")).alias("_before"))
    same = F.col("_p") == F.col("_q")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)) - 1
    return cut.withColumn("_i", inside).join(before, same).select(*df.columns, (F.col("_before") + F.col("_i")).alias(out))


def list_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, out: str, size: int = 1_000) -> DataFrame:
    """(keys, part, ``out``): the items of every key in order, in numbered lists of at most ``size``.

    A key of any size becomes many short rows instead of one that has to fit into a task's memory.
    """
    placed = positions(df.withColumn("_item", item), keys, order, "_pos")
    return (placed.groupBy(*keys, F.floor(F.col("_pos") / size).cast("long").alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "_item"))).alias("_l"))        # at most ``size`` items
            .select(*keys, "part", F.transform("_l", lambda x: x["_item"]).alias(out)))
