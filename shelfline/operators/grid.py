"""Pack segments, the daily calendar grid, and the causal regular price."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import ratio
from ..functions import text as T
from ..session import settle
from .. import fixed_values as V


def pack_segments(rows: DataFrame, keys: Sequence[str] = ("store", "series_id"), pack: str = "pack_key") -> DataFrame:
    """Numbers the pack segments of a series: +1 whenever the known pack changes.

    Rows without a pack inherit the previous one, or the next one at the start of the series.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    first = F.first(pack, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    held = F.coalesce(F.last(pack, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first, F.lit(""))
    switched = F.col("_held") != F.lag("_held").over(w)
    return (rows.withColumn("_held", held)
            .withColumn("_new", F.coalesce(switched, F.lit(False)).cast("int"))
            .withColumn("pack_segment", (F.sum("_new").over(w) + 1).cast("int")).drop("_held", "_new"))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], cols: Sequence[str],
                  date: str = "date") -> DataFrame:
    """Latest row of ``right`` on or before each left date, per key.

    Both sides are interleaved in one sorted window, so there is one shuffle by key and no range join. Both
    sides must be cells (one row per key and day). The carried columns travel as one struct, so a null in
    the latest row is kept.
    """
    extra = [c for c in left.columns if c not in (*keys, date)]
    probe = left.select(*keys, date, F.lit(1).alias("_side"), F.struct(*extra).alias("_row"),
                        F.lit(None).cast(right.select(F.struct(*cols)).schema[0].dataType).alias("_hit"))
    build = right.select(*keys, date, F.lit(0).alias("_side"),
                         F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), F.struct(*cols).alias("_hit"))
    w = Window.partitionBy(*keys).orderBy(date, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (probe.unionByName(build).withColumn("_hit", F.last("_hit", ignorenulls=True).over(w))
            .where("_side = 1")
            .select(*keys, date, *[F.col("_row")[c].alias(c) for c in extra], *[F.col("_hit")[c].alias(c) for c in cols]))


def next_observation(probe: DataFrame, cells: DataFrame, keys: Sequence[str], after: str, price: str = "price") -> DataFrame:
    """First observation strictly after ``after`` per probe row: adds ``next_date`` and ``next_price``.

    Probes and observations share one sorted pass; per key the probes are grouped by their day first, so
    many probes on one day count once.
    """
    days = probe.select(*keys, F.col(after).alias("date")).distinct().withColumn("_probe", F.lit(True))
    seen = cells.groupBy(*keys, "date").agg(F.min(price).alias("_p"))
    # a frame that ends with the key is run through anew for every row, so the key is walked from its end
    w = Window.partitionBy(*keys).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    both = seen.join(days, [*keys, "date"], "full_outer")
    found = (both.withColumn("_next", F.last(F.when(F.col("_p").isNotNull(), F.struct("date", "_p")), ignorenulls=True).over(w))
             .where("_probe").select(*keys, F.col("date").alias(after), F.col("_next.date").alias("next_date"),
                                     F.col("_next._p").alias("next_price")))
    return probe.join(found, [*keys, after], "left")


def build_segments(regular: DataFrame, shelf: DataFrame, keys: Sequence[str] = ("store", "series_id")) -> DataFrame:
    """Daily shelf observations with segment id, unit factor, regular price and static attributes.

    ``regular``: keys, date, price, sale_unresolved, pack (struct), coicop, unit_basis.
    ``shelf``: keys, date, shelf_price (cells incl. sale days).
    """
    within = (Window.partitionBy(*keys, "pack_segment").orderBy("date")
              .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    numbered = (pack_segments(regular.withColumn("pack_key", T.pack_key("pack")), keys)
                .withColumn("unit_factor", T.unit_factor("pack"))
                .withColumn("_day", F.col("date"))
                .withColumn("_static", F.struct(
                    "pack_segment", F.first("coicop", ignorenulls=True).over(within).alias("coicop"),
                    F.first("unit_basis", ignorenulls=True).over(within).alias("unit_basis"))))
    # one as-of pass carries everything; the regular price counts only when the hit is of the same day
    joined = asof_backward(shelf, numbered, keys, ["_static", "unit_factor", "_day", "price", "sale_unresolved"])
    backward = Window.partitionBy(*keys).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    same_day = F.col("_day") == F.col("date")
    return (joined.withColumn("_static", F.last("_static", ignorenulls=True).over(backward))
            .select(*shelf.columns, F.coalesce("_static.pack_segment", F.lit(1)).alias("pack_segment"), "unit_factor",
                    F.when(same_day, F.col("price")).alias("regular_price"),
                    F.when(same_day, F.col("sale_unresolved")).alias("sale_unresolved"),
                    F.col("_static.coicop").alias("coicop"), F.col("_static.unit_basis").alias("unit_basis"))
            .withColumn("segment_id", F.concat(F.col(keys[-1]), F.lit("#"), F.col("pack_segment").cast("string"))))


def _sale_starts(obs: DataFrame, keys: Sequence[str], confirm: int, carry: int, tol: float) -> DataFrame:
    """Marks the observations at which the causal rule opens a sale, with the sale's level and last day.

    A drop below the previous level opens a sale unless one is running. Its end does not depend on earlier
    sales: the first later observation of the same unbroken run that is back at the level or at least
    ``confirm`` days on. Only the choice of the drops that open one is sequential; it is a fold over the
    series' drops, not over its days.
    """
    w = Window.partitionBy(*keys).orderBy("_day")
    fresh = F.col("_prev_day").isNull() | (F.col("_day") - F.col("_prev_day") > carry)
    bar = F.col("_prev_price") * (1 - tol)
    ends = F.filter("_ahead", lambda x: (x["r"] == F.col("_run")) & (
        (x["p"] >= bar) | (x["d"] - F.col("_day") >= confirm)))
    marked = (obs.withColumn("_day", F.unix_date("date"))
              .withColumn("_prev_day", F.lag("_day").over(w)).withColumn("_prev_price", F.lag("shelf_price").over(w))
              .withColumn("_fresh", fresh).withColumn("_run", F.sum(F.col("_fresh").cast("int")).over(w))
              .withColumn("_ahead", F.collect_list(F.struct(
                  F.col("_day").alias("d"), F.col("shelf_price").alias("p"), F.col("_run").alias("r")))
                  .over(w.rangeBetween(1, confirm + carry)))
              .withColumn("_next_date", F.lead("date").over(w))
              .withColumn("_start", F.when(
                  ~F.col("_fresh") & (F.col("shelf_price") < bar),
                  F.struct(F.col("_day").alias("day"), F.col("_run").alias("run"),
                           F.array_min(F.transform(ends, lambda x: x["d"])).alias("end"),
                           F.col("_prev_price").alias("level"))))
              .drop("_ahead", "_prev_day", "_prev_price", "_fresh"))
    cols = [c for c in marked.columns if c not in keys]
    packed = marked.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("_rows"))  # at most one row per day
    drops = F.array_sort(F.filter(F.transform("_rows", lambda r: r["_start"]), lambda s: s.isNotNull()))
    zero = F.struct(F.lit(-1 << 30).alias("until"), F.lit(-1).cast("bigint").alias("run"), F.array().cast("array<int>").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        opens = (s["run"] != acc["run"]) | (s["day"] > acc["until"])
        return F.when(opens, F.struct(F.coalesce(s["end"], F.lit((1 << 31) - 1)).alias("until"), s["run"].alias("run"),
                                      F.concat(acc["open"], F.array(s["day"])).alias("open"))).otherwise(acc)

    return (packed.withColumn("_open", F.aggregate(drops, zero, step, lambda acc: acc["open"]))
            .select(*keys, "_open", F.inline("_rows"))
            .withColumn("_start", F.when(F.array_contains("_open", F.col("_day")), F.col("_start")))
            .drop("_open"))


TASK_ROWS = 100_000         # observations of one task, if no series has more; a series has one a day at most


def causal_grid(obs: DataFrame, keys: Sequence[str] = ("store", "segment_id"), confirm: int = V.SALE_CONFIRM_DAYS,
                carry: int = V.CARRY_DAYS, tol: float = V.SAME_PRICE_TOL, data_end: Column | None = None,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """Every calendar day of a segment with the regular price a live system would have used.

    ``obs``: one row per (keys, date) with shelf_price, plus any static columns. Adds observed, R, on_sale,
    sale_depth, days_in_sale and, where present, the carried unit factor and regular price. The grid ends
    ``carry + 1`` days after the last observation, but not after the last day of the data.
    """
    # a task gets a bounded number of observations: Spark joins partitions by their compressed bytes, a fraction of what a grid takes
    obs = settle(obs.where("shelf_price is not null"), "observed")
    obs = obs.repartition(max(1, -(-obs.count() // task_rows)), *keys)
    if data_end is None:
        data_end = obs.agg(F.max("date")).scalar()
    marked = _sale_starts(obs, keys, confirm, carry, tol)
    last = F.coalesce(F.date_sub("_next_date", 1), F.least(F.date_add("date", carry + 1), data_end))
    daily = {"shelf_price", "regular_price", "sale_unresolved", "unit_factor", "price"} & set(obs.columns)
    gridded = (marked.withColumn("_seen", F.col("date")).withColumn("_level_now", F.col("shelf_price"))
               .withColumn("date", F.explode(F.sequence("date", last, F.expr("interval 1 day"))))
               .withColumn("observed", F.col("date") == F.col("_seen"))
               .withColumns({c: F.when(F.col("observed"), F.col(c)) for c in daily})
               .withColumn("_start", F.when(F.col("observed"), F.col("_start"))))
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("_sale")
    stale = F.datediff("date", "_seen")
    running = (s.isNotNull() & (s["run"] == F.col("_run")) & (s["end"].isNull() | (F.col("_day") < s["end"])))
    grid = (gridded.withColumn("_sale", F.last("_start", ignorenulls=True).over(so_far))
            .withColumn("_on", F.coalesce(running, F.lit(False)) & (stale <= carry))
            .withColumn("R", F.when(stale <= carry, F.when(F.col("_on"), s["level"]).otherwise(F.col("_level_now"))))
            .withColumn("on_sale", F.col("_on").cast("double"))
            .withColumn("sale_depth", F.when(F.col("_on") & F.col("observed"), ratio("shelf_price", "R") - 1).otherwise(0.0))
            .withColumn("days_in_sale", F.when(F.col("_on"), F.unix_date("date") - s["day"] + 1).otherwise(0).cast("double")))
    if "unit_factor" in obs.columns:
        grid = grid.withColumn("unit_factor", F.last("unit_factor", ignorenulls=True).over(so_far))
    if "regular_price" in obs.columns:
        grid = grid.withColumn("is_sale_day", F.col("observed") & F.col("regular_price").isNull())
        carried = F.last("regular_price", ignorenulls=True).over(so_far)
        grid = grid.withColumn("regular_price", F.when(F.col("is_sale_day"), carried).otherwise(F.col("regular_price")))
    if "sale_unresolved" in obs.columns:
        grid = grid.withColumn("sale_unresolved", F.coalesce("sale_unresolved", F.lit(False)))
    return grid.drop(*[c for c in grid.columns if c.startswith("_")])
