"""Row-level cleaning: artifact rows, duplicates, health counts, identity, category mapping, blocks."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..common import is_true
from ..functions import prices as P
from .. import fixed_values as V
from .cells import first_known, most_frequent


def parse_listing(raw: DataFrame, price_text: str = "price_text") -> DataFrame:
    """Adds price, per-unit and truncation flags; trims names and cleans IDs."""
    return (raw.withColumn("name", F.trim("name"))
            .withColumn("product_id", P.clean_id("product_id"))
            .withColumn("price", P.parse_price_tokens(price_text))
            .withColumn("is_unit_price", P.is_unit_price(price_text, "name"))
            .withColumn("is_truncated", P.is_truncated("name")))


def unit_price_overlap(parsed: DataFrame) -> DataFrame:
    """Artifact rows, and how many (artifact, same-day row of the base name) matches exist.

    Row counts per (name, day) are joined instead of rows, so many copies of one name stay one row per side.
    """
    bad = (parsed.where("is_unit_price").withColumn("base", F.regexp_replace("name", V.PER_KG_SUFFIX, ""))
           .groupBy("base", "date").agg(F.count("*").alias("a")))
    seen = parsed.groupBy(F.col("name").alias("base"), "date").agg(F.count("*").alias("b"))
    return bad.join(seen, ["base", "date"], "left").agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("unit_rows"),
        F.countDistinct("date").alias("days"),
        F.coalesce(F.sum(F.col("a") * F.coalesce("b", F.lit(0))), F.lit(0)).alias("base_same_day"))


def drop_exact_duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.dropDuplicates(list(keys))


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order``, as one combined aggregation."""
    others = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in others]))


def health_summary(rows: DataFrame, id_start) -> DataFrame:
    """One row of data-health counts around the day product IDs begin."""
    early = F.col("date") < F.lit(id_start).cast("date")
    no_id = F.col("product_id").isNull()
    return rows.agg(
        F.count("*").alias("rows"), F.countDistinct("date").alias("dates"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_if(no_id).alias("pre_rows"), F.countDistinct(F.when(no_id, F.col("date"))).alias("pre_dates"),
        F.count_if(~no_id).alias("post_rows"), F.countDistinct(F.when(~no_id, F.col("date"))).alias("post_dates"),
        F.count_if(early & ~no_id).alias("early_with_id"), F.count_if(~early & no_id).alias("late_without_id"),
        F.count_if(F.col("price").isNull()).alias("unparsed"), F.count_if(F.col("is_truncated")).alias("truncated"))


def usable_rows(rows: DataFrame, required: Sequence[str], price: str = "price") -> DataFrame:
    return rows.na.drop(subset=[*required, price]).where(F.col(price) > 0)


def url_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """URL numbers against the IDs known per name: rows with a URL, comparable rows, agreements."""
    urls = (rows.where("url is not null").withColumn("url_id", F.nullif(F.regexp_extract("url", V.URL_ID_PATTERN, 1), F.lit("")))
            .groupBy("name", "url_id").agg(F.count("*").alias("n")))
    named = known.where("product_id is not null").select("name", "product_id").distinct()
    names = named.select("name").distinct().withColumn("known", F.lit(True))
    pairs = named.withColumnRenamed("product_id", "url_id").withColumn("same", F.lit(True))
    joined = urls.join(names, "name", "left").join(pairs, ["name", "url_id"], "left")
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("url_rows"),
                      F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("comparable"),
                      F.coalesce(F.sum(F.when(F.col("same"), F.col("n"))), F.lit(0)).alias("agree"))


def series_category(rows: DataFrame, keys: Sequence[str], category: str,
                    mapping: Mapping[str, str] = V.CATEGORY_TO_COICOP) -> DataFrame:
    """Most frequent category per series and its mapped code; series without one are 'unknown'."""
    best = most_frequent(rows, keys, category).drop("n")
    codes = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return (rows.select(*keys).distinct().join(best, list(keys), "left")
            .withColumn("coicop", F.coalesce(F.try_element_at(codes, F.col(category)), F.lit("unknown"))))


def fallback_identity(rows: DataFrame, product_id: str = "product_id", name: str = "product_name") -> DataFrame:
    return rows.withColumn("series_id", F.coalesce(
        F.concat(F.lit("id_"), F.col(product_id)), F.concat(F.lit("name_"), F.col(name))))


def fill_within(rows: DataFrame, key: str, cols: Sequence[str], day: str, order: Sequence[str]) -> DataFrame:
    """Missing attributes take the last known value before the row, else the first known after it.

    Values travel between days through a (key, day) summary and inside a day through a per-day window, so a
    key with very many rows is spread over its days. ``order`` ranks the rows of one day.
    """
    inside = Window.partitionBy(key, day).orderBy(*order)
    place = F.struct(*order)
    known = {c: F.when(F.col(c).isNotNull(), place) for c in cols}
    days = rows.groupBy(key, day).agg(*[x for c in cols for x in (
        F.max_by(c, known[c]).alias(f"_l_{c}"), F.min_by(c, known[c]).alias(f"_f_{c}"))])
    along = Window.partitionBy(key).orderBy(day)
    days = days.select(key, day, *[x for c in cols for x in (
        F.last(f"_l_{c}", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_in_{c}"),
        F.first(f"_f_{c}", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias(f"_back_{c}"))])
    back, ahead = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    filled = rows.withColumns({f"_b_{c}": F.last(c, ignorenulls=True).over(back) for c in cols} | {
        f"_a_{c}": F.first(c, ignorenulls=True).over(ahead) for c in cols})
    return filled.join(days, [key, day], "left").select(
        *[c for c in rows.columns if c not in cols],
        *[F.coalesce(f"_b_{c}", f"_in_{c}", f"_a_{c}", f"_back_{c}").alias(c) for c in cols])


def usable_target(df: DataFrame) -> DataFrame:
    """Row may serve as a forecast target."""
    return df.withColumn("usable_target", is_true(
        F.col("observed") & F.col("target_price").isNotNull() & F.col("base_price").isNotNull()
        & ~F.col("sale_unresolved") & ~F.col("in_outage")))


def split_rows(frame: DataFrame, start, end) -> DataFrame:
    return frame.where(F.col("usable_target") & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def block_rows(frame: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of every block at once: part 'train' (no outage rows) or 'test'. ``blocks`` is a side table."""
    d = F.col("date")
    train = (d >= F.col("train_start")) & (d <= F.col("train_end")) & ~F.col("in_outage")
    test = (d >= F.col("test_start")) & (d <= F.col("test_end"))
    part = F.explode(F.filter(F.array(F.when(train, "train"), F.when(test, "test")), lambda x: x.isNotNull()))
    return (frame.where("usable_target").join(blocks, train | test).withColumn("part", part)
            .drop("train_start", "train_end", "test_start", "test_end"))


def block_summary(regular: DataFrame, blocks: DataFrame, keys: Sequence[str], target_day, tol: float = V.SAME_PRICE_TOL,
                  max_gap: int = 3) -> DataFrame:
    """Rows, days and series per block, one-step change rate of the test rows, and its target days."""
    w = Window.partitionBy(*keys).orderBy("date")
    d = F.col("date")
    df = (regular.withColumn("_gap", F.datediff("date", F.lag("date").over(w)))
          .withColumn("_move", F.abs(F.try_divide(F.col("price"), F.lag("price").over(w)) - 1) > tol)
          .withColumn("_series", F.concat_ws("\x00", *keys)))
    train = (d >= F.col("train_start")) & (d <= F.col("train_end")) & ~F.col("in_outage")
    test_any = (d >= F.col("test_start")) & (d <= F.col("test_end"))
    test = test_any & ~F.col("sale_unresolved")
    step = test & (F.col("_gap") <= max_gap)
    df = df.join(blocks, train | test_any)
    return df.groupBy("block").agg(
        F.countDistinct(F.when(train, d)).alias("train_days"), F.count_if(train).alias("train_rows"),
        F.countDistinct(F.when(train, F.col("_series"))).alias("train_series"),
        F.countDistinct(F.when(test, d)).alias("test_days"), F.count_if(test).alias("test_rows"),
        F.countDistinct(F.when(test, F.col("_series"))).alias("test_series"),
        F.count_if(test_any & F.col("sale_unresolved")).alias("test_rows_unresolved"),
        F.count_if(step).alias("one_step_rows"),
        (100 * F.avg(F.when(step, F.col("_move").cast("double")))).alias("test_change_rate_pct"),
        F.array_join(F.array_sort(F.collect_set(F.when(test & target_day, F.date_format("date", "MM-dd")))), ", ")
        .alias("target_days_in_test"))


def reorder(df: DataFrame, first: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Preferred columns first (those that exist), the rest after them, some dropped."""
    lead = [c for c in first if c in df.columns and c not in drop]
    return df.select(*lead, *[c for c in df.columns if c not in lead and c not in drop])


__all__ = [n for n in dir() if not n.startswith("_")]
