"""Price files: header census, one read per header shape, dates from names, bad rows set aside; sinks."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..common import col
from ..functions.prices import parse_price
from ..functions.text import fold
from ..operators.cells import shelf_cells
from ..session import settle
from .. import fixed_values as V


def file_date(path, default_year: int = 2026) -> Column:
    """Date in a file name. The first pattern that matches decides; an impossible date gives null."""
    stem = F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)$", 1), r"\.[^.]*$", "")
    out = F.lit(None).cast("date")
    for pattern, order in reversed(V.FILE_DATE_PATTERNS):
        g = [F.regexp_extract(stem, pattern, i) for i in (1, 2, 3)[:len(order)]]
        y, m, d = {"ymd": g, "dmy": g[::-1], "md": [F.lit(str(default_year)), *g]}[order]
        text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        out = F.when(stem.rlike(pattern), F.try_to_date(text, "yyyy-MM-dd")).otherwise(out)
    return out


def folder_store(path) -> Column:
    """Store = name of the folder that holds the file."""
    return F.regexp_extract(col(path), r"([^/]+)/[^/]+$", 1)


def owner_store(path, misfiled: Mapping[str, str] | None = None) -> Column:
    """Store of a file, corrected for files kept in another store's folder ('folder/file' -> owner)."""
    tail = F.regexp_extract(col(path), r"([^/]+/[^/]+)$", 1)
    if not misfiled:
        return folder_store(path)
    table = F.create_map(*[F.lit(x) for kv in misfiled.items() for x in kv])
    return F.coalesce(F.try_element_at(table, tail), folder_store(path))


def _path() -> Column:
    """Path of the file a row is from; the reader gives it URI-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _n_fields(line: Column, sep: str) -> Column:
    """Fields of a CSV line: separators outside quotes, and one."""
    bare = F.regexp_replace(line, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1


def _fields(line: Column, n: int, sep: str) -> Column:
    """The first ``n`` fields of a CSV line as an array; missing ones are null."""
    parsed = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), {"sep": sep, "escape": '"', "quote": '"', "mode": "PERMISSIVE"})
    return F.array(*[parsed[f"c{i}"] for i in range(n)])


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line, block) of every line that is not empty, without byte-order marks."""
    return spark.read.option("recursiveFileLookup", True).text(list(paths)).select(
        _path().alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("line"),
        F.col("_metadata.file_block_start").alias("block")).where("line <> ''")


def headers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, header) of every file with a line. One row per file, taken in the task that reads its beginning."""
    first = _lines(spark, paths).where("block = 0").withColumn("i", F.monotonically_increasing_id())
    return first.groupBy("path").agg(F.min_by("line", "i").alias("header"))


def header_census(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files, first and last date per header."""
    h = headers(spark, paths).withColumn("date", file_date("path"))
    return h.groupBy("header").agg(F.count("*").alias("files"), F.min("date").alias("first"), F.max("date").alias("last"))


def _layout(heads: DataFrame, extra: Mapping[str, str], sep: str) -> tuple[DataFrame, int]:
    """Per file: number of columns, places of name and price and of known extras, and whether the first line is data."""
    heads = heads.withColumn("columns", _n_fields(F.col("header"), sep))
    widest = heads.agg(F.max("columns")).first()[0] or 2
    known = F.create_map(*[F.lit(x) for kv in extra.items() for x in kv])
    names = F.transform(_fields(F.col("header"), widest, sep), lambda c: F.coalesce(F.try_element_at(known, F.trim(c)), F.trim(c)))
    place = lambda wanted: F.coalesce(*[F.nullif(F.array_position("_names", w), F.lit(0)) for w in wanted])
    heads = heads.withColumn("_names", names).withColumn("_n", place(V.NAME_HEADERS)).withColumn("_p", place(V.PRICE_HEADERS))
    bare = (F.col("_n").isNull() | F.col("_p").isNull()) & (F.col("columns") == 2)
    extras = {c: F.when(~bare, place([c])).alias(f"_at_{c}") for c in dict.fromkeys(extra.values())}
    return heads.select("path", "header", "columns", bare.alias("headerless"), F.when(bare, 1).otherwise(F.col("_n")).alias("name_at"),
                        F.when(bare, 2).otherwise(F.col("_p")).alias("price_at"), *extras.values()), widest


def read_price_files(spark: SparkSession, paths: Sequence[str], misfiled: Mapping[str, str] | None = None,
                     extra: Mapping[str, str] = V.HEADER_RENAMES, sep: str = ",",
                     naming: Callable[[Column], Column] = lambda path: path) -> tuple[DataFrame, DataFrame]:
    """All files as (store, path, date, name_raw, price_text, + known extras), and the files set aside with a reason.

    Every line is read once as text and split by its own file's header, so files of any number of layouts
    go through one plan. Short lines keep what they have; lines with more fields than their header are
    skipped. A file with two columns and no known header is all data. Files without a name or price column,
    without a date in the name, or without a line are set aside (Spark's readers do not show files of no bytes). The table of headers, one row a file, is
    settled, so Spark knows its size when it joins it. ``naming`` turns a physical path into 'folder/file'.
    """
    heads = settle(headers(spark, paths), "headers")
    layout, widest = _layout(heads, extra, sep)
    date = file_date(naming(F.col("path")))
    no_columns = F.col("name_at").isNull() | F.col("price_at").isNull()
    reason = F.when(no_columns, "no name or price column").when(date.isNull(), "no date in the file name")
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select(_path().alias("path"))
    aside = (layout.select("path", reason.alias("reason")).where("reason is not null")
             .unionByName(every.join(heads.select("path"), "path", "left_anti").select("path", F.lit("no line to read").alias("reason"))))
    rows = (_lines(spark, paths).join(layout.where(~no_columns), "path").where(F.col("headerless") | (F.col("line") != F.col("header")))
            .where(_n_fields(F.col("line"), sep) <= F.col("columns")).withColumn("_f", _fields(F.col("line"), widest, sep)))
    at = lambda c: F.try_element_at("_f", F.col(c).cast("int"))
    extras = [at(f"_at_{c}").alias(c) for c in dict.fromkeys(extra.values())]
    rows = rows.select(owner_store(naming(F.col("path")), misfiled).alias("store"), "path", date.alias("date"), at("name_at").alias("name_raw"),
                       at("price_at").alias("price_text"), *extras).where("date is not null")
    return rows, aside


def bad_lines(spark: SparkSession, paths: Sequence[str], columns: int, sep: str = ",", header: bool = True) -> DataFrame:
    """Lines with more or fewer fields than ``columns``, with their file."""
    lines = _lines(spark, paths)
    if header:
        lines = lines.join(headers(spark, paths), "path").where(F.col("line") != F.col("header"))
    return lines.where(_n_fields(F.col("line"), sep) != columns).select("path", "line")


def load_stores(spark: SparkSession, paths: Sequence[str], misfiled: Mapping[str, str] | None = None, **kw) -> DataFrame:
    """One row per (store, folded name, day) with the highest positive price."""
    rows, _ = read_price_files(spark, paths, misfiled, **kw)
    names = rows.select("name_raw").distinct().withColumn("name", fold("name_raw", wide=True))   # once per distinct name
    priced = rows.withColumn("price", parse_price("price_text")).where("name_raw is not null and price > 0")
    return shelf_cells(priced.join(names, "name_raw"))


def read_parquet_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_series(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """External daily or monthly series with declared types."""
    return spark.read.csv(path, schema=schema, header=True, dateFormat="yyyy-MM-dd")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Train and test blocks of a JSON configuration, one row per block."""
    doc = spark.read.json(path, multiLine=True)
    b = doc.select(F.explode("blocks").alias("b"), F.col("outage")[0].cast("date").alias("outage_start"), F.col("outage")[1].cast("date").alias("outage_end"))
    return b.select("b.block", *[F.col(f"b.{c}").cast("date").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")],
                    "outage_start", "outage_end")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet sink; rows of one partition value are brought together first so files stay few."""
    out = df.repartition(*partition_by) if partition_by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, once: bool = False) -> None:
    """CSV report; ``once`` keeps an existing one, for files people edit by hand."""
    df.write.mode("ignore" if once else "overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
