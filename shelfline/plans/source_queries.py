"""Source and sink queries (A): files are written by Spark from the tables, then read back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..common import list_chunks
from ..session import scratch_path
from ..sources import files as S
from . import datasets as D
from .datasets import with_sql
from .listings import LISTINGS, listings
from .registry import query

SHAPES = {0: ("product_name", "price"), 1: ("isim", "fiyat"), 2: ("name", "price (TL)")}


def daily_files(spark, sf):
    """Listings as CSV folders per store and month, named with a date; the header depends on the store."""
    rows = listings(spark, sf).where("not price_text like '%/%'").withColumn("shape", F.col("row_b") % 3).withColumn(
        "day", F.trunc("date", "month"))
    root, paths = scratch_path(spark, "csv"), []
    for shape, (n, p) in SHAPES.items():
        path = f"{root}/shop{shape}"
        part = rows.where(F.col("shape") == shape).select(F.col("name").alias(n), F.col("price_text").alias(p), F.date_format("day", "yyyy-MM-dd").alias("day"))
        part.repartition("day").write.partitionBy("day").csv(path, header=True)
        paths.append(path)
    return paths


def dated(col):
    """The written files sit in folders called day=YYYY-MM-DD; turn that into a file name with a date."""
    return F.regexp_replace(col, r".*/(shop\d)/day=([0-9-]+)/.*", "$1/prices_$2.csv")


def days_of_listing():
    return [f"2026-01-{d:02d}" for d in range(1, 26)]


def odd_files(spark, sf):
    """Customers as price files in folders with a blank: renamed columns, short, over-long and quoted lines, files
    without a header, and files without a price column."""
    root, key = scratch_path(spark, "odd files"), F.col("c_custkey")
    item, price = F.concat(F.lit("item "), key.cast("string")), F.concat(key.cast("string"), F.lit(".5"))
    long_ = F.when(key % 11 == 0, F.lit(",,one too many"))
    lines = {0: ("isim,fiyat,kategori", F.concat_ws(",", F.concat(F.lit('"'), item, F.lit('"')), price, F.when(key % 3 > 0, "x"), long_)),
             1: ("price,product_name,kategori", F.concat_ws(",", price, item, F.when(key % 3 > 0, F.lit('"a, b"')), long_)),
             2: (None, F.concat_ws(",", item, price)), 3: ("kategori,name,price (TL)", F.concat_ws(",", F.lit("x"), item, price, long_))}
    rows = D.table(spark, sf, "customer").withColumn("shop", key % 4).withColumn("day", F.date_format(F.date_add(F.lit("2026-01-01"), F.col("c_nationkey").cast("int")), "yyyy-MM-dd"))
    body = F.array(*[F.when(F.col("shop") == s, line) for s, (_, line) in lines.items()])
    head = F.array(*[F.lit(h) for h, _ in lines.values()])
    at = F.col("shop").cast("int") + 1
    no_price = F.col("c_nationkey") >= 20
    # one file a shop and day: its header, if it has one, sorts before its lines
    held = rows.select("shop", "day", F.lit(1).alias("o"), F.when(no_price, item).otherwise(F.element_at(body, at)).alias("value")).unionByName(
        rows.select("shop", "day", F.lit(0).alias("o"), F.when(no_price, F.lit("item")).otherwise(F.element_at(head, at)).alias("value")).distinct())
    for shop in lines:
        (held.where((F.col("shop") == shop) & F.col("value").isNotNull()).repartition("day").sortWithinPartitions("day", "o").select("day", "value")
         .write.partitionBy("day").text(f"{root}/shop {shop}"))
    return root


def listed(col):
    return F.regexp_replace(col, r".*/(shop \d)/day=([0-9-]+)/.*", "$1/list $2.csv")


@query("a4_file_dates", """SELECT CAST(l_shipdate AS DATE) AS date, CAST(CASE WHEN day(l_shipdate) = 31 THEN NULL ELSE l_shipdate END AS DATE) AS parsed FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    days = D.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    style = F.dayofmonth("date") % 3
    name = (F.when(F.dayofmonth("date") == 31, F.date_format("date", "'a/shop_'yyyy'-02-'dd'.csv'")).when(style == 0, F.date_format("date", "'a/shop_'yyyy-MM-dd'.csv'"))
            .when(style == 1, F.date_format("date", "'a/shop_'yyyyMMdd'_0915.csv'")).otherwise(F.date_format("date", "'a/shop_'dd.MM.yyyy'.csv'")))
    return days.select("date", S.file_date(name).alias("parsed"))


CSV_SQL = LISTINGS + """,
csvrows AS (SELECT 'shop' || (row_b % 3) AS store, date_trunc('month', date)::DATE AS date, name, price_text, price FROM parsed WHERE NOT contains(price_text, '/'))"""


@query("a1_a2_a5_csv_rows", with_sql(CSV_SQL) + " SELECT store, date, count(*) AS rows, count(DISTINCT name) AS names FROM csvrows GROUP BY ALL")
def _(spark, sf):
    rows, _ = S.read_price_files(spark, daily_files(spark, sf), naming=dated)
    return rows.groupBy("store", "date").agg(
        F.count("*").alias("rows"), F.countDistinct("name_raw").alias("names"))


@query("a5_a7_a8_load_stores", "SELECT CASE WHEN c_custkey % 4 = 3 THEN 'owner shop' ELSE 'shop ' || c_custkey % 4 END AS store, 'item ' || c_custkey AS name, DATE '2026-01-01' + CAST(c_nationkey AS INT) AS date, "
       "CAST(c_custkey AS DOUBLE) + 0.5 AS price FROM customer WHERE (c_custkey % 11 <> 0 OR c_custkey % 4 = 2) AND c_nationkey < 20")
def _(spark, sf):
    return S.load_stores(spark, [odd_files(spark, sf)], {f"shop 3/list {d}.csv": "owner shop" for d in days_of_listing()}, naming=listed).select("store", "name", "date", "price")


@query("a8_files_set_aside", "SELECT DISTINCT 'shop ' || c_custkey % 4 || '/list ' || strftime(DATE '2026-01-01' + CAST(c_nationkey AS INT), '%Y-%m-%d') || '.csv' AS file, 'no name or price column' AS reason "
       "FROM customer WHERE c_nationkey >= 20")
def _(spark, sf):
    _, aside = S.read_price_files(spark, [odd_files(spark, sf)], naming=listed)
    return aside.where("reason <> 'no line to read'").select(listed(F.col("path")).alias("file"), "reason").distinct()


@query("a3_header_census", with_sql(CSV_SQL) + """ SELECT CASE store WHEN 'shop0' THEN 'product_name,price' WHEN 'shop1' THEN 'isim,fiyat' ELSE 'name,price (TL)' END AS header, count(DISTINCT date) AS files,
 min(date) AS first, max(date) AS last FROM csvrows GROUP BY 1""")
def _(spark, sf):
    h = S.headers(spark, daily_files(spark, sf)).withColumn("date", S.file_date(dated(F.col("path"))))
    return h.groupBy("header").agg(F.countDistinct("date").alias("files"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("a6_misfiled_override", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'other' ELSE 'shop' || o_orderkey % 3 END AS store FROM orders")
def _(spark, sf):
    path = F.concat(F.lit("root/shop"), (F.col("o_orderkey") % 3).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, "/lost.csv").otherwise("/ok.csv"))
    table = {f"shop{i}/lost.csv": "other" for i in range(3)}
    return D.table(spark, sf, "orders").select("o_orderkey", S.owner_store(path, table).alias("store"))


@query("a8_bad_lines", "SELECT count(*) AS bad FROM customer WHERE c_custkey % 7 = 0")
def _(spark, sf):
    path = scratch_path(spark, "lines")
    line = F.concat_ws(",", "c_custkey", "c_name", F.when(F.col("c_custkey") % 7 == 0, "extra,extra2"))
    D.table(spark, sf, "customer").select(line.alias("line")).write.text(path)
    return S.bad_lines(spark, [path], 2, header=False).agg(F.count("*").alias("bad"))


@query("a9_a11_parquet_round_trip", "SELECT s_suppkey, s_nationkey FROM supplier")
def _(spark, sf):
    path = scratch_path(spark, "table")
    S.write_table(D.table(spark, sf, "supplier"), path, ["s_nationkey"])
    return S.read_parquet_columns(spark, path, ["s_suppkey", "s_nationkey"])


@query("a10_a12_csv_series_round_trip", "SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS value FROM orders GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "series")
    S.write_report(D.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("value")), path)
    return S.read_series(spark, path, "date date, value double")


@query("a13_write_once", "SELECT s_suppkey, s_name FROM supplier")
def _(spark, sf):
    path = scratch_path(spark, "once")
    S.write_report(D.table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, once=True)
    S.write_report(D.table(spark, sf, "customer").select("c_custkey", "c_name"), path, once=True)      # the first report stays
    return spark.read.csv(path, header=True).select(F.col("s_suppkey").cast("bigint"), "s_name")


@query("a14_json_blocks", """SELECT 'B' || year(o_orderdate) AS block, min(o_orderdate)::DATE AS train_start, max(o_orderdate)::DATE AS train_end FROM orders GROUP BY 1""")
def _(spark, sf):
    path = scratch_path(spark, "blocks")
    d = F.to_date("o_orderdate")
    b = D.table(spark, sf, "orders").groupBy(F.concat(F.lit("B"), F.year(d)).alias("block")).agg(F.min(d).alias("train_start"), F.max(d).alias("train_end"))
    full = b.withColumn("test_start", F.col("train_end")).withColumn("test_end", F.col("train_end"))
    doc = full.agg(F.collect_list(F.struct("*")).alias("blocks")).withColumn("outage", F.array(F.lit("1998-02-01"), F.lit("1998-02-20")))
    S.write_json(doc, path)   # one row per calendar year
    return S.read_blocks(spark, path).select("block", "train_start", "train_end")


@query("a15_nested_json_export", """SELECT o_custkey AS id, (r - 1) // 5 AS part, string_agg(strftime(o_orderdate, '%Y-%m-%d') || '=' || CAST(round(o_totalprice * 100) AS BIGINT), '|' ORDER BY r) AS points
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) GROUP BY ALL""")
def _(spark, sf):
    path = scratch_path(spark, "export")
    point = F.struct(F.to_date("o_orderdate").alias("d"), "o_totalprice")
    o = D.table(spark, sf, "orders").withColumnRenamed("o_custkey", "id")
    S.write_json(list_chunks(o, ["id"], ["o_orderdate", "o_orderkey"], point, "r", size=5), path)      # short parts, so that a customer has several
    back = spark.read.schema("id bigint, part bigint, r array<struct<d:date,o_totalprice:double>>").json(path)
    text = lambda p: F.concat(p["d"].cast("string"), F.lit("="), F.round(p["o_totalprice"] * 100).cast("long").cast("string"))
    return back.select("id", "part", F.array_join(F.transform("r", text), "|").alias("points"))
