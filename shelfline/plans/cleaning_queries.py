"""Cleaning (B), aggregation (E) and set-operation (S) queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6, side_table
from ..functions import calendar as K, prices as P
from ..operators import cells as C, cleaning as L, sales as S
from .. import fixed_values as V
from . import datasets as D
from .datasets import with_sql
from .listings import ID_START, LISTINGS, listings
from .registry import query

KIND_CODES = {"ECONOMY": "01", "STANDARD": "05", "PROMO": "09"}
OUTAGE = ("1998-02-01", "1998-02-20")
BLOCKS = [("B1", "1996-01-01", "1997-06-30", "1997-07-01", "1997-12-31"),
          ("B2", "1996-01-01", "1998-12-31", "1999-01-01", "1999-06-30"),
          ("B3", "1996-01-01", "1999-12-31", "2000-01-01", "2000-03-31")]


def parsed(spark, sf):
    return L.parse_listing(listings(spark, sf))


def block_table(spark, rows=BLOCKS):
    raw = side_table(spark, rows, "block string, train_start string, train_end string, test_start string, test_end string")
    return F.broadcast(raw.select("block", *[F.col(c).cast("date").alias(c) for c in raw.columns[1:]]))


BLOCKS_SQL = "blocks AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{b}', DATE '{a}', DATE '{c}', DATE '{d}', DATE '{e}')" for b, a, c, d, e in BLOCKS
) + ") t(block, train_start, train_end, test_start, test_end))"


@query("b1_price_text_to_number", with_sql(LISTINGS) + """
SELECT row_a, row_b, price_text, price AS by_digits, price AS by_tokens FROM parsed""")
def _(spark, sf):
    return listings(spark, sf).select(
        "row_a", "row_b", "price_text", P.parse_price("price_text").alias("by_digits"),
        P.parse_price_tokens(F.regexp_replace("price_text", "Kg", "")).alias("by_tokens"))


@query("b1_price_text_round_trip", """SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS equal
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0""")
def _(spark, sf):
    line = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").groupBy(
        F.col("l_orderkey").alias("row_a"), F.col("l_linenumber").alias("row_b")).agg(
        F.collect_set("l_extendedprice").alias("prices"))
    return listings(spark, sf).join(line, ["row_a", "row_b"]).agg(
        F.count("*").alias("rows"),
        F.count_if(F.array_contains("prices", P.parse_price("price_text"))).alias("equal"))


@query("b2_unit_price_artifacts", with_sql(LISTINGS) + """
SELECT CAST(count(*) AS BIGINT) AS unit_rows, count(DISTINCT date) AS days,
  CAST(sum((SELECT count(*) FROM parsed p WHERE p.name = regexp_replace(u.name, '_1kg$', '') AND p.date = u.date)) AS BIGINT) AS base_same_day
FROM parsed u WHERE is_unit_price""")
def _(spark, sf):
    return L.unit_price_overlap(parsed(spark, sf))


@query("b2_b3_b4_parsed_listing", with_sql(LISTINGS) + """
SELECT row_a, row_b, name, product_id, is_unit_price, is_truncated FROM parsed""")
def _(spark, sf):
    return parsed(spark, sf).select("row_a", "row_b", "name", "product_id", "is_unit_price", "is_truncated")


@query("b5_exact_duplicates", with_sql(LISTINGS) + """
SELECT DISTINCT name, date, product_id FROM parsed WHERE NOT is_unit_price""")
def _(spark, sf):
    keys = ["name", "date", "product_id"]
    return L.drop_exact_duplicates(parsed(spark, sf).where("not is_unit_price").select(*keys), keys)


@query("b5_keep_last_per_file", with_sql(LISTINGS) + """
SELECT date, name, max(row_a * 10 + row_b) AS place, arg_max(list_price, row_a * 10 + row_b) AS list_price
FROM (SELECT DISTINCT ON (date, name, row_a, row_b) * FROM parsed ORDER BY list_price) GROUP BY date, name""")
def _(spark, sf):
    rows = parsed(spark, sf).select("date", "name", (F.col("row_a") * 10 + F.col("row_b")).alias("place"), "list_price")
    once = rows.groupBy("date", "name", "place").agg(F.min("list_price").alias("list_price"))
    return L.keep_last(once, ["date", "name"], ["place"])


@query("b6_health_summary", with_sql(LISTINGS) + f"""
SELECT count(*) AS rows, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date,
 count(*) FILTER (product_id IS NULL) AS pre_rows, count(DISTINCT date) FILTER (product_id IS NULL) AS pre_dates,
 count(*) FILTER (product_id IS NOT NULL) AS post_rows, count(DISTINCT date) FILTER (product_id IS NOT NULL) AS post_dates,
 count(*) FILTER (date < DATE '{ID_START}' AND product_id IS NOT NULL) AS early_with_id,
 count(*) FILTER (date >= DATE '{ID_START}' AND product_id IS NULL) AS late_without_id,
 count(*) FILTER (tok IS NULL) AS unparsed, count(*) FILTER (is_truncated) AS truncated
FROM (SELECT *, CASE WHEN price_text LIKE '%Kg%' THEN price ELSE price END AS tok FROM parsed)""")
def _(spark, sf):
    return L.health_summary(parsed(spark, sf), ID_START)


@query("b7_required_and_positive", """SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_tax FROM lineitem
WHERE l_returnflag IS NOT NULL AND l_extendedprice > 0""")
def _(spark, sf):
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"),
                                                 "l_tax", "l_returnflag")
    return L.usable_rows(rows, ["l_returnflag"]).drop("l_returnflag")


@query("b10_explicit_sale", with_sql(LISTINGS) + """
SELECT row_a, row_b, coalesce(TRY_CAST(replace(replace(replace(old_price, '₺', ''), '.', ''), ',', '.') AS DOUBLE) > price * 1.005, false) AS explicit_sale
FROM parsed""")
def _(spark, sf):
    return parsed(spark, sf).select("row_a", "row_b", P.explicit_sale(
        P.parse_price("old_price"), P.parse_price("price_text")).alias("explicit_sale"))


@query("b11_url_ids", with_sql(LISTINGS) + """
, known AS (SELECT DISTINCT name, product_id FROM parsed WHERE product_id IS NOT NULL),
u AS (SELECT name, regexp_extract(url, '-([0-9]+)-p/?$', 1) AS url_id FROM parsed WHERE url IS NOT NULL)
SELECT count(*) AS url_rows, count(*) FILTER (name IN (SELECT name FROM known)) AS comparable,
 count(*) FILTER (EXISTS (SELECT 1 FROM known k WHERE k.name = u.name AND k.product_id = u.url_id)) AS agree FROM u""")
def _(spark, sf):
    rows = parsed(spark, sf)
    return L.url_ids(rows, rows.where("product_id is not null"))


@query("b11_page_url_number", """SELECT page_id, CASE WHEN regexp_extract(url, '/([0-9]+)[?]', 1) <> '' THEN
 CAST(regexp_extract(url, '/([0-9]+)[?]', 1) AS BIGINT) END AS url_id FROM pages""")
def _(spark, sf):
    return D.table(spark, sf, "pages").select(
        "page_id", F.nullif(F.regexp_extract("url", r"/([0-9]+)[?]", 1), F.lit("")).cast("bigint").alias("url_id"))


@query("b12_category_codes", with_sql(LISTINGS) + """
, cnt AS (SELECT name, category, count(*) AS n FROM parsed WHERE category IS NOT NULL GROUP BY ALL),
best AS (SELECT name, category FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, category) AS r FROM cnt) WHERE r = 1)
SELECT n.name, category, CASE category WHEN 'ECONOMY' THEN '01' WHEN 'STANDARD' THEN '05' WHEN 'PROMO' THEN '09' ELSE 'unknown' END AS coicop
FROM (SELECT DISTINCT name FROM parsed) n LEFT JOIN best b ON b.name = n.name""")
def _(spark, sf):
    return L.series_category(parsed(spark, sf), ["name"], "category", KIND_CODES)


@query("b16_identity_fallback", with_sql(LISTINGS) + """
SELECT row_a, row_b, coalesce('id_' || product_id, 'name_' || name) AS series_id FROM parsed""")
def _(spark, sf):
    return L.fallback_identity(parsed(spark, sf), name="name").select("row_a", "row_b", "series_id")


@query("b17_reorder_and_drop", """SELECT p_brand, p_partkey, p_name, p_type, p_size FROM part""")
def _(spark, sf):
    return L.reorder(D.table(spark, sf, "part"), ["p_brand", "missing", "p_partkey"], drop=["p_retailprice"])


# --- aggregations ------------------------------------------------------------------------------------

@query("e2_cell_price_and_first_flag", """SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date,
 max(l_extendedprice) AS shelf_price, arg_min(l_linestatus = 'O', (l_orderkey, l_linenumber, l_linestatus = 'O')) AS in_outage
FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("date"), "l_extendedprice",
        (F.col("l_linestatus") == "O").alias("in_outage"), "l_orderkey", "l_linenumber")
    place = F.struct("l_orderkey", "l_linenumber", "in_outage")
    return C.shelf_cells_with_flag(rows.withColumn("place", place), ["series_id", "date"], "l_extendedprice",
                                   "in_outage", "place")


@query("e3_average_same_day", with_sql(D.LONG_ROWS) + """
SELECT store, name, date, round(avg(price), 6) AS price FROM long_rows GROUP BY ALL""")
def _(spark, sf):
    return C.average_cells(D.long_rows(spark, sf), ["store", "name", "date"]).withColumn("price", r6("price"))


@query("e4_duplicate_cells", """SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date, count(*) AS n,
 count(DISTINCT l_extendedprice) AS n_prices, min(l_returnflag) AS method FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def _(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("method"))
    return C.duplicate_cells(rows, ["series_id", "date"], method="method")


@query("e5_products_per_day", with_sql(D.EVENT_ROWS) + """
SELECT store, date, count(DISTINCT name) AS products FROM event_rows GROUP BY ALL""")
def _(spark, sf):
    return C.products_per_day(D.event_rows(spark, sf))


@query("e5_monthly_coverage", with_sql(D.LONG_ROWS) + """
, d AS (SELECT store, date, count(DISTINCT name) AS products FROM long_rows GROUP BY ALL)
SELECT store, strftime(date, '%Y-%m') AS month, count(*) AS scrape_days, min(products) AS min_products,
 CAST(median(products) AS DOUBLE) AS median_products, max(products) AS max_products FROM d GROUP BY ALL""")
def _(spark, sf):
    return C.monthly_coverage(D.long_rows(spark, sf))


@query("e6_outage_window", with_sql(D.EVENT_ROWS) + """
, d AS (SELECT store, date, count(DISTINCT name) AS products FROM event_rows GROUP BY ALL),
u AS (SELECT store, median(products) AS usual FROM d WHERE date < DATE '2024-01-16' GROUP BY ALL)
SELECT store, min(date) AS outage_start, max(date) AS outage_end, count(*) AS outage_days,
 CAST(median(products) AS DOUBLE) AS median_inside FROM d JOIN u USING (store) WHERE products < 0.95 * usual GROUP BY store""")
def _(spark, sf):
    return C.outage_window(D.event_rows(spark, sf), "2024-01-16", fraction=0.95)


@query("e7_scrape_health", with_sql(D.EVENT_ROWS) + """
, d AS (SELECT store, date, count(DISTINCT name) AS products FROM event_rows GROUP BY ALL),
m AS (SELECT store, CAST(median(products) AS DOUBLE) AS median_products FROM d GROUP BY ALL)
SELECT store, date, products, median_products, round(products / median_products, 6) AS ratio_to_median FROM d JOIN m USING (store)""")
def _(spark, sf):
    return C.scrape_health(D.event_rows(spark, sf)).withColumn("ratio_to_median", r6("ratio_to_median"))


@query("e8_persistent_items", with_sql(D.EVENT_ROWS) + """
, w AS (SELECT * FROM event_rows WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'),
d AS (SELECT store, count(DISTINCT date) AS days FROM w GROUP BY ALL),
s AS (SELECT store, name, count(DISTINCT date) AS seen FROM w GROUP BY ALL)
SELECT store, count(*) AS names, count(*) FILTER (seen >= 0.5 * days) AS persistent FROM s JOIN d USING (store) GROUP BY store""")
def _(spark, sf):
    return C.persistent_items(D.event_rows(spark, sf), "2024-01-05", "2024-01-12", share=0.5)


@query("e9_name_spans_per_id", with_sql(LISTINGS) + """
SELECT product_id, name, min(date) AS first_seen, max(date) AS last_seen, count(DISTINCT date) AS days
FROM parsed WHERE product_id IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    from ..operators.matching import name_spans
    return name_spans(parsed(spark, sf).where("product_id is not null"))


@query("e10_sorted_ids_per_name", with_sql(LISTINGS) + """
SELECT name, (r - 1) // 3 AS part, string_agg(product_id, '|' ORDER BY product_id) AS ids, count(*) AS n_ids
FROM (SELECT name, product_id, row_number() OVER (PARTITION BY name ORDER BY product_id) AS r FROM (SELECT DISTINCT name, product_id FROM parsed WHERE product_id IS NOT NULL)) GROUP BY ALL""")
def _(spark, sf):
    out = C.sorted_sets(parsed(spark, sf), ["name"], "product_id", "ids", size=3)       # short parts, so that the data has several
    return out.select("name", "part", F.array_join("ids", "|").alias("ids"), F.size("ids").cast("bigint").alias("n_ids"))


@query("e11_mode_per_series", """SELECT l_suppkey, l_linenumber AS mode_line, n FROM (SELECT *, row_number() OVER (
 PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS r FROM (SELECT l_suppkey, l_linenumber, count(*) AS n
 FROM lineitem GROUP BY ALL)) WHERE r = 1""")
def _(spark, sf):
    return C.most_frequent(D.table(spark, sf, "lineitem"), ["l_suppkey"], "l_linenumber", "mode_line")


@query("e12_most_frequent_id", with_sql(LISTINGS) + """
SELECT name, product_id AS series_id, n FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, product_id) AS r
 FROM (SELECT name, product_id, count(*) AS n FROM parsed WHERE product_id IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
def _(spark, sf):
    return C.most_frequent(parsed(spark, sf), ["name"], "product_id", "series_id")


@query("e13_e14_first_and_last_known", with_sql(LISTINGS) + """
SELECT name, arg_min(category, (date, row_a, row_b)) FILTER (category IS NOT NULL) AS first_category,
 arg_max(old_price, (date, row_a, row_b)) FILTER (old_price IS NOT NULL) AS last_old_price
FROM (SELECT DISTINCT ON (row_a, row_b, date, name) * FROM (SELECT row_a, row_b, date, name, min(category) AS category,
  min(old_price) AS old_price FROM parsed GROUP BY ALL)) GROUP BY name""")
def _(spark, sf):
    rows = parsed(spark, sf).groupBy("row_a", "row_b", "date", "name").agg(
        F.min("category").alias("first_category"), F.min("old_price").alias("last_old_price"))
    order = ["date", "row_a", "row_b"]
    return C.first_known(rows, ["name"], ["first_category"], order).join(
        C.last_known(rows, ["name"], ["last_old_price"], order), "name")


@query("e15_daily_store_rates", D.EVENT_DAILY + """
SELECT store, date, products, changes, round(err, 6) AS err, round(rate, 6) AS rate, dom, dow FROM daily""")
def _(spark, sf):
    return event_daily(spark, sf).withColumn("err", r6("err")).withColumn("rate", r6("rate"))


def event_daily(spark, sf):
    return S.daily_rates(S.count_changes(S.regular_prices(D.event_panel(spark, sf))))


def long_daily(spark, sf):
    return S.daily_rates(S.count_changes(S.regular_prices(D.long_panel(spark, sf))))


@query("e20_share_table", with_sql(LISTINGS) + """
, n AS (SELECT name, min(is_truncated) AS is_truncated, count(*) AS rows, CAST(min(row_b) AS VARCHAR) AS cls FROM parsed GROUP BY name)
SELECT cls, count(*) AS names, CAST(sum(rows) AS BIGINT) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_names,
 round(100.0 * sum(rows) / sum(sum(rows)) OVER (), 6) AS pct_rows FROM n GROUP BY cls""")
def _(spark, sf):
    names = parsed(spark, sf).groupBy("name").agg(F.count("*").alias("rows"), F.min("row_b").cast("string").alias("cls"))
    return C.share_table(names, "cls", "rows").withColumn("pct_names", r6("pct_names")).withColumn("pct_rows", r6("pct_rows"))


@query("e21_threshold_sensitivity", with_sql(D.SPARSE_PANEL) + """
, c AS (SELECT abs(price / lag(price) OVER (PARTITION BY store, name ORDER BY date) - 1) AS c FROM panel),
t AS (SELECT unnest([0.2, 0.5, 0.8, 1.0, 2.0])::DOUBLE AS threshold)
SELECT threshold, count(*) FILTER (c > threshold) AS observations,
 round(100.0 * count(*) FILTER (c > threshold) / count(*), 6) AS share_of_all,
 round(100.0 * count(*) FILTER (c > threshold) / count(*) FILTER (c <> 0), 6) AS share_of_nonzero
FROM c, t WHERE c IS NOT NULL GROUP BY threshold""")
def _(spark, sf):
    out = C.threshold_sensitivity(D.sparse_panel(spark, sf), V.JUMP_THRESHOLDS)
    return out.withColumn("share_of_all", r6("share_of_all")).withColumn("share_of_nonzero", r6("share_of_nonzero"))


@query("e22_score_histogram", """SELECT CASE WHEN s < 0.3 THEN '<0.3' WHEN s < 0.5 THEN '0.3-0.5' WHEN s < 0.7 THEN '0.5-0.7'
 WHEN s < 0.9 THEN '0.7-0.9' ELSE '0.9-1.0' END AS bin, count(*) AS n
FROM (SELECT l_quantity / 50.0 AS s FROM lineitem) WHERE s >= 0 AND s < 1.0001 GROUP BY 1""")
def _(spark, sf):
    rows = D.table(spark, sf, "lineitem").select((F.col("l_quantity") / 50.0).alias("s"))
    return C.score_histogram(rows, "s", V.SCORE_BIN_EDGES, V.SCORE_BIN_LABELS)


@query("e23_boundary_summary", with_sql(D.SPARSE_PANEL) + """
, c AS (SELECT store, date < DATE '1998-01-01' AS crosses, price / lag(price) OVER (PARTITION BY store, name ORDER BY date) - 1 AS c FROM panel)
SELECT store, crosses, count(*) AS links, round(avg(CAST(abs(c) <= 1e-8 AS INT)), 6) AS unchanged, round(avg(CAST(abs(c) > 0.2 AS INT)), 6) AS abs_gt_20,
 round(avg(CAST(abs(c) > 0.8 AS INT)), 6) AS abs_gt_80, round(median(abs(c)), 6) AS median_abs
FROM c WHERE c IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    links = C.previous_price(D.sparse_panel(spark, sf)).select(
        "store", (F.col("date") < F.lit("1998-01-01").cast("date")).alias("crosses"), F.col("change").alias("boundary_change"))
    out = C.boundary_summary(links, ["store", "crosses"])
    return out.select("store", "crosses", "links", *[r6(c).alias(c) for c in ("unchanged", "abs_gt_20", "abs_gt_80", "median_abs")])


@query("e24_coverage_per_method", with_sql(LISTINGS) + f"""
SELECT category AS method, count(*) AS all_rows, count(*) FILTER (date < DATE '{ID_START}') AS early_rows,
 round(100.0 * count(*) FILTER (date < DATE '{ID_START}') / sum(count(*) FILTER (date < DATE '{ID_START}')) OVER (), 6) AS early_pct
FROM parsed GROUP BY category""")
def _(spark, sf):
    from ..operators.matching import method_coverage
    out = method_coverage(parsed(spark, sf).withColumnRenamed("category", "method"), ID_START)
    return out.withColumn("early_pct", r6("early_pct"))


@query("e25_series_flags", with_sql(LISTINGS) + """
SELECT name, bool_or(old_price IS NOT NULL) AS any_sale, count(DISTINCT product_id) AS packs, count(DISTINCT category) AS categories
FROM parsed GROUP BY name""")
def _(spark, sf):
    rows = parsed(spark, sf).withColumn("sale", F.col("old_price").isNotNull())
    return C.series_flags(rows, ["name"], "sale", "product_id", "category")


@query("e26_sale_episodes", with_sql(D.SPARSE_PANEL, D.sale_flags_sql()) + """
, st AS (SELECT *, is_sale AND NOT lag(is_sale, 1, false) OVER (PARTITION BY store, name ORDER BY date) AS s FROM flagged),
ep AS (SELECT *, CAST(sum(CAST(s AS INT)) OVER (PARTITION BY store, name ORDER BY date) AS BIGINT) AS episode FROM st)
SELECT store, name, episode, min(date) AS start, max(date) AS "end", count(*) AS obs, CAST(max(date) - min(date) + 1 AS INT) AS days
FROM ep WHERE is_sale GROUP BY store, name, episode""")
def _(spark, sf):
    return S.sale_episodes(S.flag_sales(D.sparse_panel(spark, sf)))


@query("e26_episode_length_profile", with_sql(D.SPARSE_PANEL, D.sale_flags_sql()) + """
, st AS (SELECT *, is_sale AND NOT lag(is_sale, 1, false) OVER (PARTITION BY store, name ORDER BY date) AS s FROM flagged),
ep AS (SELECT *, sum(CAST(s AS INT)) OVER (PARTITION BY store, name ORDER BY date) AS episode FROM st),
e AS (SELECT max(date) - min(date) + 1 AS days FROM ep WHERE is_sale GROUP BY store, name, episode)
SELECT 'days' AS "column", count(*) AS "count", CAST(0 AS BIGINT) AS nulls, round(avg(days), 6) AS mean, round(stddev_samp(days), 6) AS std,
 CAST(min(days) AS DOUBLE) AS min, CAST(max(days) AS DOUBLE) AS max, quantile_cont(days::DOUBLE, 0.25) AS p25, quantile_cont(days::DOUBLE, 0.5) AS p50,
 quantile_cont(days::DOUBLE, 0.75) AS p75 FROM e""")
def _(spark, sf):
    out = C.profile(S.sale_episodes(S.flag_sales(D.sparse_panel(spark, sf))), ["days"])
    return out.withColumn("mean", r6("mean")).withColumn("std", r6("std"))


@query("e27_block_summary", with_sql(D.SPARSE_PANEL, D.sale_flags_sql(), BLOCKS_SQL) + f"""
, reg AS (SELECT *, date - lag(date) OVER s AS gap, abs(price / lag(price) OVER s - 1) > 0.005 AS move,
   date BETWEEN DATE '{OUTAGE[0]}' AND DATE '{OUTAGE[1]}' AS in_outage, day(date) IN (1, 15) OR date = last_day(date) AS td,
   store || '|' || name AS series FROM flagged WHERE NOT is_sale WINDOW s AS (PARTITION BY store, name ORDER BY date)),
j AS (SELECT *, date BETWEEN train_start AND train_end AND NOT in_outage AS tr, date BETWEEN test_start AND test_end AS te_any,
   date BETWEEN test_start AND test_end AND NOT unresolved AS te FROM reg, blocks)
SELECT block, count(DISTINCT CASE WHEN tr THEN date END) AS train_days, count(*) FILTER (tr) AS train_rows,
 count(DISTINCT CASE WHEN tr THEN series END) AS train_series, count(DISTINCT CASE WHEN te THEN date END) AS test_days,
 count(*) FILTER (te) AS test_rows, count(DISTINCT CASE WHEN te THEN series END) AS test_series,
 count(*) FILTER (te_any AND unresolved) AS test_rows_unresolved, count(*) FILTER (te AND gap <= 3) AS one_step_rows,
 round(100 * avg(CASE WHEN te AND gap <= 3 THEN CAST(move AS INT) END), 6) AS test_change_rate_pct,
 coalesce(array_to_string(list_sort(list(DISTINCT strftime(date, '%m-%d')) FILTER (te AND td)), ', '), '') AS target_days_in_test
FROM j GROUP BY block""")
def _(spark, sf):
    reg = (S.flag_sales(D.sparse_panel(spark, sf)).where("not is_sale").withColumnRenamed("unresolved", "sale_unresolved")
           .withColumn("in_outage", F.col("date").between(*[F.lit(d).cast("date") for d in OUTAGE])))
    out = L.block_summary(reg, block_table(spark), ["store", "name"], K.is_target_spec("date", ()))
    return out.withColumn("test_change_rate_pct", r6("test_change_rate_pct"))


@query("e28_missingness_per_group", """SELECT g AS feature_group, round(100.0 * sum(a) / count(*), 6) AS rows_with_null_pct, round(100.0 * sum(m) / count(*), 6) AS mean_null_share_pct
FROM (SELECT 'x' AS g, CAST(x1 IS NULL OR x2 IS NULL AS INT) AS a, (CAST(x1 IS NULL AS INT) + CAST(x2 IS NULL AS INT)) / 2.0 AS m FROM (SELECT CASE WHEN l_linenumber > 2 THEN l_tax END x1, CASE WHEN l_quantity > 9 THEN l_tax END x2 FROM lineitem)
UNION ALL SELECT 'y', CAST(l_linenumber > 5 AS INT), CAST(l_linenumber > 5 AS INT) FROM lineitem) GROUP BY g""")
def _(spark, sf):
    df = D.table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") > 2, F.col("l_tax")).alias("x1"), F.when(F.col("l_quantity") > 9, F.col("l_tax")).alias("x2"),
        F.when(F.col("l_linenumber") <= 5, F.col("l_tax")).alias("y1"))
    out = C.missing_by_group(df, {"x": ["x1", "x2"], "y": ["y1"]})
    return out.select("feature_group", r6("rows_with_null_pct").alias("rows_with_null_pct"), r6("mean_null_share_pct").alias("mean_null_share_pct"))


@query("e29_profile", """SELECT c AS "column", count(v) AS "count", count(*) - count(v) AS nulls, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
 min(v) AS min, max(v) AS max, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75
FROM (SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', CASE WHEN l_linenumber > 1 THEN l_discount END FROM lineitem) GROUP BY c""")
def _(spark, sf):
    df = D.table(spark, sf, "lineitem").select("l_quantity", F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("l_discount"))
    return C.profile(df, ["l_quantity", "l_discount"]).withColumn("mean", r6("mean")).withColumn("std", r6("std"))


@query("t6_sale_window_sensitivity", " UNION ALL ".join(
    "(" + with_sql(D.SPARSE_PANEL, D.sale_flags_sql(window=w)) + f"""
, reg AS (SELECT abs(price / lag(price) OVER (PARTITION BY store, name ORDER BY date) - 1) > 0.005 AS m FROM flagged WHERE NOT is_sale)
SELECT {w} AS window_days, count(*) FILTER (is_sale) AS sale_obs, round(100.0 * count(*) FILTER (is_sale) / count(*), 6) AS share_pct,
 round(100 * (SELECT avg(CAST(m AS INT)) FROM reg), 6) AS change_rate_regular_pct FROM flagged)""" for w in V.SENSITIVITY_WINDOWS))
def _(spark, sf):
    out = S.window_sensitivity(D.sparse_panel(spark, sf))
    return out.withColumn("share_pct", r6("share_pct")).withColumn("change_rate_regular_pct", r6("change_rate_regular_pct"))


@query("f14_episode_ids", with_sql(D.SPARSE_PANEL, D.sale_flags_sql()) + """
, st AS (SELECT *, is_sale AND NOT lag(is_sale, 1, false) OVER (PARTITION BY store, name ORDER BY date) AS s FROM flagged)
SELECT store, name, date, CASE WHEN is_sale THEN CAST(sum(CAST(s AS INT)) OVER (PARTITION BY store, name ORDER BY date) AS BIGINT) END AS episode FROM st""")
def _(spark, sf):
    return S.episode_ids(S.flag_sales(D.sparse_panel(spark, sf))).select("store", "name", "date", "episode")


@query("f16_consecutive_day_changes", with_sql(D.EVENT_PANEL, D.sale_flags_sql(), D.REGULAR, D.CHANGES) + """
SELECT store, name, date, changed, round(err, 6) AS err FROM changes""")
def _(spark, sf):
    return S.count_changes(S.regular_prices(D.event_panel(spark, sf))).withColumn("err", r6("err"))


@query("f17_top_row_per_cell", """SELECT series_id, date, price, l_orderkey, l_linenumber, l_quantity FROM (SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date,
 l_extendedprice AS price, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) AS r FROM lineitem) WHERE r = 1""")
def _(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"),
        "l_orderkey", "l_linenumber", "l_quantity")
    return C.top_row_per_cell(rows, ["series_id", "date"], "price", ["l_orderkey", "l_linenumber", "l_quantity"])


@query("f20_previous_price_change_rate", with_sql(D.SPARSE_PANEL) + """
SELECT count(c) AS observations, round(avg(CAST(abs(c) > 0.005 AS INT)), 6) AS change_rate
FROM (SELECT price / lag(price) OVER (PARTITION BY store, name ORDER BY date) - 1 AS c FROM panel) WHERE c IS NOT NULL""")
def _(spark, sf):
    return C.change_rate(D.sparse_panel(spark, sf)).withColumn("change_rate", r6("change_rate"))


@query("f22_previous_gap", with_sql(D.SPARSE_PANEL) + """
SELECT store, name, date, CAST(date - lag(date) OVER (PARTITION BY store, name ORDER BY date) AS INT) AS prev_gap FROM panel""")
def _(spark, sf):
    return C.previous_price(D.sparse_panel(spark, sf)).select("store", "name", "date", "prev_gap")


@query("f15_fill_within_name", with_sql(LISTINGS) + """
, d AS (SELECT name, date, row_a, row_b, min(category) AS category, min(product_id) AS product_id FROM parsed GROUP BY ALL)
SELECT name, date, row_a, row_b,
 coalesce(last_value(category IGNORE NULLS) OVER b, first_value(category IGNORE NULLS) OVER f) AS category,
 coalesce(last_value(product_id IGNORE NULLS) OVER b, first_value(product_id IGNORE NULLS) OVER f) AS product_id
FROM d WINDOW b AS (PARTITION BY name ORDER BY date, row_a, row_b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 f AS (PARTITION BY name ORDER BY date, row_a, row_b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def _(spark, sf):
    rows = parsed(spark, sf).groupBy("name", "date", "row_a", "row_b").agg(
        F.min("category").alias("category"), F.min("product_id").alias("product_id"))
    return L.fill_within(rows, "name", ["category", "product_id"], "date", ["row_a", "row_b"]).select(
        "name", "date", "row_a", "row_b", "category", "product_id")


# --- set operations -----------------------------------------------------------------------------------

@query("s1_union_by_name", """SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier""")
def _(spark, sf):
    a = D.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = D.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("s5_mask_union", """SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders
WHERE day(o_orderdate) IN (1, 15) OR isodow(o_orderdate) - 1 IN (0, 3) GROUP BY 1""")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    on = K.dom(d).isin(1, 15) | K.dow(d).isin(0, 3)
    return D.table(spark, sf, "orders").where(on).groupBy(d.alias("date")).agg(F.count("*").alias("n"))


# --- joins on membership ---------------------------------------------------------------------------------

@query("j7_semi_join", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def _(spark, sf):
    members = D.table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'")
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.join(members, orders.o_custkey == members.c_custkey, "left_semi")


@query("j8_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(spark, sf):
    cust, orders = D.table(spark, sf, "customer").select("c_custkey", "c_name"), D.table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return cust.join(orders, cust.c_custkey == orders.o_custkey, "left_anti")
