"""Grid, causal price and feature queries (T2, T4, F, J3-J6, I, M, T5, T7, T8)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..operators import features as X, grid as G
from ..session import scratch_path, settle
from ..streaming import causal as ST
from . import datasets as D
from .datasets import with_sql
from .registry import query


def rounded(df, keys, cols):
    return df.select(*keys, *[r6(c).alias(c) for c in cols])


def sql_cols(cols):
    return ", ".join(f"round({e}, 6) AS {c}" for c, e in cols.items())


KEYS = ["store", "segment_id", "date"]
GRID_COLS = ["R", "on_sale", "sale_depth", "days_in_sale"]


def event_grid(spark, sf):
    return G.causal_grid(D.as_segments(D.event_panel(spark, sf)))


def sparse_grid(spark, sf):
    return G.causal_grid(D.as_segments(D.sparse_panel(spark, sf)))


def long_grid(spark, sf):
    return G.causal_grid(D.as_segments(D.long_panel(spark, sf)))


for _name, _sql, _fn in (("events", D.EVENT_GRID, event_grid), ("sparse", D.SPARSE_GRID, sparse_grid), ("long", D.LONG_GRID, long_grid)):
    @query(f"t2_t4_causal_grid_{_name}", _sql + " SELECT store, segment_id, date, shelf_price, observed, R, on_sale, round(sale_depth, 6) AS sale_depth, days_in_sale FROM grid")
    def _(spark, sf, build=_fn):
        return build(spark, sf).select(*KEYS, "shelf_price", "observed", "R", "on_sale", r6("sale_depth").alias("sale_depth"), "days_in_sale")


@query("t4_stream_causal_grid", D.LONG_GRID + " SELECT store, segment_id, date, shelf_price, observed, R, on_sale, round(sale_depth, 6) AS sale_depth, days_in_sale FROM grid")
def _(spark, sf):
    """The panel arrives as files, a year each, and is streamed; days after the last one of the data are left out."""
    obs = settle(D.as_segments(D.long_panel(spark, sf)), "observed")
    arriving, out, state = (scratch_path(spark, x) for x in ("arriving", "streamed", "state"))
    years = [r[0] for r in obs.select(F.year("date")).distinct().orderBy(F.year("date")).collect()]      # calendar years
    for y in years:
        obs.where(F.year("date") == y).coalesce(1).write.mode("append").parquet(arriving)
    ST.clock(obs, KEYS[:2]).coalesce(1).write.mode("append").parquet(arriving)
    files = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    ST.run_to_end(ST.causal_stream(files), out, state)
    last = obs.agg(F.max("date")).first()[0]
    got = spark.read.parquet(out).where(F.col("date") <= F.lit(last))
    return got.select(*KEYS, "shelf_price", "observed", "R", "on_sale", r6("sale_depth").alias("sale_depth"), "days_in_sale")


# --- per-segment features on the long panel -----------------------------------------------------------------
W = "WINDOW w AS (PARTITION BY store, segment_id ORDER BY date)"


def frame(a, b):
    return f"(PARTITION BY store, segment_id ORDER BY date ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"


LAGS = {"base_price": "lag(R) OVER w", **{f"price_lag_{k}": f"lag(R, {k}) OVER w" for k in (1, 7, 15, 30)}}


def _guarded(n, need, fn):
    return f"CASE WHEN count(R) OVER {frame(n, 1)} >= {need} THEN {fn}(R) OVER {frame(n, 1)} END"


ROLL = {"price_7d_mean": _guarded(7, 4, "avg"), "price_7d_std": _guarded(7, 4, "stddev_samp"),
        "price_30d_mean": _guarded(30, 15, "avg"), "price_momentum_7d": "lag(R) OVER w / lag(R, 8) OVER w - 1",
        "ratio_lag1_mean30": f"lag(R) OVER w / ({_guarded(30, 15, 'avg')}) - 1"}
CHG_CTE = f""",
chg AS (SELECT *, CASE WHEN abs(R / prev_r - 1) > 0.005 THEN 1.0 WHEN R / prev_r IS NOT NULL THEN 0.0 END::DOUBLE AS reg_change,
   row_number() OVER w AS n FROM (SELECT *, lag(R) OVER w AS prev_r FROM grid {W}) {W}),
chg2 AS (SELECT *, coalesce(reg_change, 0) AS hit, CASE WHEN reg_change = 1 THEN R / prev_r - 1 END AS size FROM chg)"""
CHG = {"reg_change": "reg_change", "n_changes_30d": f"sum(hit) OVER {frame(30, 1)}", "n_changes_60d": f"sum(hit) OVER {frame(60, 1)}",
       "last_change_size": f"last_value(size IGNORE NULLS) OVER {frame('UNBOUNDED', 1)}",
       "days_since_change": f"CASE WHEN n > 1 THEN n - 1 - coalesce(max(CASE WHEN hit = 1 THEN n END) OVER {frame('UNBOUNDED', 1)}, 1) END::DOUBLE"}
SALE = {"shelf_price_lag1": f"last_value(shelf_price IGNORE NULLS) OVER {frame(4, 1)}",
        "shelf_to_base_lag1": f"last_value(shelf_price IGNORE NULLS) OVER {frame(4, 1)} / lag(R) OVER w - 1",
        "on_sale_lag1": "lag(on_sale) OVER w", "sale_depth_lag1": "lag(sale_depth) OVER w",
        "days_in_sale_lag1": "lag(days_in_sale) OVER w", "n_sale_days_60d": f"sum(on_sale) OVER {frame(60, 1)}"}


@query("f1_lags", D.LONG_GRID + f" SELECT store, segment_id, date, {sql_cols(LAGS)} FROM grid {W}")
def _(spark, sf):
    return rounded(X.with_lags(long_grid(spark, sf)), KEYS, LAGS)


@query("f2_f3_rolling", D.LONG_GRID + f" SELECT store, segment_id, date, {sql_cols(ROLL)} FROM grid {W}")
def _(spark, sf):
    return rounded(X.with_rolling(long_grid(spark, sf)), KEYS, ROLL)


@query("f4_f5_f6_f7_changes", D.LONG_GRID + CHG_CTE + f" SELECT store, segment_id, date, {sql_cols(CHG)} FROM chg2 {W}")
def _(spark, sf):
    return rounded(X.with_changes(long_grid(spark, sf)), KEYS, CHG)


@query("f8_f9_sale_state", D.LONG_GRID + f" SELECT store, segment_id, date, {sql_cols(SALE)} FROM grid {W}")
def _(spark, sf):
    return rounded(X.with_sale_state(long_grid(spark, sf)), KEYS, SALE)


@query("f23_row_features", with_sql(D.SPARSE_PANEL) + """
SELECT store, name, date, lag(price) OVER w AS price_lag_1, lag(price, 7) OVER w AS price_lag_7, lag(price, 14) OVER w AS price_lag_14,
 round(CASE WHEN count(price) OVER a = 7 THEN avg(price) OVER a END, 6) AS price_mean_7, round(CASE WHEN count(price) OVER b = 14 THEN avg(price) OVER b END, 6) AS price_mean_14,
 round(CASE WHEN count(price) OVER a = 7 THEN stddev_samp(price) OVER a END, 4) AS price_std_7 FROM panel
WINDOW w AS (PARTITION BY store, name ORDER BY date), a AS (PARTITION BY store, name ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
 b AS (PARTITION BY store, name ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    df = X.with_row_features(D.sparse_panel(spark, sf), ["store", "name"])
    return df.drop("price").withColumn("price_mean_7", r6("price_mean_7")).withColumn("price_mean_14", r6("price_mean_14")).withColumn(
        "price_std_7", r6("price_std_7", 4))


# --- segments: packs switch over time, some days state no pack ------------------------------------------------
def pack_text():
    line = F.col("name")
    size = (F.when(line.isin("1", "3"), F.when(F.year("date") < 1998, " 500 Gr").otherwise(" 450 Gr"))
            .when(line.isin("2", "4"), " 2 x 250 Ml").when(line == "5", " 1,5 Lt").when(line == "6", " 6 Adet").otherwise(""))
    return F.concat(F.lit("urun no"), F.when(F.dayofmonth("date") == 13, F.lit("")).otherwise(size))


def coicop():
    return (F.when(F.col("name").isin("1", "2"), "01").when(F.col("name").isin("3", "4"), "05").when(F.col("name") == "5", "09")
            .when(F.col("name") == "6", "13").otherwise("unknown"))


def regular_and_shelf(spark, sf, panel=None):
    from ..functions import text as T
    from ..operators import sales as S
    panel = D.long_panel(spark, sf) if panel is None else panel
    named = S.flag_sales(panel).where("not is_sale").withColumn("text", pack_text())
    packs = named.select("text").distinct().withColumn("pack", T.parse_pack("text", compose=False))  # once per distinct name
    regular = named.join(packs, "text").select(
        "store", F.col("name").alias("series_id"), "date", "price", F.col("unresolved").alias("sale_unresolved"),
        "pack", coicop().alias("coicop"), T.unit_basis("pack").alias("unit_basis"))
    shelf = panel.select("store", F.col("name").alias("series_id"), "date", F.col("price").alias("shelf_price"))
    return regular, shelf


SEGMENTS = with_sql(D.LONG_PANEL, D.sale_flags_sql(), """
packed AS (SELECT store, name AS series_id, date, price, unresolved AS sale_unresolved,
  CASE WHEN day(date) = 13 THEN NULL WHEN name IN ('1', '3') THEN CASE WHEN year(date) < 1998 THEN '1x500g' ELSE '1x450g' END
       WHEN name IN ('2', '4') THEN '2x250ml' WHEN name = '5' THEN '1x1500ml' WHEN name = '6' THEN '6pc' END AS pack_key,
  CASE WHEN name IN ('1', '2') THEN '01' WHEN name IN ('3', '4') THEN '05' WHEN name = '5' THEN '09' WHEN name = '6' THEN '13' ELSE 'unknown' END AS coicop
  FROM flagged WHERE NOT is_sale),
basis AS (SELECT *, CASE WHEN pack_key LIKE '%ml' THEN 'TRY/l' WHEN pack_key LIKE '%g' THEN 'TRY/kg' WHEN pack_key LIKE '%pc' THEN 'TRY/piece' ELSE 'none' END AS unit_basis,
  CASE pack_key WHEN '1x500g' THEN 1000 / 500.0::DOUBLE WHEN '1x450g' THEN 1000 / 450.0::DOUBLE WHEN '2x250ml' THEN 1000 / 500.0::DOUBLE WHEN '1x1500ml' THEN 1000 / 1500.0::DOUBLE WHEN '6pc' THEN 1 / 6.0::DOUBLE END AS unit_factor FROM packed),
held AS (SELECT *, coalesce(last_value(pack_key IGNORE NULLS) OVER (PARTITION BY store, series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(pack_key IGNORE NULLS) OVER (PARTITION BY store, series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), '') AS held FROM basis),
sw AS (SELECT *, coalesce(held <> lag(held) OVER (PARTITION BY store, series_id ORDER BY date), false) AS sw FROM held),
seg AS (SELECT *, CAST(sum(CAST(sw AS INT)) OVER (PARTITION BY store, series_id ORDER BY date) + 1 AS INT) AS pack_segment FROM sw),
asofed AS (SELECT p.store, p.name AS series_id, p.date, p.price AS shelf_price, s.pack_segment AS ps, s.unit_factor
  FROM panel p ASOF LEFT JOIN seg s ON p.store = s.store AND p.name = s.series_id AND p.date >= s.date),
filled AS (SELECT * EXCLUDE (ps), coalesce(first_value(ps IGNORE NULLS) OVER (PARTITION BY store, series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS pack_segment FROM asofed),
static AS (SELECT store, series_id, pack_segment, arg_min(coicop, date) AS coicop, arg_min(unit_basis, date) AS unit_basis FROM seg GROUP BY ALL),
obs AS (SELECT store, series_id, date, f.shelf_price, pack_segment, f.unit_factor, g.price AS regular_price, g.sale_unresolved, st.coicop, st.unit_basis,
  series_id || '#' || pack_segment AS segment_id FROM filled f LEFT JOIN (SELECT store, series_id, date, price, sale_unresolved FROM seg) g USING (store, series_id, date) LEFT JOIN static st USING (store, series_id, pack_segment))""")


@query("f13_pack_segments", SEGMENTS + " SELECT store, series_id, date, pack_key, pack_segment FROM seg")
def _(spark, sf):
    from ..functions import text as T
    regular, _ = regular_and_shelf(spark, sf)
    return G.pack_segments(regular.withColumn("pack_key", T.pack_key("pack"))).select("store", "series_id", "date", "pack_key", "pack_segment")


@query("t5_j1_j3_segment_build", SEGMENTS + """ SELECT store, series_id, date, shelf_price, pack_segment, round(unit_factor, 6) AS unit_factor,
 regular_price, sale_unresolved, coicop, unit_basis, segment_id FROM obs""")
def _(spark, sf):
    return G.build_segments(*regular_and_shelf(spark, sf)).withColumn("unit_factor", r6("unit_factor"))


def _unit_prices(spark, sf):
    regular, _ = regular_and_shelf(spark, sf)
    return regular


@query("f21_unit_returns_and_switches", SEGMENTS + """
, u AS (SELECT *, price * unit_factor AS unit_price FROM basis),
l AS (SELECT store, series_id, date, ln(price) - ln(lag(price) OVER s) AS ret_price, ln(unit_price) - ln(lag(unit_price) OVER s) AS ret_unit,
  pack_key, lag(pack_key) OVER s AS prev_key FROM u WINDOW s AS (PARTITION BY store, series_id ORDER BY date))
SELECT store, series_id, date, round(ret_price, 6) AS ret_price, round(ret_unit, 6) AS ret_unit, pack_key, prev_key,
 coalesce(pack_key <> prev_key, false) AS switched FROM l""")
def _(spark, sf):
    from ..operators.segments import unit_returns
    out = unit_returns(_unit_prices(spark, sf))
    return out.withColumn("ret_price", r6("ret_price")).withColumn("ret_unit", r6("ret_unit")).select(
        "store", "series_id", "date", "ret_price", "ret_unit", "pack_key", "prev_key", "switched")


@query("f21_shrinkflation_days", SEGMENTS + """
, l AS (SELECT store, series_id, ln(price) - ln(lag(price) OVER s) AS rp, ln(price * unit_factor) - ln(lag(price * unit_factor) OVER s) AS ru
  FROM basis WINDOW s AS (PARTITION BY store, series_id ORDER BY date)),
k AS (SELECT store, series_id, count(DISTINCT pack_key) AS k FROM basis GROUP BY ALL)
SELECT count(DISTINCT (store, series_id)) FILTER (k > 1) AS changing_series,
 count(*) FILTER (k <= 1 AND abs(rp - ru) > 1e-9) AS broken_rows,
 count(*) FILTER (k > 1 AND abs(rp) < 1e-9 AND abs(ru) > 1e-9) AS flat_price_days FROM l JOIN k USING (store, series_id)""")
def _(spark, sf):
    from ..operators.segments import shrinkflation_summary
    return shrinkflation_summary(_unit_prices(spark, sf))


# --- cross-section, external series, full table -------------------------------------------------------------------
def segment_grid(spark, sf):
    regular, shelf = regular_and_shelf(spark, sf)
    return G.causal_grid(G.build_segments(regular, shelf), data_end=shelf.agg(F.max("date")).scalar())


FULL_GRID = (SEGMENTS.replace("WITH ", "WITH RECURSIVE ", 1) + "," + D.grid_sql(
    ", o.series_id AS sid, o.unit_factor AS uf, o.regular_price AS rp, o.sale_unresolved AS su, o.coicop AS co, o.unit_basis AS ub").replace(
    "grid AS (", "grid_raw AS (") + """,
grid AS (SELECT *, split_part(segment_id, '#', 1) AS series_id, max(co) OVER (PARTITION BY store, segment_id) AS coicop,
  max(ub) OVER (PARTITION BY store, segment_id) AS unit_basis, last_value(uf IGNORE NULLS) OVER r AS unit_factor, coalesce(su, false) AS sale_unresolved,
  observed AND rp IS NULL AS is_sale_day, CASE WHEN observed AND rp IS NULL THEN last_value(rp IGNORE NULLS) OVER r ELSE rp END AS regular_price
  FROM grid_raw WINDOW r AS (PARTITION BY store, segment_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
CROSS = CHG_CTE + f""",
base AS (SELECT *, ln(lag(R) OVER w * lag(unit_factor) OVER w) AS log_unit_price_lag1, ln(R / prev_r) AS m FROM chg2 {W}),
sday AS (SELECT store, date, avg(reg_change) AS s FROM base WHERE observed GROUP BY ALL),
scal AS (SELECT store, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sday GROUP BY store),
sshare AS (SELECT store, date, lag(s) OVER x AS store_reprice_share_1d, avg(s) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS store_reprice_share_7d
  FROM scal LEFT JOIN sday USING (store, date) WINDOW x AS (PARTITION BY store ORDER BY date)),
cday AS (SELECT store, coicop, date, avg(reg_change) AS s FROM base WHERE observed AND coicop IS NOT NULL GROUP BY ALL),
ccal AS (SELECT c.store, c.coicop, s.date FROM (SELECT DISTINCT store, coicop FROM cday) c JOIN scal s USING (store)),
cshare AS (SELECT store, coicop, date, lag(s) OVER x AS cat_reprice_share_1d, avg(s) OVER (PARTITION BY store, coicop ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS cat_reprice_share_7d
  FROM ccal LEFT JOIN cday USING (store, coicop, date) WINDOW x AS (PARTITION BY store, coicop ORDER BY date)),
med AS (SELECT store, coicop, unit_basis, date, median(log_unit_price_lag1) AS med FROM base GROUP BY ALL),
wcal AS (SELECT store, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM base GROUP BY store),
wday AS (SELECT store, coicop, date, avg(CASE WHEN observed THEN m END) AS m FROM base GROUP BY ALL),
wcat AS (SELECT store, coicop, date, sum(coalesce(m, 0)) OVER (PARTITION BY store, coicop ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS web_cat_infl_30d
  FROM (SELECT DISTINCT store, coicop FROM wday) JOIN wcal USING (store) LEFT JOIN wday USING (store, coicop, date)),
wt AS (SELECT * FROM (VALUES ('01', 24.44::DOUBLE), ('05', 7.92::DOUBLE), ('09', 4.34::DOUBLE), ('13', 4.49::DOUBLE)) t(coicop, wt)),
wstore AS (SELECT store, date, sum(web_cat_infl_30d * coalesce(wt, 0)) / sum(CASE WHEN web_cat_infl_30d IS NOT NULL THEN coalesce(wt, 0) END) AS web_store_infl_30d
  FROM wcat LEFT JOIN wt USING (coicop) GROUP BY ALL),
crossed AS (SELECT b.*, store_reprice_share_1d, store_reprice_share_7d, cat_reprice_share_1d, cat_reprice_share_7d,
  log_unit_price_lag1 - med AS rel_unit_price_lag1, web_cat_infl_30d, web_store_infl_30d
  FROM base b LEFT JOIN sshare USING (store, date) LEFT JOIN cshare USING (store, coicop, date) LEFT JOIN med USING (store, coicop, unit_basis, date)
  LEFT JOIN wcat USING (store, coicop, date) LEFT JOIN wstore USING (store, date))"""
CROSS_COLS = {c: c for c in ("log_unit_price_lag1", "rel_unit_price_lag1", "store_reprice_share_1d", "store_reprice_share_7d",
                             "cat_reprice_share_1d", "cat_reprice_share_7d", "web_cat_infl_30d", "web_store_infl_30d")}


@query("f10_f11_f12_e16_e17_cross_section", FULL_GRID + CROSS + f" SELECT store, segment_id, date, {sql_cols(CROSS_COLS)} FROM crossed")
def _(spark, sf):
    grid = settle(X.with_unit_price(X.with_changes(segment_grid(spark, sf))), "grid")
    return rounded(X.with_cross_section(grid), KEYS, CROSS_COLS)


@query("e16_repricing_shares", FULL_GRID + CHG_CTE + """
SELECT store, coicop, date, round(avg(reg_change), 6) AS share FROM chg2 WHERE observed GROUP BY ALL""")
def _(spark, sf):
    grid = X.with_changes(segment_grid(spark, sf))
    return grid.where("observed").groupBy("store", "coicop", "date").agg(r6(F.avg("reg_change")).alias("share"))


def external(spark, sf):
    """Trading-day series and monthly releases derived from orders."""
    orders = D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderstatus")
    work = orders.where(F.weekday("date") < 5)
    usd = work.groupBy("date").agg((F.avg("o_totalprice") / 10000).alias("usd_try"))
    brent = work.where("o_orderstatus = 'F'").groupBy("date").agg((F.avg("o_totalprice") / 2500).alias("brent_usd"))
    months = orders.groupBy(F.trunc("date", "month").alias("m")).agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    from pyspark.sql import Window
    w = Window.orderBy("m")
    tuik = months.select(
        F.date_format("m", "yyyy-MM").alias("month"), (100 * (F.col("s") / F.lag("s").over(w) - 1)).alias("food_mom_pct"),
        F.when(F.month("m") != 5, 100 * (F.col("n") / F.lag("n").over(w) - 1)).alias("headline_mom_pct"),
        F.date_add(F.add_months("m", 1), 2).alias("release_date"))
    return usd, brent, tuik


EXT = """
ord AS (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice, o_orderstatus FROM orders),
usd AS (SELECT date, avg(o_totalprice) / 10000 AS usd_try FROM ord WHERE isodow(date) < 6 GROUP BY date),
brent AS (SELECT date, avg(o_totalprice) / 2500 AS brent_usd FROM ord WHERE isodow(date) < 6 AND o_orderstatus = 'F' GROUP BY date),
mon AS (SELECT date_trunc('month', date)::DATE AS m, sum(o_totalprice) AS s, count(*) AS n FROM ord GROUP BY 1),
tuik AS (SELECT m, 100 * (s / lag(s) OVER (ORDER BY m) - 1) AS food, CASE WHEN month(m) <> 5 THEN 100 * (n / lag(n) OVER (ORDER BY m)::DOUBLE - 1) END AS headline,
  CAST(m + INTERVAL 1 MONTH + INTERVAL 2 DAY AS DATE) AS rel FROM mon),
tuik3 AS (SELECT *, CASE WHEN count(food) OVER t = count(*) OVER t THEN (product(1 + food / 100) OVER t - 1) * 100 END AS food3 FROM tuik
  WINDOW t AS (ORDER BY rel ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
oil AS (SELECT date, brent_usd * usd_try AS v FROM brent JOIN usd USING (date)),
stp AS (SELECT date, usd_try / lag(usd_try) OVER (ORDER BY date) - 1 AS v FROM usd),
dts AS (SELECT DISTINCT date FROM {days}),
ext AS (SELECT d.date, u0.usd_try AS usd_try_rate, s0.v AS usd_try_rate_change, u0.usd_try / u7.usd_try - 1 AS usd_try_change_7d,
  u0.usd_try / u30.usd_try - 1 AS usd_try_change_30d, b0.v AS brent_try, b0.v / b7.v - 1 AS brent_try_change_7d, b0.v / b30.v - 1 AS brent_try_change_30d,
  t.food AS tuik_food_mom_last, t.headline AS tuik_headline_mom_last, t.food3 AS tuik_food_3m_cum, CAST(d.date - t.rel AS INT) AS days_since_tuik_release
  FROM dts d ASOF LEFT JOIN usd u0 ON d.date - 1 >= u0.date ASOF LEFT JOIN usd u7 ON d.date - 8 >= u7.date ASOF LEFT JOIN usd u30 ON d.date - 31 >= u30.date
  ASOF LEFT JOIN (SELECT * FROM stp WHERE v IS NOT NULL) s0 ON d.date - 1 >= s0.date
  ASOF LEFT JOIN oil b0 ON d.date - 1 >= b0.date ASOF LEFT JOIN oil b7 ON d.date - 8 >= b7.date ASOF LEFT JOIN oil b30 ON d.date - 31 >= b30.date
  ASOF LEFT JOIN tuik3 t ON d.date - 1 >= t.rel)"""
EXT_COLS = {c: c for c in ("usd_try_rate", "usd_try_rate_change", "usd_try_change_7d", "usd_try_change_30d", "brent_try", "brent_try_change_7d",
                           "brent_try_change_30d", "tuik_food_mom_last", "tuik_headline_mom_last", "tuik_food_3m_cum")}
DAYS = "(SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem)"


@query("j4_j5_m3_m4_external", with_sql(EXT.replace("{days}", DAYS)) + f" SELECT date, {sql_cols(EXT_COLS)}, days_since_tuik_release FROM ext")
def _(spark, sf):
    days = D.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    out = X.external_table(days, *external(spark, sf))
    return rounded(out, ["date", "days_since_tuik_release"], EXT_COLS)


@query("j2_inner_join_product", with_sql(EXT.replace("{days}", DAYS)) + " SELECT date, round(v, 4) AS brent_try FROM oil")
def _(spark, sf):
    usd, brent, _ = external(spark, sf)
    return X.priced_in(brent, usd, "brent_usd", "usd_try", "brent_try").withColumn("brent_try", r6("brent_try", 4))


@query("m4_compounded_releases", with_sql(EXT.replace("{days}", DAYS)) + " SELECT rel AS release_date, round(food3, 6) AS food_3m FROM tuik3")
def _(spark, sf):
    return X.compounded(external(spark, sf)[2], "food_mom_pct", "food_3m").select("release_date", r6("food_3m").alias("food_3m"))


@query("j3_asof_backward", """WITH a AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS price FROM orders GROUP BY ALL),
 b AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS date, max(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) AS urgent FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT a.k, a.date, a.price, b.urgent FROM a ASOF LEFT JOIN b ON a.k = b.k AND a.date >= b.date""")
def _(spark, sf):
    o = D.table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate")).withColumn("k", F.col("o_custkey"))
    a = o.groupBy("k", "date").agg(F.max("o_totalprice").alias("price"))
    b = o.where("o_orderstatus = 'F'").groupBy("k", "date").agg(
        F.max(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))).alias("urgent"))
    return G.asof_backward(a, b, ["k"], ["urgent"])


@query("j11_next_observation", """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(l_shipdate AS DATE) AS date, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
 p AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_linenumber, max(CAST(l_shipdate AS DATE)) - 200 AS last_date FROM lineitem GROUP BY ALL)
SELECT p.series_id, l_linenumber, last_date, (SELECT min(date) FROM c WHERE c.series_id = p.series_id AND c.date > p.last_date) AS next_date,
 (SELECT arg_min(price, date) FROM c WHERE c.series_id = p.series_id AND c.date > p.last_date) AS next_price FROM p""")
def _(spark, sf):
    li = D.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("series_id"), "l_linenumber",
                                               F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"))
    probe = li.groupBy("series_id", "l_linenumber").agg(F.date_sub(F.max("date"), 200).alias("last_date"))
    return G.next_observation(probe, li, ["series_id"], "last_date").select("series_id", "l_linenumber", "last_date", "next_date", "next_price")


# --- calendar ---------------------------------------------------------------------------------------------------
HOLIDAYS = ("1997-05-19", "1998-04-23", "1999-10-29", "2000-01-01")
HOL = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)
FLAGS = {"is_1st": "CAST(day(date) = 1 AS INT)", "is_15th": "CAST(day(date) = 15 AS INT)", "is_16th": "CAST(day(date) = 16 AS INT)",
         "is_month_end": "CAST(date = last_day(date) AS INT)", "days_to_month_end": "CAST(last_day(date) - date AS INT)",
         "is_holiday": f"CAST(date IN ({HOL}) AS INT)", "is_target_spec": f"day(date) IN (1, 15) OR date = last_day(date) OR date IN ({HOL})",
         "is_target_data": f"day(date) IN (1, 14, 15, 16) OR date IN ({HOL})"}
CYCLIC = {"dow_sin": "sin(2 * pi() * (isodow(date) - 1) / 7)", "dow_cos": "cos(2 * pi() * (isodow(date) - 1) / 7)",
          "month_sin": "sin(2 * pi() * month(date) / 12)", "month_cos": "cos(2 * pi() * month(date) / 12)",
          "dom_sin": "sin(2 * pi() * day(date) / 31)", "dom_cos": "cos(2 * pi() * day(date) / 31)"}


@query("i1_i2_i3_calendar", f"SELECT date, {sql_cols(CYCLIC)}, " + ", ".join(f"{e} AS {c}" for c, e in FLAGS.items()) + f" FROM (SELECT DISTINCT date FROM {DAYS})")
def _(spark, sf):
    days = D.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return rounded(X.with_calendar(days, HOLIDAYS), ["date", *FLAGS], CYCLIC)


@query("i4_i6_date_parts", """SELECT date, CAST(isodow(date) - 1 AS INT) AS day_of_week, dayname(date) AS day_name, CAST(day(date) AS INT) AS day_of_month, CAST(week(date) AS INT) AS week_of_year,
 CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, CAST(isodow(date) > 5 AS INT) AS is_weekend, strftime(date, '%Y-%m') AS month_text, strftime(date, '%Y-%m-%d') AS iso,
 round(sin(2 * pi() * (month(date) - 1) / 12), 6) AS month0_sin FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)""")
def _(spark, sf):
    from ..functions import calendar as K
    days = D.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    zero = r6(K.wave(F.month("date") - 1, 12)[0])
    return K.with_date_parts(days).withColumns({"month_text": K.month_text("date"), "iso": K.iso_text("date"), "month0_sin": zero})


@query("i5_effective_gap", """WITH s AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date FROM lineitem GROUP BY ALL), p AS (SELECT *, lag(date) OVER (PARTITION BY l_suppkey ORDER BY date) AS prev FROM s)
SELECT l_suppkey, date, CAST(date - prev - greatest(0, least(date - 1, DATE '1998-02-20') - greatest(prev + 1, DATE '1998-02-01') + 1) AS INT) AS gap FROM p WHERE prev IS NOT NULL""")
def _(spark, sf):
    from pyspark.sql import Window
    from ..functions import calendar as K
    s = D.table(spark, sf, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("date")).distinct()
    s = s.withColumn("prev", F.lag("date").over(Window.partitionBy("l_suppkey").orderBy("date"))).where("prev is not null")
    return s.select("l_suppkey", "date", K.effective_gap("prev", "date", ("1998-02-01", "1998-02-20")).alias("gap"))


@query("m1_m2_directions", """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN abs(l_discount - l_tax) > 0.005 THEN sign(l_discount - l_tax) ELSE 0 END AS INT) AS direction,
 round(ln(l_extendedprice / l_quantity), 6) AS log_ratio, greatest(least(l_discount * 20 - 1, 0.8), -0.8) AS clipped FROM lineitem""")
def _(spark, sf):
    from ..functions import prices as P
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", P.direction(F.col("l_discount") - F.col("l_tax")).alias("direction"),
        r6(P.log_change("l_extendedprice", "l_quantity")).alias("log_ratio"), P.clip(F.col("l_discount") * 20 - 1).alias("clipped"))


# --- full feature table ---------------------------------------------------------------------------------------------
FEATURE_OUTAGE = ("1998-02-01", "1998-02-20")
ALL_NUM = {**LAGS, **ROLL, **{k: v for k, v in CHG.items() if k != "reg_change"}, **SALE, **CROSS_COLS, **EXT_COLS, **CYCLIC}
FULL = FULL_GRID + CROSS + "," + EXT.replace("{days}", "grid") + f""",
feat AS (SELECT store, segment_id, series_id, date, observed, is_sale_day, shelf_price, regular_price AS target_price, sale_unresolved, coicop, unit_basis,
  date BETWEEN DATE '{FEATURE_OUTAGE[0]}' AND DATE '{FEATURE_OUTAGE[1]}' AS in_outage,
  {", ".join(f"{e} AS {k}" for k, e in {**LAGS, **ROLL, **{k: v for k, v in CHG.items() if k != 'reg_change'}, **SALE}.items())},
  {", ".join(CROSS_COLS)}, {", ".join(EXT_COLS)}, days_since_tuik_release,
  {", ".join(f"{e} AS {k}" for k, e in {**CYCLIC, **FLAGS}.items())}
  FROM (SELECT crossed.*, ext.* EXCLUDE (date) FROM crossed LEFT JOIN ext ON ext.date = crossed.date) WINDOW w AS (PARTITION BY store, segment_id ORDER BY date)),
features AS (SELECT *, target_price / base_price - 1 AS target_pct_change,
  observed AND target_price IS NOT NULL AND base_price IS NOT NULL AND NOT sale_unresolved AND NOT in_outage AS usable_target FROM feat)"""


def feature_table(spark, sf):
    regular, shelf = regular_and_shelf(spark, sf)
    return X.build_features(regular, shelf, *external(spark, sf), outage=FEATURE_OUTAGE, holidays=HOLIDAYS)


@query("t7_b8_b15_feature_table", FULL + f""" SELECT store, segment_id, series_id, date, observed, usable_target, is_sale_day, in_outage, is_target_spec, is_target_data,
 shelf_price, target_price, round(target_pct_change, 6) AS target_pct_change, coicop, unit_basis, days_since_tuik_release,
 {", ".join(k for k in FLAGS if not k.startswith("is_target"))}, {", ".join(f"round({k}, 6) AS {k}" for k in ALL_NUM)} FROM features""")
def _(spark, sf):
    df = X.select_features(feature_table(spark, sf))
    plain = [c for c in df.columns if c not in ALL_NUM and c != "target_pct_change"]
    return df.select(*plain, *[r6(c).alias(c) for c in ("target_pct_change", *ALL_NUM)])
