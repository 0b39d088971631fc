"""Evaluation queries (H, F24-F25, J12, L12) on deterministic stand-in forecasts."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..common import r6
from ..functions import calendar as K, prices as P
from ..operators import evaluation as E
from .. import fixed_values as V
from . import datasets as D
from .datasets import with_sql
from .registry import query
from .rule_queries import rounded

KEYS = ["store", "segment_id"]


def frame(spark, sf):
    """Row-based forecasts on the long panel: yesterday's price, and a seven-row mean as the model."""
    w = Window.partitionBy(*KEYS).orderBy("date")
    df = D.as_segments(D.long_panel(spark, sf)).withColumnRenamed("shelf_price", "target_price")
    df = (df.withColumn("base_price", F.lag("target_price").over(w)).withColumn("pred_price", F.avg("target_price").over(w.rowsBetween(-7, -1)))
          .withColumn("shelf_price_lag1", F.when(F.col("segment_id") != "3", F.lag("target_price", 2).over(w))).where("base_price is not null"))
    return (df.withColumn("block", F.when(F.year("date") <= 1997, "B1").otherwise("B2"))
            .withColumn("is_target_spec", K.is_target_spec("date", ())).withColumn("is_target_data", K.is_target_data("date", ()))
            .withColumn("target_pct_change", F.col("target_price") / F.col("base_price") - 1)
            .withColumn("prob", (F.dayofmonth("date") * 7 % 31) / F.lit(31.0)).withColumn("size", F.col("pred_price") / F.col("base_price") - 1)
            .withColumn("observed", F.dayofmonth("date") != 9)
            .withColumn("split", F.when(F.month("date") % 2 == 0, "valid").otherwise("test")))


FRAME = with_sql(D.LONG_PANEL) + """
, f0 AS (SELECT store, name AS segment_id, date, price AS target_price, lag(price) OVER w AS base_price, avg(price) OVER (PARTITION BY store, name ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pred_price,
   CASE WHEN name <> '3' THEN lag(price, 2) OVER w END AS shelf_price_lag1 FROM panel WINDOW w AS (PARTITION BY store, name ORDER BY date)),
f AS (SELECT *, CASE WHEN year(date) <= 1997 THEN 'B1' ELSE 'B2' END AS block, day(date) IN (1, 15) OR date = last_day(date) AS is_target_spec, day(date) IN (1, 14, 15, 16) AS is_target_data,
   target_price / base_price - 1 AS tp, (day(date) * 7 % 31) / 31.0::DOUBLE AS prob, pred_price / base_price - 1 AS size, day(date) <> 9 AS observed, CASE WHEN month(date) % 2 = 0 THEN 'valid' ELSE 'test' END AS split
   FROM f0 WHERE base_price IS NOT NULL)"""


def _dir(x):
    return f"CASE WHEN abs({x}) > 0.005 THEN sign({x}) ELSE 0 END"


def _metrics(p, y="target_price", b="base_price"):
    return f"""count(*) AS rows, avg(abs({p} - {y})) AS mae, sqrt(avg(({p} - {y}) ** 2)) AS rmse, 100 * avg(abs({p} - {y}) / {y}) AS mape_pct,
 1 - sum(({p} - {y}) ** 2) / (var_pop({y}) * count(*)) AS r2_price, 1 - sum(({y} / {b} - {p} / {b}) ** 2) / (var_pop({y} / {b} - 1) * count(*)) AS r2_return,
 100 * avg(CAST({_dir(f'({y} / {b} - 1)')} = {_dir(f'({p} / {b} - 1)')} AS INT)) AS da_pct"""


NUM = ["mae", "rmse", "mape_pct", "r2_price", "r2_return", "da_pct"]
ROUND = ", ".join(f"round({c}, {3 if c in ('mae', 'rmse') else 6}) AS {c}" for c in NUM)


def metric_round(df):
    return df.select(*[r6(c, 3 if c in ("mae", "rmse") else 6).alias(c) if c in NUM else F.col(c) for c in df.columns])


def results(spark, sf):
    base = E.with_baselines(frame(spark, sf))
    pick = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("p")) for m, c in (
        ("persistence_causal_regular", "persistence_causal_regular"), ("persistence_shelf", "persistence_shelf"), ("rolling_mean", "pred_price"))]))
    long = base.withColumn("_m", pick).withColumn("model", F.col("_m.m")).withColumn("pred_price", F.col("_m.p"))
    return E.evaluate(long)


EVAL = FRAME + f"""
, mo AS (SELECT *, unnest([{{'m': 'persistence_causal_regular', 'p': base_price}}, {{'m': 'persistence_shelf', 'p': coalesce(shelf_price_lag1, base_price)}}, {{'m': 'rolling_mean', 'p': pred_price}}]) AS mm FROM f),
su AS (SELECT *, mm.m AS model, unnest([{{'s': 'spec target days', 'p': CASE WHEN is_target_spec THEN mm.p END}}, {{'s': 'global (model on spec days)', 'p': CASE WHEN is_target_spec THEN mm.p ELSE base_price END}},
  {{'s': 'data target days', 'p': CASE WHEN is_target_data THEN mm.p END}}, {{'s': 'global (model on data days)', 'p': CASE WHEN is_target_data THEN mm.p ELSE base_price END}}, {{'s': 'all days (model everywhere)', 'p': mm.p}}]) AS ss FROM mo),
ev AS (SELECT block, model, ss.s AS subset, {_metrics('ss.p')} FROM su WHERE ss.p IS NOT NULL GROUP BY ALL)"""
IMPR = EVAL + """
, rf AS (SELECT block, subset, max(mae) FILTER (model = 'persistence_causal_regular') AS pc, max(mae) FILTER (model = 'persistence_shelf') AS ps FROM ev GROUP BY ALL),
im AS (SELECT ev.*, 100 * (pc - mae) / pc AS impr_vs_causal_regular_pct, 100 * (ps - mae) / ps AS impr_vs_shelf_pct, least(pc, ps) AS best_baseline_mae,
 100 * (least(pc, ps) - mae) / least(pc, ps) AS impr_vs_best_pct, mae > least(pc, ps) + 1e-12 AS worse_than_best_baseline FROM ev JOIN rf USING (block, subset))"""


@query("h1_baselines", FRAME + " SELECT store, segment_id, date, base_price AS persistence_causal_regular, coalesce(shelf_price_lag1, base_price) AS persistence_shelf FROM f")
def _(spark, sf):
    return E.with_baselines(frame(spark, sf)).select(*KEYS, "date", "persistence_causal_regular", "persistence_shelf")


@query("h6_target_day_mae", FRAME + """ SELECT block, round(coalesce(avg(CASE WHEN is_target_spec OR is_target_data THEN abs(base_price * (1 + greatest(least(size, 0.8), -0.8)) - target_price) END),
 avg(abs(base_price * (1 + greatest(least(size, 0.8), -0.8)) - target_price))), 3) AS target_day_mae FROM f GROUP BY block""")
def _(spark, sf):
    return E.target_day_mae(frame(spark, sf), ["block"], "size").withColumn("target_day_mae", r6("target_day_mae", 3))


@query("h7_price_metrics", FRAME + f" SELECT block, rows, {ROUND} FROM (SELECT block, {_metrics('pred_price')} FROM f GROUP BY block)")
def _(spark, sf):
    return metric_round(E.price_metrics(frame(spark, sf), ["block"]))


@query("h8_h9_subset_evaluation", EVAL + f" SELECT block, model, subset, rows, {ROUND} FROM ev")
def _(spark, sf):
    return metric_round(results(spark, sf))


_H25 = {f"{who}_{m}": (model, m) for m in ("mae", "rmse") for who, model in (("dummy", "persistence_causal_regular"), ("model", "rolling_mean"))}


@query("h25_block_summary", EVAL + " SELECT block, max(rows) FILTER (model = 'persistence_causal_regular' AND subset = 'data target days') AS data_rows, " + ", ".join(
    f"round(max({m}) FILTER (model = '{model}' AND subset = 'data target days'), 4) AS {name}" for name, (model, m) in _H25.items()) + ", " + ", ".join(
    f"round(max(mae) FILTER (model = '{_H25[who + '_mae'][0]}' AND subset = 'global (model on data days)'), 4) AS system_{who}_mae" for who in ("dummy", "model")) + " FROM ev GROUP BY block")
def _(spark, sf):
    out = E.block_summary(results(spark, sf), "rolling_mean")
    return out.select(*[r6(c, 4).alias(c) if c.endswith(("mae", "rmse")) else F.col(c) for c in out.columns])


IM = ["impr_vs_causal_regular_pct", "impr_vs_shelf_pct", "impr_vs_best_pct"]


@query("h10_improvement", IMPR + f" SELECT block, model, subset, {', '.join(f'round({c}, 6) AS {c}' for c in IM)}, round(best_baseline_mae, 3) AS best_baseline_mae, worse_than_best_baseline FROM im")
def _(spark, sf):
    out = E.add_improvement(results(spark, sf)).select("block", "model", "subset", *IM, r6("best_baseline_mae", 3).alias("best_baseline_mae"), "worse_than_best_baseline")
    return rounded(out, IM)


@query("g7_best_model", IMPR + """ SELECT subset, model, round(impr, 6) AS impr FROM (SELECT subset, model, avg(impr_vs_best_pct) AS impr FROM im GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY subset ORDER BY round(impr, 9) DESC, model) = 1""")
def _(spark, sf):
    return E.best_model(E.add_improvement(results(spark, sf)), E.SUBSETS).withColumn("impr", r6("impr"))


@query("g8_sorted_results", IMPR + " SELECT block, model, round(mae, 3) AS mae FROM im WHERE subset = 'spec target days' ORDER BY block, mae")
def _(spark, sf):
    return results(spark, sf).where("subset = 'spec target days'").orderBy("block", "mae").select("block", "model", r6("mae", 3).alias("mae"))


@query("h12_precision_recall", FRAME + """ SELECT block, count(*) FILTER (s) AS predicted_changes, count(*) FILTER (r) AS true_changes, round(avg(CASE WHEN s THEN CAST(r AS INT) END), 6) AS precision,
 round(avg(CASE WHEN r THEN CAST(s AS INT) END), 6) AS recall FROM (SELECT *, abs(pred_price / base_price - 1) > 0.005 AS s, abs(tp) > 0.005 AS r FROM f) GROUP BY block""")
def _(spark, sf):
    return rounded(E.change_precision_recall(frame(spark, sf), ["block"]), ["precision", "recall"])


CLASSES = FRAME.replace("f AS (", "fb AS (") + """
, fl AS (SELECT *, lag(observed, 1, false) OVER w AS po, lag(target_price) OVER w AS py FROM fb WINDOW w AS (PARTITION BY store, segment_id ORDER BY date)),
fr AS (SELECT *, coalesce(po AND abs(target_price / py - 1) > 0.3, false) AS re, coalesce(po AND abs(base_price / py - 1) <= 0.3, false) AS ag FROM fl),
f AS (SELECT *, CASE WHEN re THEN 'real' WHEN NOT ag AND abs(target_price / base_price - 0.5) < 0.01 AND date >= DATE '1998-01-01' THEN 'label_b3' WHEN NOT ag THEN 'diverge' ELSE 'flat' END AS cls FROM fr)"""


def classed(spark, sf):
    return E.row_classes(frame(spark, sf), half_from="1998-01-01", tol=0.3)


@query("h14_row_classes", CLASSES + " SELECT store, segment_id, date, cls FROM f")
def _(spark, sf):
    return classed(spark, sf).select(*KEYS, "date", "cls")


def _price(a, b):
    return f"base_price * (1 + CASE WHEN prob > (CASE WHEN is_target_data THEN {a} ELSE {b} END) THEN greatest(least(size, 0.8), -0.8) ELSE 0 END)"


@query("h15_b14_threshold_replay", CLASSES + f" SELECT store, segment_id, date, round({_price(0.4, 0.7)}, 4) AS pred, round(abs(base_price - target_price) - abs({_price(0.4, 0.7)} - target_price), 4) AS gain FROM f")
def _(spark, sf):
    p = E.threshold_price(F.col("is_target_data"), F.lit(0.4), F.lit(0.7))
    return frame(spark, sf).select(*KEYS, "date", r6(p, 4).alias("pred"), r6(E.gain(p), 4).alias("gain"))


GRID = "(SELECT unnest([" + ", ".join(map(str, V.THRESHOLD_GRID)) + "])::DOUBLE AS t)"
TABLE = CLASSES + f"""
, gt AS (SELECT block, a.t AS thr_on, b.t AS thr_off, avg(abs({_price('a.t', 'b.t')} - target_price)) AS mae FROM f, {GRID} a, {GRID} b WHERE split = 'valid' GROUP BY ALL),
b1 AS (SELECT block, thr_on AS t_all FROM gt WHERE thr_on = thr_off QUALIFY row_number() OVER (PARTITION BY block ORDER BY round(mae, 9), thr_on) = 1),
b2 AS (SELECT block, thr_on, thr_off FROM gt QUALIFY row_number() OVER (PARTITION BY block ORDER BY round(mae, 9), thr_on, thr_off) = 1)"""


@query("j12_threshold_grid", TABLE + " SELECT block, thr_on, thr_off, round(mae, 3) AS mae FROM gt")
def _(spark, sf):
    return E.threshold_table(frame(spark, sf).where("split = 'valid'")).withColumn("mae", r6("mae", 3))


@query("h16_best_thresholds", TABLE + " SELECT block, t_all, thr_on, thr_off FROM b1 JOIN b2 USING (block)")
def _(spark, sf):
    t = E.threshold_table(frame(spark, sf).where("split = 'valid'"))
    return E.best_thresholds(t, False).select("block", F.col("thr_on").alias("t_all")).join(E.best_thresholds(t, True), "block")


@query("h17_policies", TABLE + f"""
, te AS (SELECT f.*, t_all, thr_on, thr_off FROM f JOIN b1 USING (block) JOIN b2 USING (block) WHERE split = 'test'),
po AS (SELECT *, unnest([{{'n': 'persistence', 'p': {_price(1.0, 1.0)}}}, {{'n': 'calendar gate, pilot threshold', 'p': {_price(0.5, 1.0)}}}, {{'n': 'every day, pilot threshold', 'p': {_price(0.5, 0.5)}}},
 {{'n': 'every day, tuned threshold', 'p': {_price('t_all', 't_all')}}}, {{'n': 'dual thresholds', 'p': {_price('thr_on', 'thr_off')}}}]) AS x FROM te)
SELECT block, x.n AS policy, count(*) AS rows, round(avg(abs(x.p - target_price)), 3) AS mae, round(100 * (avg(abs(base_price - target_price)) - avg(abs(x.p - target_price))) / avg(abs(base_price - target_price)), 6) AS vs_persistence_pct,
 {", ".join(f"round(sum(CASE WHEN {'' if d == 'target' else 'NOT '}is_target_data AND cls = '{c}' THEN abs(base_price - target_price) - abs(x.p - target_price) ELSE 0 END), 1) AS gain_{d}_{c}" for d in ("target", "other") for c in V.ROW_CLASSES)}
FROM po GROUP BY block, x.n""")
def _(spark, sf):
    out = E.policies(classed(spark, sf), 0.5).drop("thr_on", "thr_off").withColumn("mae", r6("mae", 3))
    out = rounded(out, ["vs_persistence_pct"])
    return out.select(*[r6(c, 1).alias(c) if c.startswith("gain") else F.col(c) for c in out.columns])


@query("h18_h19_clean_policies", CLASSES + f"""
, x AS (SELECT *, {_price(0.5, 1.0)} AS g, {_price(0.5, 0.5)} AS e, unnest(list_filter(['all rows', CASE WHEN cls <> 'label_b3' THEN 'all rows except label_b3' END, CASE WHEN cls IN ('real', 'flat') THEN 'clean rows (real + flat)' END], lambda z: z IS NOT NULL)) AS subset FROM f WHERE split = 'test'),
dd AS (SELECT block, subset, date, avg(abs(e - target_price) - abs(g - target_price)) AS d FROM x GROUP BY ALL),
dm AS (SELECT block, subset, avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1) / count(*)::DOUBLE) AS dm FROM dd GROUP BY ALL)
SELECT x.block, x.subset, count(*) AS rows, round(avg(abs(base_price - target_price)), 3) AS mae_persistence, round(100 * (1 - avg(abs(g - target_price)) / avg(abs(base_price - target_price))), 6) AS gate_vs_pers_pct,
 round(100 * (1 - avg(abs(e - target_price)) / avg(abs(base_price - target_price))), 6) AS every_vs_pers_pct, round(any_value(dm.dm), 6) AS dm_every_minus_gate FROM x JOIN dm ON dm.block = x.block AND dm.subset = x.subset GROUP BY x.block, x.subset""")
def _(spark, sf):
    out = E.clean_policies(classed(spark, sf), 0.5).drop("p").withColumn("mae_persistence", r6("mae_persistence", 3))
    return rounded(out, ["gate_vs_pers_pct", "every_vs_pers_pct", "dm_every_minus_gate"])


@query("h19_dm_p_values")
def _(spark, sf):
    df = frame(spark, sf)
    return E.dm_test(df, "pred_price", "base_price", ["block"])


@query("e18_class_table", CLASSES + " SELECT block, is_target_data, cls, count(*) AS rows, round(sum(abs(base_price - target_price)), 1) AS persistence_err FROM f WHERE split = 'test' GROUP BY ALL")
def _(spark, sf):
    return E.class_table(classed(spark, sf)).withColumn("persistence_err", r6("persistence_err", 1))


def archive(spark, sf):
    w = Window.partitionBy("store", "name").orderBy("date")
    df = D.sparse_panel(spark, sf).withColumns({"price_lag_1": F.lag("price").over(w), "price_lag_7": F.lag("price", 7).over(w), "price_mean_7": F.avg("price").over(w.rowsBetween(-7, -1))})
    return df.where("price_lag_7 is not null").withColumn("fold", F.when(F.year("date") < 1998, "Fold 1").when(F.year("date") < 2000, "Fold 2").otherwise("Fold 3"))


PREDS = {"Last price": "price_lag_1", "Last week": "price_lag_7", "Rolling mean 7": "price_mean_7"}
ARCHIVE = with_sql(D.SPARSE_PANEL) + """
, a AS (SELECT *, CASE WHEN year(date) < 1998 THEN 'Fold 1' WHEN year(date) < 2000 THEN 'Fold 2' ELSE 'Fold 3' END AS fold FROM (SELECT *, lag(price) OVER w AS l, lag(price, 7) OVER w AS l7,
 avg(price) OVER (PARTITION BY store, name ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM panel WINDOW w AS (PARTITION BY store, name ORDER BY date)) WHERE l7 IS NOT NULL),
x AS (SELECT *, unnest([{'n': 'Last price', 'p': l}, {'n': 'Last week', 'p': l7}, {'n': 'Rolling mean 7', 'p': m7}]) AS q FROM a),
cm AS (SELECT fold, q.n AS model, count(*) AS rows, count(*) FILTER (abs(price - l) > 0.01) AS changed_rows, avg(abs(q.p - price)) AS mae, sqrt(avg((q.p - price) ** 2)) AS rmse, 100 * avg(abs(q.p - price) / price) AS mape_pct,
 1 - sum((q.p - price) ** 2) / (var_pop(price) * count(*)) AS r2, avg(CASE WHEN abs(price - l) > 0.01 THEN abs(q.p - price) END) AS changed_mae, avg(CASE WHEN abs(price - l) > 0.01 THEN abs(l - price) END) AS changed_baseline_mae,
 100 * avg(CASE WHEN price <> l THEN CAST(sign(price - l) = sign(q.p - l) AS INT) END) AS direction_pct FROM x GROUP BY ALL)"""
ARCH_NUM = {"mae": 3, "rmse": 3, "mape_pct": 6, "r2": 6, "changed_mae": 3, "changed_baseline_mae": 3, "direction_pct": 6}


@query("h21_baseline_comparison", ARCHIVE + " SELECT fold, model, rows, changed_rows, " + ", ".join(f"round({c}, {d}) AS {c}" for c, d in ARCH_NUM.items()) + " FROM cm")
def _(spark, sf):
    out = E.compare_predictions(archive(spark, sf), PREDS, keys=["fold"])
    return out.select(*[r6(c, ARCH_NUM[c]).alias(c) if c in ARCH_NUM else F.col(c) for c in out.columns])


@query("e30_direction_confusion", ARCHIVE + " SELECT CAST(sign(price - l) AS INT) AS actual, count(*) FILTER (sign(m7 - l) < 0) AS down, count(*) FILTER (m7 = l) AS flat, count(*) FILTER (sign(m7 - l) > 0) AS up FROM a WHERE price <> l GROUP BY 1")
def _(spark, sf):
    return E.direction_confusion(archive(spark, sf), "price_mean_7")


@query("h22_fold_summary", ARCHIVE + """
, b AS (SELECT m.*, l.mae AS baseline_mae, l.mae - m.mae AS improvement FROM cm m JOIN cm l ON l.fold = m.fold AND l.model = 'Last week')
SELECT model, """ + ", ".join(f"round(avg({c}), 3) AS mean_{c}, round(stddev_samp({c}), 3) AS std_{c}" for c in ("mae", "baseline_mae", "improvement", "changed_mae", "changed_baseline_mae", "rmse", "r2"))
       + """, CAST(sum(changed_rows) AS BIGINT) AS changed_rows, count(*) AS total_folds, count(*) FILTER (mae < baseline_mae) AS folds_beating_baseline,
 round(count(*) FILTER (mae < baseline_mae) / count(*)::DOUBLE, 6) AS win_rate, avg(improvement) > 0 AND count(*) FILTER (mae < baseline_mae) / count(*)::DOUBLE >= 2.0 / 3 AND avg(changed_mae) < avg(changed_baseline_mae) AS reliable_candidate
FROM b GROUP BY model""")
def _(spark, sf):
    cm = E.compare_predictions(archive(spark, sf), PREDS, keys=["fold"])
    base = cm.where("model = 'Last week'").select("fold", F.col("mae").alias("baseline_mae"))
    out = E.fold_summary(cm.join(base, "fold").withColumn("improvement", F.col("baseline_mae") - F.col("mae")))
    return out.select(*[r6(c, 6 if c == "win_rate" else 3).alias(c) if c.startswith(("mean_", "std_", "win")) else F.col(c) for c in out.columns])


@query("h23_spearman", """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b,
 rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS c FROM lineitem),
m AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r)
SELECT n.a, n.b, round(CASE WHEN n.a = n.b THEN 1.0 WHEN n.a || n.b IN ('l_quantityl_extendedprice', 'l_extendedpricel_quantity') THEN ab WHEN n.a || n.b IN ('l_quantityl_discount', 'l_discountl_quantity') THEN ac ELSE bc END, 6)::DOUBLE AS rho
FROM m, (SELECT x.c AS a, y.c AS b FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS c) x, (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS c) y) n""")
def _(spark, sf):
    return E.spearman(D.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("rho", r6("rho"))


POINTS = with_sql(D.LONG_PANEL) + """
, v AS (SELECT store, name AS segment_id, date, round(floor(price / 20000) * 20000, 2) AS price FROM panel),
p AS (SELECT * FROM (SELECT *, lag(price) OVER w AS q, row_number() OVER w AS n FROM v WINDOW w AS (PARTITION BY store, segment_id ORDER BY date)) WHERE n = 1 OR price <> q)"""


def stepped(spark, sf):
    return D.as_segments(D.long_panel(spark, sf)).withColumn("price", F.floor(F.col("shelf_price") / 20000) * F.lit(20000.0))


@query("f24_change_points", POINTS + " SELECT store, segment_id, date, price FROM p")
def _(spark, sf):
    return E.change_points(stepped(spark, sf), KEYS, "price")


@query("f25_expanded_points", POINTS + """
, nx AS (SELECT *, coalesce(lead(date) OVER (PARTITION BY store, segment_id ORDER BY date) - 1, DATE '2001-12-01') AS u FROM p)
SELECT store, segment_id, CAST(unnest(generate_series(date, u, INTERVAL 1 DAY)) AS DATE) AS date, price FROM nx""")
def _(spark, sf):
    return E.expand_points(E.change_points(stepped(spark, sf), KEYS, "price"), KEYS, "price", F.lit("2001-12-01").cast("date"))


@query("h24_product_export", FRAME + """
, pr AS (SELECT store, segment_id, count(*) AS forecasts, bool_or(abs(round(pred_price, 2) / round(base_price, 2) - 1) > 0.005) AS chg FROM f WHERE is_target_data GROUP BY ALL),
cp AS (SELECT store, segment_id, count(*) AS points FROM (SELECT *, lag(round(target_price, 2)) OVER (PARTITION BY store, segment_id ORDER BY date) AS q FROM f) WHERE q IS NULL OR q <> round(target_price, 2) GROUP BY ALL)
SELECT store, segment_id, 'Product ' || segment_id AS n, 'unknown' AS c, CAST(points AS INT) AS points, CAST(forecasts AS INT) AS forecasts, chg FROM pr JOIN cp USING (store, segment_id) WHERE lower('Product ' || segment_id) LIKE '%product%' AND chg""")
def _(spark, sf):
    f = frame(spark, sf).withColumn("coicop", F.lit(None).cast("string"))
    meta = f.select(*KEYS).distinct().withColumn("name", F.concat(F.lit("Product "), F.col("segment_id")))
    out = E.filter_products(E.product_export(f, f.where("is_target_data"), meta), "PRODUCT", only_changes=True)
    return out.select(*KEYS, "n", "c", F.size("r").alias("points"), F.size("p").alias("forecasts"), "chg")


@query("l12_wilson_interval", """
SELECT method, n, round(p, 6) AS precision, round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS ci_low,
 round((p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 6) AS ci_high
FROM (SELECT l_returnflag AS method, count(*) AS n, count(*) FILTER (l_quantity > 20)::DOUBLE / count(*) AS p FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    g = D.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(
        F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 20).alias("k"))
    lo, hi = E.wilson(F.col("k"), F.col("n"))
    return g.select("method", "n", r6(F.col("k") / F.col("n")).alias("precision"), r6(lo).alias("ci_low"), r6(hi).alias("ci_high"))
