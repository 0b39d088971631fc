"""Calendar-rule queries (R, G9) and the flagship."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..functions import calendar as K
from ..operators import rules as R, sales as S
from ..operators.cells import shelf_cells
from ..session import settle
from .. import fixed_values as V
from . import datasets as D
from .cleaning_queries import event_daily, long_daily
from .registry import query

HOLIDAYS = ("1998-03-19", "1998-04-23", "1998-05-01", "1998-10-29", "2024-01-05")
HOL = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)
MIN = 2
TRAIN_END, TEST_START = "1999-06-30", "1999-08-01"
TDATA = f"(dom IN (1, 14, 15, 16) OR date IN ({HOL}))"


def rounded(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def dense_long(spark, sf):
    return settle(long_daily(spark, sf).where(F.col("products") >= MIN), "daily")


LONG = D.LONG_DAILY + f", d AS (SELECT * FROM daily WHERE products >= {MIN})"


@query("flagship_change_days", D.EVENT_DAILY + """
, k AS (SELECT store, dom AS key, sum(rate) / count(*) AS rate FROM daily WHERE date <= DATE '2024-01-20' GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY round(rate, 12) DESC, key) AS rank FROM k QUALIFY rank <= 4)
SELECT d.store, round(sum(CASE WHEN t.key IS NOT NULL THEN changes ELSE 0 END)::DOUBLE / sum(changes), 6) AS chg,
 round(sum(CASE WHEN t.key IS NOT NULL THEN err ELSE 0 END) / sum(err), 6) AS tl, round(avg(CASE WHEN t.key IS NOT NULL THEN 1.0 ELSE 0 END::DOUBLE), 6) AS days
FROM daily d LEFT JOIN t ON t.store = d.store AND t.key = d.dom GROUP BY d.store""")
def _(spark, sf):
    daily = event_daily(spark, sf)
    marked = R.rule_mask(daily, R.top_keys(daily, "2024-01-20", 4))
    return rounded(R.coverage(marked, F.col("on")), ["chg", "tl", "days"])


@query("r1_r3_fixed_rules", LONG + f"""
SELECT store, date, true AS every_day, {TDATA} AS pilot_1_14_15_16_hol, dom IN (1, 15) OR date = last_day(date) OR date IN ({HOL}) AS spec_1_15_end_hol, dom = 1 AS "1st_only" FROM d""")
def _(spark, sf):
    return dense_long(spark, sf).select("store", "date", *[m.alias(n) for n, m in R.fixed_masks("date", HOLIDAYS).items()])


@query("r2_g1_top_keys", LONG + """
SELECT store, key, round(rate, 6) AS rate, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY store ORDER BY round(rate, 12) DESC, key) AS INT) AS rank
 FROM (SELECT store, dom AS key, sum(rate) / count(*) AS rate FROM d WHERE date <= DATE '1999-06-30' GROUP BY ALL)) WHERE rank <= 6""")
def _(spark, sf):
    return R.top_keys(dense_long(spark, sf), TRAIN_END, 6).withColumn("rate", r6("rate"))


@query("r2_shrunk_top_keys", LONG + """
, p AS (SELECT dom AS key, avg(rate) AS pooled FROM d GROUP BY 1)
SELECT store, key, round(rate, 6) AS rate, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY store ORDER BY round(rate, 12) DESC, key) AS INT) AS rank
 FROM (SELECT store, key, (s + 2 * coalesce(pooled, (SELECT avg(pooled) FROM p))) / (n + 2) AS rate FROM (SELECT store, dom AS key, sum(rate) AS s, count(*) AS n FROM d
   WHERE date <= DATE '1999-06-30' GROUP BY ALL) LEFT JOIN p USING (key))) WHERE rank <= 6""")
def _(spark, sf):
    daily = dense_long(spark, sf)
    return R.top_keys(daily, TRAIN_END, 6, shrink=2.0, pooled=R.pooled_keys(daily)).withColumn("rate", r6("rate"))


@query("g2_pooled_top_keys", LONG + " SELECT dom AS key, round(avg(rate), 6) AS pooled FROM d GROUP BY 1 ORDER BY round(avg(rate), 12) DESC, key LIMIT 4")
def _(spark, sf):
    return R.pooled_keys(dense_long(spark, sf), k=4).withColumn("pooled", r6("pooled"))


# back-test panel: stores are the two line states, products odd and even lines, so that days are full at every scale; each month is an origin
STATE_PANEL = """panel AS (SELECT l_linestatus AS store, CAST(l_linenumber % 2 AS VARCHAR) AS name, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL)"""
ORIGIN_SQL = D.with_sql(STATE_PANEL, D.sale_flags_sql(), D.REGULAR, D.CHANGES, D.DAILY) + f"""
, d AS (SELECT * FROM daily WHERE products >= {MIN}),
o AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS origin FROM d),
tr AS (SELECT origin, d.* FROM o JOIN d ON d.date < origin), te AS (SELECT origin, d.* FROM o JOIN d ON d.date >= origin AND d.date <= last_day(origin)),
pl AS (SELECT origin, dom, avg(rate) AS pooled FROM tr GROUP BY ALL), plm AS (SELECT origin, avg(pooled) AS pm FROM pl GROUP BY ALL),
kd AS (SELECT store, origin, dom, sum(rate) AS s, count(*) AS n FROM tr GROUP BY ALL),
kd2 AS (SELECT kd.*, round(s / n, 12) AS rate, round((s + 2 * coalesce(pooled, pm)) / (n + 2), 12) AS shrunk FROM kd LEFT JOIN pl USING (origin, dom) LEFT JOIN plm USING (origin)),
rd AS (SELECT *, row_number() OVER (PARTITION BY store, origin ORDER BY rate DESC, dom) AS r_dom, row_number() OVER (PARTITION BY store, origin ORDER BY shrunk DESC, dom) AS r_shr FROM kd2),
rw AS (SELECT *, row_number() OVER (PARTITION BY store, origin ORDER BY rate DESC, dow) AS r_dow FROM (SELECT store, origin, dow, round(avg(rate), 12) AS rate, count(*) AS n FROM tr GROUP BY ALL)),
rp AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY round(pooled, 12) DESC, dom) AS r_pool FROM pl),
nt AS (SELECT store, origin, count(*) AS train_days FROM tr GROUP BY ALL),
m AS (SELECT te.*, coalesce(r_dom, 99) AS r_dom, coalesce(r_shr, 99) AS r_shr, coalesce(r_dow, 99) AS r_dow, coalesce(r_pool, 99) AS r_pool, train_days
  FROM te JOIN nt USING (store, origin) LEFT JOIN rd USING (store, origin, dom) LEFT JOIN rw USING (store, origin, dow) LEFT JOIN rp USING (origin, dom)),
x AS (SELECT *, unnest([{{'k': 'every_day', 'v': true}}, {{'k': 'pilot_1_14_15_16_hol', 'v': {TDATA}}}, {{'k': 'spec_1_15_end_hol', 'v': dom IN (1, 15) OR date = last_day(date) OR date IN ({HOL})}},
  {{'k': '1st_only', 'v': dom = 1}}, {{'k': 'dom_top2', 'v': r_dom <= 2}}, {{'k': 'dom_top4', 'v': r_dom <= 4}}, {{'k': 'dom_top6', 'v': r_dom <= 6}}, {{'k': 'dom_top4_shrunk', 'v': r_shr <= 4}},
  {{'k': 'pooled_dom_top4', 'v': r_pool <= 4}}, {{'k': 'dow_top1', 'v': r_dow <= 1}}, {{'k': 'dow_top2', 'v': r_dow <= 2}}, {{'k': 'dom_top2+dow_top1', 'v': r_dom <= 2 OR r_dow <= 1}}]) AS mk FROM m),
res AS (SELECT store, strftime(origin, '%Y-%m') AS origin, mk.k AS method, count(*) AS days, count(*) FILTER (mk.v) AS sel_days, CAST(sum(changes) AS BIGINT) AS changes,
  CAST(sum(CASE WHEN mk.v THEN changes ELSE 0 END) AS BIGINT) AS sel_changes, sum(err) AS err, sum(CASE WHEN mk.v THEN err ELSE 0 END) AS sel_err
  FROM x GROUP BY store, origin, mk.k HAVING max(train_days) >= 20 AND count(*) >= 5)"""
BEST_SQL = ORIGIN_SQL + f"""
, c AS (SELECT * FROM res WHERE method IN ({", ".join(f"'{c}'" for c in V.STORE_BEST_CANDIDATES)})),
ex AS (SELECT a.store, a.origin, b.method, sum(b.sel_changes) / greatest(sum(b.changes), 1)::DOUBLE - sum(b.sel_days) / sum(b.days)::DOUBLE AS excess
  FROM (SELECT DISTINCT store, origin FROM c) a JOIN c b ON b.store = a.store AND b.origin < a.origin GROUP BY ALL),
pk AS (SELECT store, origin, method FROM ex QUALIFY row_number() OVER (PARTITION BY store, origin ORDER BY excess DESC, method) = 1),
best AS (SELECT c.store, c.origin, 'store_best' AS method, days, sel_days, changes, sel_changes, err, sel_err, c.method AS picked
  FROM c LEFT JOIN pk ON pk.store = c.store AND pk.origin = c.origin WHERE c.method = coalesce(pk.method, 'pilot_1_14_15_16_hol')),
res2 AS (SELECT *, CAST(NULL AS VARCHAR) AS picked FROM res UNION ALL BY NAME SELECT * FROM best)"""


def gate_rates(spark, sf):
    """Daily rates of the back-test, and every month it starts from."""
    rows = D.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("store"), (F.col("l_linenumber") % 2).cast("string").alias("name"),
                                                 F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"))
    daily = settle(S.daily_rates(S.count_changes(S.regular_prices(shelf_cells(rows)))), "daily")
    months = daily.where(F.col("products") >= MIN).select(F.trunc("date", "month").alias("m")).distinct().orderBy("m").collect()   # one per calendar month
    return daily, [str(r["m"]) for r in months]


def backtest(spark, sf):
    daily, origins = gate_rates(spark, sf)
    return R.rolling_origins(daily, origins, HOLIDAYS, min_products=MIN)


@query("r4_rolling_origins", ORIGIN_SQL + " SELECT * REPLACE (round(err, 4) AS err, round(sel_err, 4) AS sel_err) FROM res")
def _(spark, sf):
    return backtest(spark, sf).withColumn("err", r6("err", 4)).withColumn("sel_err", r6("sel_err", 4))


@query("r7_store_best", BEST_SQL + " SELECT * REPLACE (round(err, 4) AS err, round(sel_err, 4) AS sel_err) FROM res2")
def _(spark, sf):
    return R.store_best(backtest(spark, sf)).withColumn("err", r6("err", 4)).withColumn("sel_err", r6("sel_err", 4))


@query("r8_rule_summary", BEST_SQL + """
SELECT store, method, CAST(sum(days) AS BIGINT) AS days, CAST(sum(sel_days) AS BIGINT) AS sel_days, CAST(sum(changes) AS BIGINT) AS changes, CAST(sum(sel_changes) AS BIGINT) AS sel_changes,
 round(sum(err), 3) AS err, round(sum(sel_err), 3) AS sel_err, count(*) AS origins, round(min(sel_changes / nullif(changes, 0)::DOUBLE), 6) AS capture_min_month,
 round(sum(sel_days) / sum(days)::DOUBLE, 6) AS day_share, round(sum(sel_changes) / sum(changes)::DOUBLE, 6) AS change_capture, round(sum(sel_err) / sum(err), 6) AS err_capture,
 round(CASE WHEN sum(sel_days) > 0 THEN (sum(sel_changes) / sum(changes)::DOUBLE) / (sum(sel_days) / sum(days)::DOUBLE) END, 6) AS lift FROM res2 GROUP BY store, method""")
def _(spark, sf):
    out = R.summarise(R.store_best(backtest(spark, sf)))
    return rounded(out, ["capture_min_month", "day_share", "change_capture", "err_capture", "lift"]).withColumn("err", r6("err", 3)).withColumn("sel_err", r6("sel_err", 3))


CAUSAL = {c: c for c in ("hist_dom", "hist_dow", "store_mean", "hist_dom_rel", "hist_dow_rel", "rate_lag1", "rate_7d")}


@query("r5_j6_f18_f19_causal_day_features", LONG + """
, h AS (SELECT *, avg(rate) OVER (PARTITION BY store, dom ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_dom,
 avg(rate) OVER (PARTITION BY store, dow ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist_dow,
 row_number() OVER (PARTITION BY store, dom ORDER BY date) - 1 AS hist_dom_n, row_number() OVER (PARTITION BY store, dow ORDER BY date) - 1 AS hist_dow_n,
 avg(rate) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS store_mean,
 avg(rate) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rate_7d FROM d)
SELECT h.store, h.date, hist_dom_n, hist_dow_n, round(hist_dom + 1e-9, 6) AS hist_dom, round(hist_dow + 1e-9, 6) AS hist_dow, round(store_mean + 1e-9, 6) AS store_mean,
 round(CASE WHEN store_mean <> 0 THEN hist_dom / store_mean END + 1e-9, 6) AS hist_dom_rel, round(CASE WHEN store_mean <> 0 THEN hist_dow / store_mean END + 1e-9, 6) AS hist_dow_rel,
 round(y.rate + 1e-9, 6) AS rate_lag1, round(rate_7d + 1e-9, 6) AS rate_7d FROM h LEFT JOIN d y ON y.store = h.store AND y.date + 1 = h.date""")
def _(spark, sf):
    return R.causal_day_features(dense_long(spark, sf), HOLIDAYS).select(
        "store", "date", "hist_dom_n", "hist_dow_n", *[r6(F.col(c) + 1e-9).alias(c) for c in CAUSAL])


@query("j6_calendar_shift", LONG + """ SELECT a.store, a.date, round(b.rate, 6) AS rate_lag1 FROM d a LEFT JOIN d b ON a.store = b.store AND a.date = b.date + 1""")
def _(spark, sf):
    return R.shifted_rate(dense_long(spark, sf)).select("store", "date", r6("rate_lag1").alias("rate_lag1"))


def _quantile(q: float, n: int) -> str:
    at = q * (n - 1)
    return f"s[{int(at) + 1}] + {at - int(at)} * (s[{int(at) + 2}] - s[{int(at) + 1}])"


@query("r9_bootstrap_day_rates", LONG + f"""
, g AS (SELECT store, dom, count(*) AS n, avg(rate) AS rate, list(rate ORDER BY date) AS r FROM d GROUP BY ALL),
m AS (SELECT store, dom, rep, sum(r[1 + ('0x' || substr(md5(concat_ws('|', {V.SEED}, rep, i, store, dom)), 1, 8))::BIGINT % n]) / any_value(n) AS m
 FROM (SELECT *, unnest(range(0, n)) AS i FROM g) x, (SELECT unnest(range(1, {V.BOOTSTRAP_REPS + 1})) AS rep) y GROUP BY ALL),
b AS (SELECT store, dom, list_sort(list(m)) AS s FROM m GROUP BY ALL)
SELECT store, dom, n AS n_dates, round(rate, 6) AS rate, round({_quantile(0.05, V.BOOTSTRAP_REPS)}, 6) AS lo, round({_quantile(0.95, V.BOOTSTRAP_REPS)}, 6) AS hi FROM g JOIN b USING (store, dom)""")
def _(spark, sf):
    return rounded(R.bootstrap_day_rates(long_daily(spark, sf), min_products=MIN), ["rate", "lo", "hi"])


SPLIT = LONG + f"""
, tr AS (SELECT * FROM d WHERE date <= DATE '{TRAIN_END}'), te AS (SELECT * FROM d WHERE date >= DATE '{TEST_START}'),
kr AS (SELECT store, 'dow' AS "by", dow AS key, avg(rate) AS rate FROM tr GROUP BY ALL UNION ALL SELECT store, 'dom', dom, avg(rate) FROM tr GROUP BY ALL),
fam AS (SELECT *, "by" AS family FROM kr UNION ALL SELECT *, 'mix' FROM kr),
rk AS (SELECT *, row_number() OVER (PARTITION BY store, family ORDER BY round(rate, 12) DESC, "by" DESC, key) AS rank,
 CASE WHEN "by" = 'dom' THEN CAST(key AS VARCHAR) ELSE ['Pzt', 'Sal', 'Çar', 'Per', 'Cum', 'Cmt', 'Paz'][key + 1] END AS lbl FROM fam)"""


def split(spark, sf):
    d = dense_long(spark, sf)
    return d, d.where(F.col("date") <= F.lit(TRAIN_END).cast("date")), d.where(F.col("date") >= F.lit(TEST_START).cast("date"))


@query("r10_rank_keys", SPLIT + """ SELECT store, "by", key, round(rate, 6) AS rate, family, CAST(rank AS INT) AS rank FROM rk""")
def _(spark, sf):
    return R.rank_keys(split(spark, sf)[1]).withColumn("rate", r6("rate"))


@query("r11_coverage", SPLIT + f""" SELECT store, round(sum(CASE WHEN {TDATA} THEN changes ELSE 0 END)::DOUBLE / sum(changes), 6) AS chg,
 round(sum(CASE WHEN {TDATA} THEN err ELSE 0 END) / sum(err), 6) AS tl, round(avg(CASE WHEN {TDATA} THEN 1.0 ELSE 0 END::DOUBLE), 6) AS days FROM te GROUP BY store""")
def _(spark, sf):
    return rounded(R.coverage(split(spark, sf)[2], K.is_target_data("date", HOLIDAYS)), ["chg", "tl", "days"])


def _cov(mask, prefix):
    return (f"round(sum(CASE WHEN {mask} THEN changes ELSE 0 END)::DOUBLE / sum(changes), 6) AS {prefix}chg, "
            f"round(sum(CASE WHEN {mask} THEN err ELSE 0 END) / sum(err), 6) AS {prefix}tl, round(avg(CAST({mask} AS INT)), 6) AS {prefix}days")


@query("r13_weekly_vs_monthly", SPLIT + f"""
, b AS (SELECT * FROM (VALUES (1, 4), (2, 9), (3, 13), (4, 17)) t(kw, km)),
s AS (SELECT te.*, kw, EXISTS (SELECT 1 FROM rk WHERE rk.store = te.store AND family = 'dow' AND rank <= kw AND key = te.dow) AS w,
  EXISTS (SELECT 1 FROM rk WHERE rk.store = te.store AND family = 'dom' AND rank <= km AND key = te.dom) AS m FROM te, b),
c AS (SELECT store, kw, {_cov('w', 'weekly_')}, {_cov('m', 'monthly_')} FROM s GROUP BY ALL),
l AS (SELECT rk.store, kw, string_agg(lbl, ', ' ORDER BY rank) FILTER (family = 'dow' AND rank <= kw) AS weekly_rule,
  string_agg(lbl, ', ' ORDER BY rank) FILTER (family = 'dom' AND rank <= km) AS monthly_rule FROM rk, b GROUP BY ALL)
SELECT c.* EXCLUDE (kw), CAST(round(kw * 30.4 / 7) AS INT) AS days_per_month, weekly_rule, monthly_rule FROM c JOIN l USING (store, kw)""")
def _(spark, sf):
    _, tr, te = split(spark, sf)
    return rounded(R.weekly_vs_monthly(tr, te), [f"{a}_{b}" for a in ("weekly", "monthly") for b in ("chg", "tl", "days")])


def _greedy(budgets):
    return SPLIT.replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, bud AS (SELECT unnest([{", ".join(map(str, budgets))}])::DOUBLE AS budget),
n AS (SELECT store, family, max(rank) AS last FROM rk GROUP BY ALL),
g AS (SELECT store, family, budget, CAST(0 AS BIGINT) AS rank, CAST([] AS VARCHAR[]) AS sel, CAST([] AS VARCHAR[]) AS lab FROM (SELECT DISTINCT store, family FROM rk), bud
 UNION ALL SELECT store, family, budget, rank, CASE WHEN share > budget THEN sel ELSE list_append(sel, kk) END, CASE WHEN share > budget THEN lab ELSE list_append(lab, lbl) END FROM (
  SELECT g.store, g.family, g.budget, g.rank + 1 AS rank, g.sel, g.lab, rk.lbl, rk."by" || rk.key AS kk,
   (SELECT avg(CASE WHEN list_contains(list_append(g.sel, rk."by" || rk.key), 'dom' || t.dom) OR list_contains(list_append(g.sel, rk."by" || rk.key), 'dow' || t.dow) THEN 1.0 ELSE 0 END) FROM tr t WHERE t.store = g.store) AS share
  FROM g JOIN rk ON rk.store = g.store AND rk.family = g.family AND rk.rank = g.rank + 1)),
fin AS (SELECT g.* FROM g JOIN n ON n.store = g.store AND n.family = g.family AND g.rank = n.last)"""


@query("r12_r14_family_budget_table", _greedy([b + 0.02 for b in V.FAMILY_BUDGETS]) + f"""
, sc AS (SELECT te.*, family, budget, list_contains(sel, 'dom' || dom) OR list_contains(sel, 'dow' || dow) AS onn FROM te JOIN fin USING (store))
SELECT store, family, round(budget - 0.02, 2) AS train_budget, array_to_string(any_value(lab), ', ') AS rule, {_cov('onn', '')} FROM sc JOIN (SELECT store, family, budget, lab FROM fin) USING (store, family, budget) GROUP BY store, family, budget""")
def _(spark, sf):
    _, tr, te = split(spark, sf)
    return rounded(R.family_table(tr, te), ["chg", "tl", "days"])


CURVE_MONTHS = ["1999-05", "1999-06", "1999-08"]


@query("r15_weekday_curve", SPLIT + f"""
, ks AS (SELECT unnest(range(1, 8)) AS k),
hit AS (SELECT d.*, k, EXISTS (SELECT 1 FROM rk WHERE rk.store = d.store AND family = 'dow' AND rank <= k AND key = d.dow) AS h FROM d, ks WHERE k <= (SELECT count(*) FROM rk WHERE rk.store = d.store AND family = 'dow')),
l AS (SELECT rk.store, k, string_agg(lbl, ', ' ORDER BY rank) FILTER (rank <= k) AS rule FROM rk, ks WHERE family = 'dow' GROUP BY ALL),
a AS (SELECT store, k, sum(CASE WHEN h AND date <= DATE '{TRAIN_END}' THEN changes ELSE 0 END)::DOUBLE / sum(CASE WHEN date <= DATE '{TRAIN_END}' THEN changes END) AS train_chg,
 {", ".join(f"round(sum(CASE WHEN h AND strftime(date, '%Y-%m') = '{m}' THEN changes ELSE 0 END)::DOUBLE / sum(CASE WHEN strftime(date, '%Y-%m') = '{m}' THEN changes END), 6) AS {chr(34)}cov_{m}{chr(34)}" for m in CURVE_MONTHS)} FROM hit GROUP BY ALL),
t AS (SELECT store, k, {_cov('h', 'test_')} FROM hit WHERE date >= DATE '{TEST_START}' GROUP BY ALL)
SELECT a.* EXCLUDE (k, train_chg), round(train_chg, 6) AS train_chg, t.* EXCLUDE (store, k), rule, round(k * 30.4 / 7, 1)::DOUBLE AS days_per_month FROM a JOIN t USING (store, k) JOIN l USING (store, k)""")
def _(spark, sf):
    d, tr, te = split(spark, sf)
    out = R.weekday_curve(d, tr, te, CURVE_MONTHS)
    return rounded(out, ["train_chg", "test_chg", "test_tl", "test_days", *[f"cov_{m}" for m in CURVE_MONTHS]])


@query("r16_triggers", _greedy([0.17]) + f"""
, sg AS (SELECT a.store, a.date, y.rate AS own, (SELECT avg(o.rate) FROM d o WHERE o.store <> a.store AND o.date = a.date - 1) AS comp FROM d a LEFT JOIN d y ON y.store = a.store AND y.date = a.date - 1),
lim AS (SELECT store, quantile_cont(own, 0.9) AS lo, quantile_cont(comp, 0.9) AS lc FROM sg WHERE date <= DATE '{TRAIN_END}' GROUP BY store),
tt AS (SELECT te.*, list_contains(sel, 'dom' || dom) OR list_contains(sel, 'dow' || dow) AS cal, coalesce(own > lo, false) AS ot, coalesce(comp > lc, false) AS ct
  FROM te JOIN sg USING (store, date) JOIN lim USING (store) JOIN (SELECT * FROM fin WHERE family = 'mix') USING (store)),
z AS (SELECT *, unnest([{{'p': 'calendar', 'v': cal}}, {{'p': 'own trigger', 'v': ot}}, {{'p': 'calendar + own trigger', 'v': cal OR ot}}, {{'p': 'competitors trigger', 'v': ct}}, {{'p': 'calendar + competitors trigger', 'v': cal OR ct}}]) AS q FROM tt)
SELECT store, q.p AS policy, {_cov('q.v', '')} FROM z GROUP BY store, q.p""")
def _(spark, sf):
    return rounded(R.trigger_table(*split(spark, sf)), ["chg", "tl", "days"])


CAL = LONG + f""", dd AS (SELECT date, sum(changes) AS changes, sum(products) AS products, sum(err) AS err, CAST(day(date) AS INT) AS dom FROM d GROUP BY date),
kd AS (SELECT *, strftime(date, '%Y-%m') AS month, CASE WHEN dom IN (1, 14, 15, 16) THEN CAST(dom AS VARCHAR) WHEN date IN ({HOL}) THEN 'holiday' ELSE 'other' END AS kind FROM dd)"""


@query("r17_e19_change_calendar_months", CAL + " SELECT month, " + ", ".join(
    f"CAST(sum(changes) FILTER (kind = '{k}') AS BIGINT) AS \"{k}\"" for k in ("1", "14", "15", "16", "holiday"))
    + ", CAST(coalesce(sum(changes) FILTER (kind = 'other'), 0) AS BIGINT) AS other, count(*) FILTER (kind = 'other') AS other_days FROM kd GROUP BY month")
def _(spark, sf):
    return R.change_calendar(dense_long(spark, sf), HOLIDAYS)["months"]


@query("r17_e18_change_calendar_totals", CAL + f" SELECT {TDATA} AS target, count(*) AS days, CAST(sum(changes) AS BIGINT) AS changes, round(sum(err), 3) AS err FROM kd GROUP BY 1")
def _(spark, sf):
    return R.change_calendar(dense_long(spark, sf), HOLIDAYS)["totals"].withColumn("err", r6("err", 3))


@query("r18_r19_rule_tiles", LONG + f"""
, s AS (SELECT store, count(*) AS n, count(*) FILTER ({TDATA}) AS td, count(*) FILTER (NOT {TDATA}) AS od, sum(CASE WHEN {TDATA} THEN changes ELSE 0 END) AS tc, sum(CASE WHEN NOT {TDATA} THEN changes ELSE 0 END) AS oc,
 round(sum(CASE WHEN {TDATA} THEN err ELSE 0 END), 2) AS te, round(sum(CASE WHEN NOT {TDATA} THEN err ELSE 0 END), 2) AS oe FROM d GROUP BY store HAVING count(*) >= 30)
SELECT store, round(td / (td + od)::DOUBLE, 6) AS days_share, round(tc / (tc + oc)::DOUBLE, 6) AS changes_share, round(te / (te + oe), 6) AS err_share, round(tc / td::DOUBLE, 6) AS per_target_day,
 round(oc / od::DOUBLE, 6) AS per_other_day, round((tc / (tc + oc)::DOUBLE) / (td / (td + od)::DOUBLE), 6) AS lift FROM s""")
def _(spark, sf):
    out = R.rule_tiles(R.store_calendars(dense_long(spark, sf), holidays=HOLIDAYS))
    return rounded(out, [c for c in out.columns if c != "store"])


@query("r18_store_calendars", LONG + """
, h AS (SELECT store, count(*) AS days, min(date) AS first, max(date) AS last, CAST(floor(median(products)) AS INT) AS products_median FROM d GROUP BY store HAVING count(*) >= 30),
k AS (SELECT store, dow AS key, sum(changes) AS c, sum(products) AS p, count(*) AS n FROM d GROUP BY ALL)
SELECT h.*, (SELECT string_agg(key || ':' || c || ':' || p || ':' || n, ' ' ORDER BY key) FROM k WHERE k.store = h.store) AS by_weekday FROM h""")
def _(spark, sf):
    out = R.store_calendars(dense_long(spark, sf), holidays=HOLIDAYS)
    txt = F.array_join(F.transform("by_weekday", lambda x: F.concat_ws(":", x["key"], x["changes"], x["products"], x["days"])), " ")
    return out.select("store", "days", "first", "last", "products_median", txt.alias("by_weekday"))


@query("r19_weekday_shares", LONG + """ SELECT store, dow, round(100.0 * sum(changes) / sum(sum(changes)) OVER (PARTITION BY store), 6) AS changes_pct,
 round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY store), 6) AS days_pct, round(100.0 * sum(changes) / sum(products), 6) AS rate_pct FROM d GROUP BY store, dow""")
def _(spark, sf):
    return rounded(R.weekday_shares(dense_long(spark, sf)), ["changes_pct", "days_pct", "rate_pct"])


@query("g9_busiest_keys", LONG + """
, g AS (SELECT store, 'dom' AS "by", dom AS key, sum(changes) AS c, sum(products) AS p FROM d GROUP BY ALL UNION ALL SELECT store, 'dow', dow, sum(changes), sum(products) FROM d GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY c DESC, key) AS r, sum(c) OVER (PARTITION BY store) AS tot FROM g WHERE "by" = 'dow')
SELECT store, (SELECT key FROM g x WHERE x.store = w.store AND "by" = 'dom' ORDER BY c::DOUBLE / p DESC, key LIMIT 1) AS top_dom, (SELECT key FROM g x WHERE x.store = w.store AND "by" = 'dow' ORDER BY c::DOUBLE / p DESC, key LIMIT 1) AS top_dow,
 max(CASE WHEN r = 1 THEN key END) AS first_dow, max(CASE WHEN r = 2 THEN key END) AS second_dow, round(100.0 * sum(CASE WHEN r <= 2 THEN c END) / max(tot), 6) AS top2_share_pct FROM w GROUP BY store""")
def _(spark, sf):
    return R.busiest_keys(dense_long(spark, sf)).withColumn("top2_share_pct", r6("top2_share_pct"))
