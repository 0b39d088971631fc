"""Calendar rules: which days to act on, learned from daily change rates and back-tested.

Input everywhere is the daily table (store, date, products, changes, err, rate, dom, dow): at most one row
per store and calendar day, so per-store windows and groups are bounded by the calendar.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import ratio
from ..functions import calendar as K
from ..session import settle
from .. import fixed_values as V



def fixed_masks(date: str = "date", holidays: Sequence[str] = V.HOLIDAYS_2026) -> dict[str, Column]:
    return {"every_day": F.lit(True), "pilot_1_14_15_16_hol": K.is_target_data(date, holidays),
            "spec_1_15_end_hol": K.is_target_spec(date, holidays), "1st_only": K.dom(date) == 1}


def by_key(daily: DataFrame) -> DataFrame:
    """One row per day and calendar key family: ('dom', day of month) and ('dow', weekday)."""
    pair = F.explode(F.array(F.struct(F.lit("dom").alias("by"), F.col("dom").alias("key")),
                             F.struct(F.lit("dow").alias("by"), F.col("dow").alias("key"))))
    return daily.withColumn("_k", pair).select("*", "_k.by", "_k.key").drop("_k")


def _ranked(df: DataFrame, keys: Sequence[str], rate: str, out: str) -> DataFrame:
    # rounding keeps rates that are equal up to summation order tied, so the key decides
    w = Window.partitionBy(*keys).orderBy(F.round(rate, 12).desc_nulls_last(), F.col("key"))
    return df.withColumn(out, F.row_number().over(w))


def top_keys(daily: DataFrame, train_end, k: int, by: str = "dom", shrink: float = 0.0,
             pooled: DataFrame | None = None) -> DataFrame:
    """Top-k keys per store by mean daily rate up to ``train_end``; ties go to the smaller key.

    ``shrink`` pulls a key's rate towards ``pooled`` (key, pooled), counted in days.
    """
    train = daily.where(F.col("date") <= F.lit(str(train_end)[:10]).cast("date"))
    stats = train.groupBy("store", F.col(by).alias("key")).agg(F.sum("rate").alias("s"), F.count("*").alias("n"))
    if shrink > 0 and pooled is not None:
        fallback = pooled.agg(F.avg("pooled")).scalar()
        stats = stats.join(pooled, "key", "left").withColumn(
            "rate", (F.col("s") + shrink * F.coalesce("pooled", fallback)) / (F.col("n") + shrink))
    else:
        stats = stats.withColumn("rate", ratio("s", "n"))
    return _ranked(stats, ["store"], "rate", "rank").where(F.col("rank") <= k).select("store", "key", "rate", "rank")


def pooled_keys(daily: DataFrame, by: str = "dom", k: int | None = None) -> DataFrame:
    pooled = daily.groupBy(F.col(by).alias("key")).agg(F.avg("rate").alias("pooled"))
    return pooled if k is None else pooled.orderBy(F.round("pooled", 12).desc(), "key").limit(k)


def rule_mask(days: DataFrame, keys: DataFrame, by: str = "dom", out: str = "on") -> DataFrame:
    """Marks the days whose key was selected for their store. ``keys`` is at most 31 rows per store."""
    picked = keys.select("store", F.col("key").alias(by), F.lit(True).alias("_on")).distinct()
    return days.join(picked, ["store", by], "left").withColumn(out, F.coalesce("_on", F.lit(False))).drop("_on")


def coverage(daily: DataFrame, mask: Column, keys: Sequence[str] = ("store",)) -> DataFrame:
    """Share of changes, of error and of days that fall on the masked days."""
    on = lambda c: F.sum(F.when(mask, F.col(c)).otherwise(0))
    return daily.groupBy(*keys).agg(ratio(on("changes"), F.sum("changes")).alias("chg"),
                                    ratio(on("err"), F.sum("err")).alias("tl"),
                                    F.avg(mask.cast("double")).alias("days"))


# --- rolling origins ------------------------------------------------------------------------------------
def training_stats(daily: DataFrame, origins: Sequence[str]) -> DataFrame:
    """Sum and count of rates per (store, by, key) before each origin (month starts).

    Months are summed once and accumulated, instead of repeating every day for every later origin.
    """
    month = F.year("date") * 12 + F.month("date")
    monthly = by_key(daily).withColumn("m", month).groupBy("store", "by", "key", "m").agg(
        F.sum("rate").alias("s"), F.count("*").alias("n"))
    starts = F.explode(F.array(*[F.lit(str(o)[:10]).cast("date") for o in origins]))
    probes = monthly.select("store", "by", "key").distinct().withColumn("origin", starts).withColumn(
        "m", F.year("origin") * 12 + F.month("origin"))
    w = Window.partitionBy("store", "by", "key").orderBy("m").rangeBetween(Window.unboundedPreceding, -1)
    return (probes.unionByName(monthly, allowMissingColumns=True)
            .withColumn("S", F.sum("s").over(w)).withColumn("N", F.sum("n").over(w))
            .where("origin is not null and N > 0").select("store", "by", "key", "origin", F.col("S").alias("s"), F.col("N").alias("n")))


def rolling_origins(daily: DataFrame, origins: Sequence[str], holidays: Sequence[str] = V.HOLIDAYS_2026,
                    min_products: int = V.MIN_PRODUCTS, min_train: int = V.MIN_TRAIN_DAYS,
                    min_test: int = V.MIN_TEST_DAYS, shrink: float = V.SHRINK_STRENGTH,
                    gate: DataFrame | None = None) -> DataFrame:
    """Scores every rule on the month after each origin, chosen on earlier data only.

    One plan for all stores, origins and methods. ``gate`` (store, date, gate) adds a learned mask.
    """
    daily = settle(daily.where(F.col("products") >= min_products), "daily")   # one row per store and day, read three times
    stats = training_stats(daily, origins).withColumn("rate", ratio("s", "n"))
    pooled = (stats.where("by = 'dom'").groupBy("origin", "key").agg(ratio(F.sum("s"), F.sum("n")).alias("pooled")))
    level = pooled.groupBy("origin").agg(F.avg("pooled").alias("level"))
    stats = (stats.join(pooled, ["origin", "key"], "left").join(level, "origin", "left")
             .withColumn("shrunk", (F.col("s") + shrink * F.coalesce("pooled", "level")) / (F.col("n") + shrink)))
    stats = _ranked(_ranked(stats, ["store", "by", "origin"], "rate", "rank"), ["store", "by", "origin"], "shrunk", "rank_shrunk")
    trained = stats.where("by = 'dow'").groupBy("store", "origin").agg(F.sum("n").alias("train_days"))
    dom = stats.where("by = 'dom'").select("store", "origin", F.col("key").alias("dom"), F.col("rank").alias("r_dom"), "rank_shrunk")
    dow = stats.where("by = 'dow'").select("store", "origin", F.col("key").alias("dow"), F.col("rank").alias("r_dow"))
    pool = _ranked(pooled, ["origin"], "pooled", "r_pool").select("origin", F.col("key").alias("dom"), "r_pool")
    months = F.array(*[F.lit(str(o)[:10]).cast("date") for o in origins])
    test = (daily.withColumn("origin", F.trunc("date", "month").cast("date")).where(F.array_contains(months, F.col("origin")))
            .join(dom, ["store", "origin", "dom"], "left").join(dow, ["store", "origin", "dow"], "left")
            .join(pool, ["origin", "dom"], "left").join(trained, ["store", "origin"]))
    masks = fixed_masks("date", holidays)
    masks |= {f"dom_top{k}": F.col("r_dom") <= k for k in (2, 4, 6)}
    masks |= {"dom_top4_shrunk": F.col("rank_shrunk") <= 4, "pooled_dom_top4": F.col("r_pool") <= 4}
    masks |= {f"dow_top{k}": F.col("r_dow") <= k for k in (1, 2)}
    masks["dom_top2+dow_top1"] = (F.coalesce(F.col("r_dom"), F.lit(99)) <= 2) | (F.col("r_dow") <= 1)
    if gate is not None:
        test = test.join(gate, ["store", "date"], "left")
        masks["learned_gate"] = F.col("gate")
    whole = ("changes", "err")
    wide = test.groupBy("store", "origin").agg(
        F.first("train_days").alias("train_days"), F.count("*").alias("days"), *[F.sum(c).alias(c) for c in whole],
        *([F.count("gate").alias("_gated")] if gate is not None else []),
        *[x for i, m in enumerate(masks.values()) for x in (
            F.count_if(m).alias(f"d{i}"), F.sum(F.when(m, F.col("changes")).otherwise(0)).alias(f"c{i}"),
            F.sum(F.when(m, F.col("err")).otherwise(0.0)).alias(f"e{i}"))])
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("method"), F.col(f"d{i}").alias("sel_days"), F.col(f"c{i}").alias("sel_changes"), F.col(f"e{i}").alias("sel_err"))
        for i, name in enumerate(masks)]))
    out = wide.where((F.col("train_days") >= min_train) & (F.col("days") >= min_test)).withColumn("_r", rows)
    if gate is not None:
        out = out.where("_r.method <> 'learned_gate' or _gated = days")
    return out.select("store", F.date_format("origin", "yyyy-MM").alias("origin"), "_r.method", "days", "_r.sel_days",
                      "changes", "_r.sel_changes", "err", "_r.sel_err")


def store_best(results: DataFrame, candidates: Sequence[str] = V.STORE_BEST_CANDIDATES,
               default: str = V.STORE_BEST_DEFAULT) -> DataFrame:
    """Adds 'store_best': the candidate with the largest excess capture on the store's earlier origins."""
    past = Window.partitionBy("store", "method").orderBy("origin").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.sum(c).over(past)
    results = settle(results, "origins")
    excess = ratio(total("sel_changes"), F.greatest(total("changes"), F.lit(1))) - ratio(total("sel_days"), total("days"))
    place = (F.when(F.col("_x").isNotNull(), F.struct(-F.col("_x"), F.col("method")))
             .when(F.col("method") == default, F.struct(F.lit(float("inf")), F.col("method"))))
    values = ("days", "sel_days", "changes", "sel_changes", "err", "sel_err")
    picked = (results.where(F.col("method").isin(*candidates)).withColumn("_x", excess)
              .groupBy("store", "origin").agg(F.min_by(F.struct("method", *values), place).alias("_p"))
              .select("store", "origin", F.lit("store_best").alias("method"), *[F.col("_p")[v].alias(v) for v in values],
                      F.col("_p.method").alias("picked")))
    return results.withColumn("picked", F.lit(None).cast("string")).unionByName(picked)


def summarise(results: DataFrame) -> DataFrame:
    values = ("days", "sel_days", "changes", "sel_changes", "err", "sel_err")
    return (results.groupBy("store", "method").agg(
        *[F.sum(v).alias(v) for v in values], F.count("*").alias("origins"),
        F.min(ratio("sel_changes", F.nullif(F.col("changes"), F.lit(0)))).alias("capture_min_month"))
        .withColumn("day_share", ratio("sel_days", "days")).withColumn("change_capture", ratio("sel_changes", "changes"))
        .withColumn("err_capture", ratio("sel_err", "err")).withColumn("lift", ratio("change_capture", "day_share")))


def causal_day_features(daily: DataFrame, holidays: Sequence[str] = V.HOLIDAYS_2026) -> DataFrame:
    """Day-level features known before the day starts."""
    store = Window.partitionBy("store").orderBy("date")
    past = (Window.unboundedPreceding, -1)
    out = daily
    for key in ("dom", "dow"):
        w = Window.partitionBy("store", key).orderBy("date")
        out = (out.withColumn(f"hist_{key}", F.avg("rate").over(w.rowsBetween(*past)))
               .withColumn(f"hist_{key}_n", (F.row_number().over(w) - 1).cast("bigint")))
    out = (out.withColumn("store_mean", F.avg("rate").over(store.rowsBetween(*past)))
           .withColumn("hist_dom_rel", ratio("hist_dom", "store_mean")).withColumn("hist_dow_rel", ratio("hist_dow", "store_mean"))
           .withColumn("rate_lag1", F.when(F.datediff("date", F.lag("date").over(store)) == 1, F.lag("rate").over(store)))
           .withColumn("rate_7d", F.avg("rate").over(store.rowsBetween(-7, -1))))
    return (out.withColumn("is_holiday", K.is_holiday("date", holidays).cast("int"))
            .withColumn("days_to_month_end", K.days_to_month_end("date")))


def shifted_rate(daily: DataFrame, days: int = 1) -> DataFrame:
    """Rate of the day ``days`` calendar days earlier; null when that day was not observed."""
    earlier = daily.select("store", F.date_add("date", days).alias("date"), F.col("rate").alias(f"rate_lag{days}"))
    return daily.join(earlier, ["store", "date"], "left")


def bootstrap_day_rates(daily: DataFrame, reps: int = V.BOOTSTRAP_REPS, seed: int = V.SEED,
                        min_products: int = V.MIN_PRODUCTS) -> DataFrame:
    """Mean rate per store and day of month with a 90 % bootstrap interval over dates.

    A group is one day of month of one store, at most one date per month, so its rates fit one row. Resampling
    runs inside that row with hashed draws; nothing is multiplied through a shuffle.
    """
    groups = (daily.where(F.col("products") >= min_products).groupBy("store", "dom").agg(
        F.count("*").alias("n_dates"), F.avg("rate").alias("rate"),
        F.transform(F.array_sort(F.collect_list(F.struct("date", "rate"))), lambda x: x["rate"]).alias("_r")))
    n = F.size("_r")

    def drawn(rep: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in (rep, i, F.col("store"), F.col("dom"))]))
        return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n.cast("long")).cast("int")

    def mean_of_draw(rep: Column) -> Column:
        draw = F.transform("_r", lambda _, i: F.get(F.col("_r"), drawn(rep, i)))
        return F.aggregate(draw, F.lit(0.0), lambda a, x: a + x) / n

    sample = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(reps)), mean_of_draw))

    def at(q: float) -> Column:
        pos = q * (reps - 1)
        lo, frac = int(pos), pos - int(pos)
        return F.col("_s")[lo] + frac * (F.col("_s")[min(lo + 1, reps - 1)] - F.col("_s")[lo])

    return groups.withColumn("_s", sample).select("store", "dom", "n_dates", "rate", at(0.05).alias("lo"), at(0.95).alias("hi"))


# --- long horizon -------------------------------------------------------------------------------------------
def rank_keys(train: DataFrame) -> DataFrame:
    """Keys of the families 'dow', 'dom' and 'mix' (both) by mean training rate, best first."""
    rates = by_key(train).groupBy("store", "by", "key").agg(F.avg("rate").alias("rate"))
    fam = rates.withColumn("family", F.explode(F.array(F.col("by"), F.lit("mix"))))
    w = Window.partitionBy("store", "family").orderBy(F.round("rate", 12).desc(), F.col("by").desc(), "key")
    return fam.withColumn("rank", F.row_number().over(w))


def rule_label(by: Column, key: Column) -> Column:
    names = F.array(*[F.lit(n) for n in V.WEEKDAY_LABELS])
    return F.when(by == "dom", key.cast("string")).otherwise(F.get(names, key))


def rules_as_arrays(ranked: DataFrame) -> DataFrame:
    """One row per (store, family): the ranked keys as an array of at most 38 entries."""
    return ranked.groupBy("store", "family").agg(
        F.array_sort(F.collect_list(F.struct("rank", "by", "key"))).alias("keys"))


def label(keys: Column) -> Column:
    return F.array_join(F.transform(keys, lambda k: rule_label(k["by"], k["key"])), ", ")


def on_rule(keys: Column, dom: Column, dow: Column) -> Column:
    return F.exists(keys, lambda k: ((k["by"] == "dom") & (k["key"] == dom)) | ((k["by"] == "dow") & (k["key"] == dow)))


def within_budget(train: DataFrame, budgets: Sequence[float], slack: float = 0.0) -> DataFrame:
    """Greedy rule per (store, family, budget): keys in rank order, skipping those that exceed the day share.

    Folds over at most 38 keys against at most 217 (day of month, weekday) cells, all inside one row.
    """
    cells = train.groupBy("store", "dom", "dow").agg(F.count("*").alias("n"))
    table = cells.groupBy("store").agg(F.collect_list(F.struct("dom", "dow", "n")).alias("cells"), F.sum("n").alias("total"))
    ruled = (rules_as_arrays(rank_keys(train)).join(table, "store")
             .withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets]))))

    def step(sel: Column, k: Column) -> Column:
        bigger = F.concat(sel, F.array(k))
        days = F.aggregate(F.filter("cells", lambda c: on_rule(bigger, c["dom"], c["dow"])), F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
        return F.when(days / F.col("total") > F.col("budget") + slack, sel).otherwise(bigger)

    none = F.filter("keys", lambda k: F.lit(False))
    return ruled.withColumn("rule", F.aggregate("keys", none, step)).select("store", "family", "budget", "rule")


def score_rules(days: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Coverage of array-valued rules (column ``rule``) on the days of their store."""
    joined = days.join(rules, "store").withColumn("_on", on_rule(F.col("rule"), F.col("dom"), F.col("dow")))
    return coverage(joined, F.col("_on"), keys)


def weekly_vs_monthly(train: DataFrame, test: DataFrame, budgets=V.WEEKLY_MONTHLY_BUDGETS) -> DataFrame:
    arrays = rules_as_arrays(rank_keys(train))
    pair = (arrays.where("family = 'dow'").select("store", F.col("keys").alias("w"))
            .join(arrays.where("family = 'dom'").select("store", F.col("keys").alias("m")), "store")
            .withColumn("b", F.explode(F.array(*[F.struct(F.lit(a).alias("kw"), F.lit(b).alias("km")) for a, b in budgets])))
            .select("store", "b.kw", F.slice("w", 1, F.col("b.kw")).alias("w"), F.slice("m", 1, F.col("b.km")).alias("m")))
    scored = {}
    for name, c in (("weekly", "w"), ("monthly", "m")):
        s = score_rules(test, pair.select("store", "kw", F.col(c).alias("rule")), ["store", "kw"])
        scored[name] = s.select("store", "kw", *[F.col(x).alias(f"{name}_{x}") for x in ("chg", "tl", "days")])
    labels = pair.select("store", "kw", F.round(F.col("kw") * 30.4 / 7).cast("int").alias("days_per_month"),
                         label(F.col("w")).alias("weekly_rule"), label(F.col("m")).alias("monthly_rule"))
    return labels.join(scored["weekly"], ["store", "kw"]).join(scored["monthly"], ["store", "kw"]).drop("kw")


def family_table(train: DataFrame, test: DataFrame, budgets=V.FAMILY_BUDGETS, slack: float = V.BUDGET_SLACK) -> DataFrame:
    rules = within_budget(train, budgets, slack)
    scored = score_rules(test, rules, ["store", "family", "budget"])
    return rules.select("store", "family", F.col("budget").alias("train_budget"), label(F.col("rule")).alias("rule")).join(
        scored.withColumnRenamed("budget", "train_budget"), ["store", "family", "train_budget"])


def weekday_curve(daily: DataFrame, train: DataFrame, test: DataFrame, months: Sequence[str]) -> DataFrame:
    """Coverage as weekdays are added in rank order: training, test, and month by month as columns."""
    week = rules_as_arrays(rank_keys(train)).where("family = 'dow'")
    rules = (week.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("keys"))))
             .select("store", "k", F.slice("keys", 1, F.col("k")).alias("rule")))
    tr = score_rules(train, rules, ["store", "k"]).select("store", "k", F.col("chg").alias("train_chg"))
    te = score_rules(test, rules, ["store", "k"]).select("store", "k", *[F.col(c).alias(f"test_{c}") for c in ("chg", "tl", "days")])
    by_month = (daily.withColumn("month", K.month_text("date")).join(rules, "store")
                .withColumn("_on", on_rule(F.col("rule"), F.col("dom"), F.col("dow")))
                .groupBy("store", "k").pivot("month", list(months)).agg(
                    ratio(F.sum(F.when(F.col("_on"), F.col("changes")).otherwise(0)), F.sum("changes"))))
    by_month = by_month.select("store", "k", *[F.col(m).alias(f"cov_{m}") for m in months])
    head = rules.select("store", "k", label(F.col("rule")).alias("rule"), F.round(F.col("k") * 30.4 / 7, 1).alias("days_per_month"))
    return head.join(tr, ["store", "k"]).join(te, ["store", "k"]).join(by_month, ["store", "k"]).drop("k")


def trigger_signals(daily: DataFrame) -> DataFrame:
    """Per store and day: yesterday's own rate and the mean rate of every other store yesterday."""
    per_day = daily.groupBy("date").agg(F.sum("rate").alias("s"), F.count("rate").alias("n"))
    own = daily.select("store", F.date_add("date", 1).alias("date"), F.col("rate").alias("own"))
    stores = daily.select("store").distinct()
    shifted = per_day.select(F.date_add("date", 1).alias("date"), "s", "n")
    days = daily.select("store", "date").distinct()
    return (days.join(own, ["store", "date"], "left").join(shifted, "date", "left")
            .withColumn("competitors", ratio(F.col("s") - F.coalesce("own", F.lit(0.0)), F.col("n") - F.col("own").isNotNull().cast("int")))
            .select("store", "date", "own", "competitors"))


def trigger_table(daily: DataFrame, train: DataFrame, test: DataFrame, budget: float = V.TRIGGER_BUDGET,
                  quantile: float = V.TRIGGER_QUANTILE) -> DataFrame:
    """Calendar rule, triggers and their unions, scored on the test days."""
    signals = trigger_signals(daily)
    limits = train.select("store", "date").join(signals, ["store", "date"]).groupBy("store").agg(
        F.percentile("own", quantile).alias("_o"), F.percentile("competitors", quantile).alias("_c"))  # one value per day
    rules = within_budget(train, [budget]).where("family = 'mix'").select("store", "rule")
    t = (test.join(signals, ["store", "date"], "left").join(limits, "store").join(rules, "store")
         .withColumn("cal", on_rule(F.col("rule"), F.col("dom"), F.col("dow")))
         .withColumn("own_t", F.coalesce(F.col("own") > F.col("_o"), F.lit(False)))
         .withColumn("comp_t", F.coalesce(F.col("competitors") > F.col("_c"), F.lit(False))))
    policies = {"calendar": F.col("cal"), "own trigger": F.col("own_t"), "calendar + own trigger": F.col("cal") | F.col("own_t"),
                "competitors trigger": F.col("comp_t"), "calendar + competitors trigger": F.col("cal") | F.col("comp_t")}
    pick = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), m.alias("on")) for n, m in policies.items()]))
    return coverage(t.withColumn("_p", pick).withColumn("policy", F.col("_p.policy")), F.col("_p.on"), ["store", "policy"])


# --- change calendars ---------------------------------------------------------------------------------------
def day_kind(date: str = "date", holidays: Sequence[str] = V.HOLIDAYS_2026) -> Column:
    d = K.dom(date)
    return F.when(d.isin(1, 14, 15, 16), d.cast("string")).when(K.is_holiday(date, holidays), "holiday").otherwise("other")


def change_calendar(daily: DataFrame, holidays: Sequence[str] = V.HOLIDAYS_2026) -> dict[str, DataFrame]:
    """Changes per month and day kind, per day of month, and on target days against other days."""
    d = daily.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("changes", "products", "err")])
    d = d.withColumn("kind", day_kind("date", holidays)).withColumn("month", K.month_text("date")).withColumn(
        "target", K.is_target_data("date", holidays)).withColumn("dom", K.dom("date"))
    kinds = ["1", "14", "15", "16", "holiday", "other"]
    months = (d.groupBy("month").pivot("kind", kinds).agg(F.sum("changes"))
              .join(d.groupBy("month").agg(F.count_if(F.col("kind") == "other").alias("other_days")), "month")
              .withColumn("other", F.coalesce("other", F.lit(0))))
    return {"months": months,
            "by_dom": d.groupBy("dom").agg(F.sum("changes").alias("changes"), F.sum("products").alias("products")),
            "totals": d.groupBy("target").agg(F.count("*").alias("days"), F.sum("changes").alias("changes"), F.sum("err").alias("err"))}


def store_calendars(daily: DataFrame, min_days: int = V.MIN_STORE_DAYS, holidays: Sequence[str] = V.HOLIDAYS_2026) -> DataFrame:
    """One nested row per store with enough days: spans, per-key tables, target-day split."""
    d = daily.withColumn("target", K.is_target_data("date", holidays))
    split = [x for flag, tag in ((True, "target"), (False, "other")) for x in (
        F.count_if(F.col("target") == flag).alias(f"{tag}_days"),
        F.coalesce(F.sum(F.when(F.col("target") == flag, F.col("changes"))), F.lit(0)).alias(f"{tag}_changes"),
        F.round(F.coalesce(F.sum(F.when(F.col("target") == flag, F.col("err"))), F.lit(0.0)), 2).alias(f"{tag}_err"))]
    head = d.groupBy("store").agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"),
                                  F.median("products").cast("int").alias("products_median"), *split).where(F.col("days") >= min_days)
    tables = (by_key(d).groupBy("store", "by", "key").agg(
        F.sum("changes").alias("changes"), F.sum("products").alias("products"), F.count("*").alias("days"))
        .groupBy("store").agg(*[F.array_sort(F.collect_list(F.when(F.col("by") == b, F.struct("key", "changes", "products", "days")))).alias(out)
                                for b, out in (("dom", "by_day_of_month"), ("dow", "by_weekday"))]))
    return head.join(tables, "store")


def rule_tiles(calendars: DataFrame) -> DataFrame:
    """Shares of days, changes and error on target days, lift, and changes per day."""
    share = lambda c: ratio(f"target_{c}", F.col(f"target_{c}") + F.col(f"other_{c}"))
    return (calendars.select("store", share("days").alias("days_share"), share("changes").alias("changes_share"), share("err").alias("err_share"),
                             ratio("target_changes", "target_days").alias("per_target_day"), ratio("other_changes", "other_days").alias("per_other_day"))
            .withColumn("lift", ratio("changes_share", "days_share")))


def weekday_shares(daily: DataFrame) -> DataFrame:
    g = daily.groupBy("store", "dow").agg(F.sum("changes").alias("c"), F.count("*").alias("d"), F.sum("products").alias("p"))
    w = Window.partitionBy("store")
    return g.select("store", "dow", (100 * ratio("c", F.sum("c").over(w))).alias("changes_pct"),
                    (100 * ratio("d", F.sum("d").over(w))).alias("days_pct"), (100 * ratio("c", "p")).alias("rate_pct"))


def busiest_keys(daily: DataFrame) -> DataFrame:
    """Key with the highest change rate per store and family; the two busiest weekdays and their joint share."""
    g = by_key(daily).groupBy("store", "by", "key").agg(F.sum("changes").alias("c"), F.sum("products").alias("p"))
    top = g.groupBy("store").agg(*[F.min_by(F.when(F.col("by") == b, F.col("key")), F.when(F.col("by") == b, F.struct(-ratio("c", "p"), F.col("key")))).alias(f"top_{b}") for b in ("dom", "dow")])
    two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("nc"), "key"))), 1, 2)
    pair = g.where("by = 'dow'").groupBy("store").agg(two.alias("t"), F.sum("c").alias("all"))
    return top.join(pair.select("store", F.col("t")[0]["key"].alias("first_dow"), F.get("t", F.lit(1))["key"].alias("second_dow"),
                                (-100 * ratio(F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["nc"]), "all")).alias("top2_share_pct")), "store")
