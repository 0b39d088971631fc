"""Worked examples and properties of the operators."""
import datetime as dt
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfline.functions import prices as P, text as T
from shelfline.operators import evaluation as E, grid as G, matching as M, rules as R, sales as S

D0 = dt.date(2026, 3, 1)


def cells(spark, series, days=None):
    rows = [("x", n, D0 + dt.timedelta(days=d), float(p)) for n, (ds, ps) in series.items() for d, p in zip(ds, ps)]
    return spark.createDataFrame(rows, "store string, name string, date date, price double")


def flags(df, col):
    return [r[col] for r in df.orderBy("name", "date").collect()]


def test_v_shaped_sale(spark):
    out = S.flag_sales(cells(spark, {"a": (range(10), [10, 10, 8, 8, 10, 10, 12, 12, 12, 12])}))
    assert flags(out, "is_sale") == [False, False, True, True] + [False] * 6


def test_drop_at_the_end_is_unresolved(spark):
    out = S.flag_sales(cells(spark, {"a": (range(10), [10] * 8 + [8, 8])}))
    assert flags(out, "unresolved") == [False] * 8 + [True, True] and not any(flags(out, "is_sale"))


def test_gap_blocks_a_return(spark):
    assert not any(flags(S.flag_sales(cells(spark, {"a": ([0, 1, 30, 31], [10, 8, 8, 10])})), "is_sale"))


def test_sale_day_is_not_a_change(spark):
    out = S.count_changes(S.regular_prices(cells(spark, {"a": (range(6), [10, 10, 8, 10, 11, 11])})))
    assert flags(out, "changed") == [False, False, False, True, False]


def walk(days, prices, window=35, resolve=21, gap=7, tol=0.005):
    """Brute-force restatement: every drop against the previous price looks for its own return."""
    n, sale = len(days), [False] * len(days)
    start = None
    for i in range(1, n):
        if days[i] - days[i - 1] > gap or not prices[i] < prices[i - 1] * (1 - tol):
            continue
        end, broke = None, False
        for j in range(i + 1, n):
            broke = broke or days[j] - days[j - 1] > gap
            if not broke and days[j] - days[i] <= window and prices[j] >= prices[i - 1] * (1 - tol):
                end = j
                break
        for k in range(i, end or i):
            sale[k] = True
        if end is None and not broke and days[-1] - days[i] < resolve and start is None:
            start = i
    return sale, [start is not None and k >= start for k in range(n)]


def test_sale_filter_matches_brute_force(spark):
    rng = random.Random(3)
    series = {}
    for n in range(40):
        days = sorted(rng.sample(range(70), 30))
        series[f"s{n:02d}"] = (days, [rng.choice([8, 9, 10, 10, 11]) for _ in days])
    out = S.flag_sales(cells(spark, series))
    want = [walk(*series[n]) for n in sorted(series)]
    assert flags(out, "is_sale") == list(itertools.chain.from_iterable(w[0] for w in want))
    assert flags(out, "unresolved") == list(itertools.chain.from_iterable(w[1] for w in want))


def test_rule_ignores_data_after_the_cutoff(spark):
    days = pd.date_range("2026-03-01", "2026-04-30")
    rows = [("x", d.date(), 0.0 if str(d.date()) == "2026-04-01" else 0.1 if d.day == 1 else 0.01, d.day) for d in days]
    daily = spark.createDataFrame(rows, "store string, date date, rate double, dom int")
    keys = R.top_keys(daily, "2026-03-31", 1)
    assert [r.key for r in keys.collect()] == [1]
    on = R.rule_mask(daily.where("date between '2026-04-01' and '2026-04-02'"), keys).orderBy("date").collect()
    assert [r.on for r in on] == [True, False]


PACKS = {"Coca Cola 4*1 Lt": (4, 1000.0, "ml"), "Soft 5000 Ml": (None, 5000.0, "ml"), "Soft 5 Lt": (None, 5000.0, "ml"),
         "Bulaşık Süngeri 5'li": (5, None, None), "Sünger Oluklu 5 Adet": (5, None, None), "Ezine Peyn - 500 Gr.": (None, 500.0, "g"),
         "Toz Deterjan 4,5 ...": (None, None, None), "Ton Balık 3*75 Gr": (3, 75.0, "g"), "Toz Deterjan 4,5 Kg": (None, 4500.0, "g")}


def test_pack_parsing_and_same_pack(spark):
    df = spark.createDataFrame([(n,) for n in PACKS], "name string")
    got = {r.name: tuple(r.pack) for r in df.select("name", T.parse_pack("name").alias("pack")).collect()}
    assert got == PACKS
    pairs = [("Soft 5000 Ml", "Soft 5 Lt", True), ("Bulaşık Süngeri 5'li", "Sünger Oluklu 5 Adet", True), ("Ton Balık 3*75 Gr", "Coca Cola 4*1 Lt", False),
             ("Toz Deterjan 4,5 ...", "Toz Deterjan 4,5 Kg", True), ("Soft 5 Lt", "Toz Deterjan 4,5 Kg", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    out = df.select("want", T.same_pack(T.parse_pack("a"), P.is_truncated("a"), T.parse_pack("b"), P.is_truncated("b")).alias("got"))
    assert all(r.want == r.got for r in out.collect())


def test_price_text(spark):
    texts = {"₺295,00": 295.0, "2.499,00 TL": 2499.0, "34,99 ₺": 34.99, "74.95": 74.95, "(124,90 / Kg)": 124.9, "yok": None, "1.2.3": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.p for r in df.select("t", P.parse_price("t").alias("p")).collect()} == texts


def test_fold_and_normalize(spark):
    df = spark.createDataFrame([("İÇECEK  Işık ﬁne",), ("Su 1,5 LT.",), ("Çay 500 Gr",)], "t string")
    got = [tuple(r) for r in df.select(T.fold("t"), T.normalize("t")).collect()]
    assert got == [("icecek isik fine", "icecek isik fine"), ("su 1,5 lt.", "su 1.5l"), ("cay 500 gr", "cay 500g")]


def lcs(a, b):
    best = {(-1, -1): 0}
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_common_subsequence_matches_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert T.common_subsequence(a, b) == lcs(a, b)


def test_token_guard(spark):
    rows = [("cilekli sut", "cikolatali sut", False), ("meysu nektar", "dimes nektar", False), ("sut tam yagli", "pinar sut tam yagli", True),
            ("kek portakalli", "kek portakal", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    out = df.select("want", T.token_guard("a", "b").alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def best_assignment(edges):
    best = (0, 0.0)
    for size in range(len(edges), 0, -1):
        for pick in itertools.combinations(edges, size):
            if len({e[0] for e in pick}) == size and len({e[1] for e in pick}) == size:
                best = max(best, (size, round(sum(e[2] for e in pick), 9)))
        if best[0]:
            return best
    return best


def test_assignment_is_optimal():
    rng = random.Random(5)
    for _ in range(60):
        edges = sorted({(f"g{rng.randint(0, 3)}", f"i{rng.randint(0, 3)}") for _ in range(7)})
        edges = [(g, i, round(rng.random(), 3)) for g, i in edges]
        got = M._assign(pd.DataFrame(edges, columns=["group", "series_id", "score"]))
        assert got["group"].is_unique and got["series_id"].is_unique
        assert (len(got), round(got["score"].sum(), 9)) == best_assignment(edges)


def test_large_components_are_solved(spark):
    """A chain of 71 groups and 70 IDs, and a dense component, larger than any size that was a limit."""
    chain = [(f"g{k:03d}", f"i{k + d:03d}", 0.5 + 0.4 * d, 3) for k in range(71) for d in (-1, 0) if 0 <= k + d < 70]
    out = M.assign_links(spark.createDataFrame(chain, "group string, series_id string, score double, gap_days int")).collect()
    assert len(out) == 70 and len({r.group for r in out}) == len({r.series_id for r in out}) == 70
    rng = random.Random(2)
    edges = pd.DataFrame([(f"g{g}", f"i{i}", rng.random()) for g in range(250) for i in rng.sample(range(260), 12)], columns=["group", "series_id", "score"])
    got = M._assign(edges)
    assert len(got) >= 248 and got["group"].is_unique and got["series_id"].is_unique


def test_one_name_per_day_equals_the_greedy_order(spark):
    rng = random.Random(9)
    names = [(f"n{i}", "s%d" % (i % 3), rng.choice(["1_exact", "3c_normalized", "6_own_series"])) for i in range(18)]
    days = {n: sorted(rng.sample(range(12), rng.randint(1, 4))) for n, _, _ in names}
    pre = spark.createDataFrame([(n, D0 + dt.timedelta(days=d)) for n in days for d in days[n]], "name string, date date")
    out = M.one_name_per_day(spark.createDataFrame(names, "name string, series_id string, method string"), pre).collect()
    from shelfline.fixed_values import METHOD_RANK
    want = set()
    for s in {s for _, s, _ in names}:
        taken = set()
        for n, _, m in sorted((x for x in names if x[1] == s), key=lambda x: (METHOD_RANK[x[2]], -len(days[x[0]]), x[0])):
            if taken & set(days[n]):
                want.add(n)
            else:
                taken |= set(days[n])
    assert {r.name for r in out if "demoted" in r.method} == want


def test_exact_quantiles_on_a_skewed_group(spark):
    from shelfline.common import exact_quantiles
    df = spark.range(60000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("v"))
    got = {r.k: (r.a, r.b) for r in exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    want = df.toPandas().groupby("k")["v"].quantile([0.5, 0.9]).unstack()
    for k in ("hot", "cold"):
        assert got[k] == pytest.approx((want.loc[k, 0.5], want.loc[k, 0.9]), abs=1e-12)


def test_student_p(spark):
    df = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0), (-12.706205, 1.0)], "t double, n double")
    assert [round(r[0], 5) for r in df.select(E.student_p("t", "n")).collect()] == [0.07339, 1.0, 0.05]


def test_change_points_round_trip(spark):
    df = cells(spark, {"a": (range(8), [1, 1, 2, 2, 2, 3, 1, 1]), "b": (range(8), [5] * 8)}).withColumnRenamed("price", "v")
    points = E.change_points(df, ["store", "name"], "v")
    back = E.expand_points(points, ["store", "name"], "v", F.lit(D0 + dt.timedelta(days=7)))
    assert points.count() == 5 and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select("store", "name", "date", "v").collect()))


def test_perfect_forecast_has_no_error(spark):
    df = cells(spark, {"a": (range(6), [10, 11, 12, 11, 13, 14])}).withColumnRenamed("price", "target_price").withColumn("base_price", F.lit(10.0))
    r = E.price_metrics(df.withColumn("pred_price", F.col("target_price")), ["store"]).first()
    assert r.mae == 0 and r.r2_price == 1.0 and r.da_pct == 100.0


def test_hurdle_beats_persistence_on_a_planted_signal(spark):
    from shelfline.operators import models
    rows, price = [], {}
    for d, s in itertools.product(range(120), range(30)):
        day = D0 + dt.timedelta(days=d)
        base = price.get(s, 100.0)
        price[s] = base * (1.1 if day.day == 1 else 1.0)
        rows.append((f"s{s}", day, base, price[s], float(day.day), day.day == 1))
    df = spark.createDataFrame(rows, "segment_id string, date date, base_price double, target_price double, dom double, is_target_spec boolean")
    df = (df.withColumn("is_target_data", F.col("is_target_spec")).withColumn("target_pct_change", F.col("target_price") / F.col("base_price") - 1)
          .withColumn("usable_target", F.lit(True)).withColumn("in_outage", F.lit(False)))
    block = {"train_start": "2026-03-01", "train_end": "2026-05-15", "test_start": "2026-05-16", "test_end": "2026-06-28"}
    _, pred, _ = models.forecast("hurdle", {"max_iter": 3, "max_depth": 2, "min_trees": 2, "min_rows": 1}, df, block, ["dom"])
    r = pred.agg(F.avg(F.abs(F.col("pred_price") - F.col("target_price"))).alias("m"), F.avg(F.abs(F.col("base_price") - F.col("target_price"))).alias("b")).first()
    assert r.m < r.b


def test_loader_keeps_short_lines_and_odd_paths(spark, tmp_path):
    from shelfline.sources import files
    shop = tmp_path / "shop a+b"
    shop.mkdir()
    (shop / "y z_2026-01-04.csv").write_text('name,price,kategori\nBread,2.5\n"Milk, fresh",3,x\nEggs,4,x,too,long\n\n', encoding="utf-8")
    (shop / "2026-01-05.csv").write_text("Tea,1.5\nSugar,2\n", encoding="utf-8")
    (shop / "2026-01-06.csv").write_text("what,ever,else\n1,2,3\n", encoding="utf-8")
    (shop / "undated.csv").write_text("name,price\nSalt,1\n", encoding="utf-8")
    (shop / "2026-01-07.csv").write_text("\n\n", encoding="utf-8")
    rows, aside = files.read_price_files(spark, [str(tmp_path)])
    got = sorted((r.store, str(r.date), r.name_raw, r.price_text, r.category) for r in rows.collect())
    assert got == [("shop a+b", "2026-01-04", "Bread", "2.5", None), ("shop a+b", "2026-01-04", "Milk, fresh", "3", "x"),
                   ("shop a+b", "2026-01-05", "Sugar", "2", None), ("shop a+b", "2026-01-05", "Tea", "1.5", None)]
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in aside.collect()) == [
        ("2026-01-06.csv", "no name or price column"), ("2026-01-07.csv", "no line to read"), ("undated.csv", "no date in the file name")]
