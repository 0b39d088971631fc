"""Work of the linking queries that must not grow with rows, components or reads."""
import random

import pandas as pd

from shelfline.operators import matching as M
from shelfline.plans import datasets, listings as L, matching_queries as Q

SF = "/root/testdata/sf0.001"


def test_names_are_made_once_per_part(spark):
    tree = Q.kept(spark, SF).select("name")._jdf.queryExecution().executedPlan().toString()
    joined = tree[tree.index("Join"):]
    assert "concat_ws" in joined and "concat_ws" not in tree[:tree.index("Join")]
    assert "concat_ws" not in joined[:joined.index("\n")]            # nor in the condition of the join


def test_parts_without_a_rule_keep_their_name(spark):
    rows = [(-13, "hot gear", "B", None, 3, 1.0), (20, "hot gear", "B", None, None, 1.0), (12, "hot gear", "B", "T", 3, 1.0)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    got = {r.p_partkey: (r.full, r.early) for r in L.part_names(part).collect()}
    assert got == {-13: ("hot gear B 3 Gr", None), 20: ("hot gear B", "HOT GEAR B"), 12: ("hot gear B T 3 Gr", "hot gear B ...")}


def test_components_run_on_over_batches():
    rng = random.Random(5)
    rows = [(f"c{c:02}", f"g{c}-{rng.randrange(4)}", f"s{c}-{rng.randrange(4)}", round(rng.random(), 3)) for c in range(30) for _ in range(rng.choice([1, 2, 9]))]
    t = pd.DataFrame(sorted({r[:3]: r for r in rows}.values()), columns=["component", "group", "series_id", "score"])
    alone = pd.concat([M._assign(p.drop(columns="component")) for _, p in t.groupby("component")])
    for step in (1, 2, 7, len(t)):
        got = pd.concat(M._assign_sorted(iter([t.iloc[:0]] + [t.iloc[i:i + step] for i in range(0, len(t), step)])))
        assert got.drop(columns="component").values.tolist() == alone.values.tolist()
    assert list(M._assign_sorted(iter([t.iloc[:0]]))) == []


def test_links_of_many_components_take_few_calls(spark, monkeypatch):
    rows, settle, seen = [(f"g{i:03}", f"s{i:03}", 0.5, 3) for i in range(300)], M.settle, {}
    monkeypatch.setattr(M, "settle", lambda df, label: seen.update({label: df}) or settle(df, label))
    assert M.assign_links(spark.createDataFrame(rows, "group string, series_id string, score double, gap_days int")).count() == 300
    plan = seen["assigned"]._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_the_mapped_panel_reads_the_rows_once(spark, monkeypatch):
    read = []
    monkeypatch.setattr(L, "table", lambda s, d, name: read.append(name) or datasets.table(s, d, name))
    from shelfline.plans import all_queries
    assert all_queries()["l9_panel_fully_mapped"](spark, SF).collect()[0].unmapped == 0
    assert read.count("lineitem") == 1


def test_days_are_reduced_before_they_are_collected(spark):
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    rows = spark.createDataFrame([("a", "2020-01-01")] * 3 + [("b", "2020-01-02")], "name string, date string").selectExpr("name", "cast(date as date) date")
    got = M.never_same_day(pairs, rows, "a", "b")
    assert [tuple(r) for r in got.collect()] == [("a", "b")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [name") >= 2 and "_day" in plan and "collect_list" in plan


def test_the_unified_map_counts_every_later_name_and_id_once(spark, monkeypatch):
    settle, seen = Q.settle, {}
    monkeypatch.setattr(Q, "settle", lambda df, label: seen.update({label: r}) or r if (r := settle(df, label)) is not None else r)
    from shelfline.plans import all_queries
    out = all_queries()["l7_l8_unified_map"](spark, SF)
    known = seen["known"]
    assert known.count() == known.distinct().count() == seen["cleaned"].where("product_id is not null").select("product_id", "name").distinct().count()
    assert out.count() == seen["cleaned"].where("product_id is null").select("name").distinct().count()
