"""A cross-section of registered queries against their SQL on the smallest tables."""
import pytest

from compare import compare, duck
from shelfline.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
NAMES = ("flagship_change_days", "t1_sale_filter_sparse", "t2_t4_causal_grid_events", "e15_daily_store_rates", "e26_episode_length_profile",
         "b2_unit_price_artifacts", "e23_boundary_summary", "r4_rolling_origins", "r12_r14_family_budget_table", "h8_h9_subset_evaluation",
         "h16_best_thresholds", "l2_c5_c8_c9_s4_rename_pairs", "f24_change_points", "a14_json_blocks")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert compare(all_queries()[name](spark, SF), duck(SF), all_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())
