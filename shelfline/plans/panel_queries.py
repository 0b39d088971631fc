"""Cells, sales, changes (E and T operators on price panels)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..common import r6
from ..operators import cells as C, sales as S
from . import datasets as D
from .datasets import with_sql
from .registry import query


@query("e1_max_price_per_cell", with_sql(D.EVENT_PANEL) + " SELECT * FROM panel")
def _(spark, sf):
    return D.event_panel(spark, sf)


@query("t1_sale_filter_events", with_sql(D.EVENT_PANEL, D.sale_walk_sql(), recursive=True)
       + " SELECT store, name, date, price, is_sale, unresolved FROM flagged")
def _(spark, sf):
    return S.flag_sales(D.event_panel(spark, sf))


@query("t1_sale_filter_sparse", with_sql(D.SPARSE_PANEL, D.sale_walk_sql(), recursive=True)
       + " SELECT store, name, date, price, is_sale, unresolved FROM flagged")
def _(spark, sf):
    return S.flag_sales(D.sparse_panel(spark, sf))


OUTAGE = ("1998-02-01", "1998-02-20")


def _around_outage(df):
    return df.where(~F.col("date").between(*[F.lit(d).cast("date") for d in OUTAGE]))


@query("t1_sale_filter_outage", with_sql(
    D.SPARSE_PANEL.replace("panel AS (", "all_days AS (") + f""",
panel AS (SELECT * FROM all_days WHERE NOT date BETWEEN DATE '{OUTAGE[0]}' AND DATE '{OUTAGE[1]}')""",
    D.sale_walk_sql(gap=None, blocked=OUTAGE), recursive=True)
    + " SELECT store, name, date, price, is_sale, unresolved FROM flagged")
def _(spark, sf):
    return S.flag_sales(_around_outage(D.sparse_panel(spark, sf)), max_gap_days=None, blocked=OUTAGE)


@query("t1_sale_filter_long", with_sql(D.LONG_PANEL, D.sale_flags_sql())
       + " SELECT store, name, date, price, is_sale, unresolved FROM flagged")
def _(spark, sf):
    return S.flag_sales(D.long_panel(spark, sf))


@query("t3_regular_price_carried", with_sql(D.SPARSE_PANEL, D.sale_flags_sql(), D.REGULAR)
       + " SELECT * FROM regular")
def _(spark, sf):
    return S.regular_prices(D.sparse_panel(spark, sf))
