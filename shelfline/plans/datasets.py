"""Price panels derived from the star-schema tables, in Spark and (for the checks) in SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.cells import shelf_cells


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- short dense panel: store = event type, product = user ------------------------------------
def event_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("store"), F.col("user_id").cast("string").alias("name"),
        F.to_date("ts").alias("date"), F.col("value").alias("price"))


EVENT_ROWS = """
event_rows AS (SELECT event_type AS store, CAST(user_id AS VARCHAR) AS name, CAST(ts AS DATE) AS date,
                      value AS price FROM events)"""


def event_panel(spark, sf_dir) -> DataFrame:
    return shelf_cells(event_rows(spark, sf_dir))


EVENT_PANEL = EVENT_ROWS + """,
panel AS (SELECT store, name, date, max(price) AS price FROM event_rows GROUP BY ALL)"""


# --- long dense panel: store = return flag, product = line number -----------------------------------
def long_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("store"), F.col("l_linenumber").cast("string").alias("name"),
        F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("price"))


LONG_ROWS = """
long_rows AS (SELECT l_returnflag AS store, CAST(l_linenumber AS VARCHAR) AS name,
                     CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price FROM lineitem)"""


def long_panel(spark, sf_dir) -> DataFrame:
    return shelf_cells(long_rows(spark, sf_dir))


LONG_PANEL = LONG_ROWS + """,
panel AS (SELECT store, name, date, max(price) AS price FROM long_rows GROUP BY ALL)"""


# --- long sparse panel: store = supplier nation, product = supplier ------------------------------------
def sparse_rows(spark, sf_dir) -> DataFrame:
    nation_of = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("store"))
    return table(spark, sf_dir, "lineitem").join(nation_of, "l_suppkey").select(
        "store", F.col("l_suppkey").cast("string").alias("name"), F.to_date("l_shipdate").alias("date"),
        F.col("l_extendedprice").alias("price"))


def sparse_panel(spark, sf_dir) -> DataFrame:
    return shelf_cells(sparse_rows(spark, sf_dir))


SPARSE_PANEL = """
sparse_rows AS (SELECT CAST(s_nationkey AS VARCHAR) AS store, CAST(l_suppkey AS VARCHAR) AS name,
                       CAST(l_shipdate AS DATE) AS date, l_extendedprice AS price
                FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
panel AS (SELECT store, name, date, max(price) AS price FROM sparse_rows GROUP BY ALL)"""


# --- the sale filter and what follows from it, in SQL ----------------------------------------------------
def sale_walk_sql(window=35, resolve=21, gap=7, blocked=None) -> str:
    """The filter as a step-by-step walk: one recursion step per loop turn, state (row, reference price)."""
    cut = f"p.day - p.prev_day > {gap}" if gap is not None else "false"
    between = (f"x.prev_day < DATE '{blocked[0]}' - DATE '1970-01-01' AND x.day > DATE '{blocked[1]}' - DATE '1970-01-01'"
               if blocked else f"x.day - x.prev_day > {gap}")
    return f"""
numbered AS (SELECT *, row_number() OVER s AS i, count(*) OVER (PARTITION BY store, name) AS n,
                    date - DATE '1970-01-01' AS day, lag(date) OVER s - DATE '1970-01-01' AS prev_day,
                    max(date) OVER (PARTITION BY store, name) - DATE '1970-01-01' AS last_day
             FROM panel WINDOW s AS (PARTITION BY store, name ORDER BY date)),
isl AS (SELECT x.*, sum(CASE WHEN {between} THEN 1 ELSE 0 END) OVER (PARTITION BY store, name ORDER BY i) AS isle
        FROM numbered x),
ahead AS (SELECT a.store, a.name, a.i, b.i AS j, b.price AS pj FROM isl a JOIN isl b
          ON a.store = b.store AND a.name = b.name AND a.isle = b.isle AND b.i > a.i AND b.day - a.day <= {window}),
walk AS (
  SELECT store, name, CAST(2 AS BIGINT) AS i, price AS ref, CAST(NULL AS BIGINT) AS s0, CAST(NULL AS BIGINT) AS s1,
         CAST(NULL AS BIGINT) AS u0
  FROM isl WHERE i = 1
  UNION ALL
  SELECT store, name, CASE WHEN j IS NULL THEN i + 1 ELSE j + 1 END,
         CASE WHEN j IS NULL THEN price ELSE pj END,
         CASE WHEN j IS NOT NULL THEN i END, j,
         CASE WHEN is_drop AND j IS NULL AND isle = last_isle AND last_day - day < {resolve}
                   AND last_day - day <= {window} THEN i END
  FROM (SELECT w.store, w.name, w.i, p.price, p.day, p.last_day, p.isle, l.isle AS last_isle,
               (NOT coalesce({cut}, false)) AND p.price < w.ref * 0.995 AS is_drop,
               min(a.j) AS j, arg_min(a.pj, a.j) AS pj
        FROM walk w JOIN isl p ON p.store = w.store AND p.name = w.name AND p.i = w.i
        JOIN isl l ON l.store = w.store AND l.name = w.name AND l.i = l.n
        LEFT JOIN ahead a ON a.store = w.store AND a.name = w.name AND a.i = w.i AND a.pj >= w.ref * 0.995
             AND (NOT coalesce({cut}, false)) AND p.price < w.ref * 0.995
        GROUP BY ALL)),
walk_u AS (SELECT store, name, min(u0) AS u0 FROM walk GROUP BY ALL),
flagged AS (SELECT p.store, p.name, p.date, p.price, p.i,
                   EXISTS (SELECT 1 FROM walk w WHERE w.store = p.store AND w.name = p.name
                           AND p.i >= w.s0 AND p.i < w.s1) AS is_sale,
                   coalesce(p.i >= u.u0, false) AS unresolved
            FROM isl p LEFT JOIN walk_u u USING (store, name))"""


def sale_flags_sql(window=35, resolve=21, gap=7) -> str:
    """The same flags in closed form (checked against the walk): every drop looks for its own return."""
    return f"""
ordered AS (SELECT *, date - DATE '1970-01-01' AS day, lag(date) OVER s - DATE '1970-01-01' AS prev_day,
                   lag(price) OVER s AS prev_price,
                   max(date) OVER (PARTITION BY store, name) - DATE '1970-01-01' AS last_day
            FROM panel WINDOW s AS (PARTITION BY store, name ORDER BY date)),
isl AS (SELECT *, sum(CASE WHEN day - prev_day > {gap} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY store, name ORDER BY day) AS isle FROM ordered),
drops AS (SELECT d.store, d.name, d.day, d.isle, d.last_day, min(b.day) AS back
          FROM isl d LEFT JOIN isl b ON b.store = d.store AND b.name = d.name AND b.isle = d.isle AND b.day > d.day
               AND b.day <= d.day + {window} AND b.price >= d.prev_price * 0.995
          WHERE d.price < d.prev_price * 0.995 AND d.day - d.prev_day <= {gap} GROUP BY ALL),
last_isle AS (SELECT store, name, max(isle) AS li FROM isl GROUP BY ALL),
opens AS (SELECT store, name, min(day) AS u0 FROM drops JOIN last_isle USING (store, name)
          WHERE back IS NULL AND isle = li AND last_day - day < {resolve} AND last_day - day <= {window} GROUP BY ALL),
flagged AS (SELECT i.store, i.name, i.date, i.price,
                   coalesce(max(d.back) OVER (PARTITION BY i.store, i.name ORDER BY i.day) > i.day, false) AS is_sale,
                   coalesce(i.day >= o.u0, false) AS unresolved
            FROM isl i LEFT JOIN drops d USING (store, name, day) LEFT JOIN opens o USING (store, name))"""


REGULAR = """,
regular AS (SELECT store, name, date, price, is_sale, unresolved,
                   last_value(CASE WHEN NOT is_sale THEN price END IGNORE NULLS)
                     OVER (PARTITION BY store, name ORDER BY date) AS regular FROM flagged)"""

CHANGES = """,
lagged AS (SELECT *, lag(date) OVER w AS pd, lag(regular) OVER w AS pr, lag(unresolved, 1, true) OVER w AS pu
           FROM regular WINDOW w AS (PARTITION BY store, name ORDER BY date)),
changes AS (SELECT store, name, date, abs(regular / pr - 1) > 0.005 AS changed, abs(regular - pr) AS err
            FROM lagged WHERE date - pd = 1 AND NOT unresolved AND NOT pu)"""

DAILY = """,
daily AS (SELECT store, date, count(*) AS products, CAST(sum(CAST(changed AS INT)) AS BIGINT) AS changes,
                 sum(err) AS err, CAST(sum(CAST(changed AS INT)) AS DOUBLE) / count(*) AS rate,
                 CAST(day(date) AS INT) AS dom, CAST(isodow(date) - 1 AS INT) AS dow
          FROM changes GROUP BY store, date)"""


def with_sql(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + "".join(
        (p if p.lstrip().startswith(",") or i == 0 else "," + p) for i, p in enumerate(parts))


EVENT_DAILY = with_sql(EVENT_PANEL, sale_flags_sql(), REGULAR, CHANGES, DAILY)
LONG_DAILY = with_sql(LONG_PANEL, sale_flags_sql(), REGULAR, CHANGES, DAILY)


# --- daily grid with the causal regular price -------------------------------------------------------------
def grid_sql(extra: str = "") -> str:
    """From ``obs`` (store, segment_id, date, shelf_price, ...) to ``grid``: the fold, one step per calendar day."""
    return f"""
spans AS (SELECT store, segment_id, min(date) AS lo, least(max(date) + 4, (SELECT max(date) FROM obs)) AS hi FROM obs GROUP BY ALL),
days AS (SELECT store, segment_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM spans),
g0 AS (SELECT d.*, o.shelf_price{extra}, row_number() OVER (PARTITION BY d.store, d.segment_id ORDER BY d.date) AS t
       FROM days d LEFT JOIN obs o ON o.store = d.store AND o.segment_id = d.segment_id AND o.date = d.date),
fold AS (
  SELECT store, segment_id, t, shelf_price AS reg, CAST(NULL AS BIGINT) AS ss, t AS seen FROM g0 WHERE t = 1
  UNION ALL
  SELECT g.store, g.segment_id, g.t,
    CASE WHEN g.shelf_price IS NULL THEN f.reg WHEN g.t - f.seen > 3 THEN g.shelf_price
         WHEN g.shelf_price < f.reg * 0.995 AND g.t - coalesce(f.ss, g.t) < 21 THEN f.reg ELSE g.shelf_price END,
    CASE WHEN g.shelf_price IS NULL THEN f.ss WHEN g.t - f.seen > 3 THEN NULL
         WHEN g.shelf_price < f.reg * 0.995 AND g.t - coalesce(f.ss, g.t) < 21 THEN coalesce(f.ss, g.t) END,
    CASE WHEN g.shelf_price IS NULL THEN f.seen ELSE g.t END
  FROM fold f JOIN g0 g ON g.store = f.store AND g.segment_id = f.segment_id AND g.t = f.t + 1),
grid AS (SELECT g.*, g.shelf_price IS NOT NULL AS observed, CASE WHEN g.t - f.seen <= 3 THEN f.reg END AS R,
   CASE WHEN g.t - f.seen <= 3 AND f.ss IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS on_sale,
   CASE WHEN g.shelf_price IS NOT NULL AND f.ss IS NOT NULL THEN g.shelf_price / f.reg - 1 ELSE 0.0 END::DOUBLE AS sale_depth,
   CASE WHEN g.t - f.seen <= 3 AND f.ss IS NOT NULL THEN g.t - f.ss + 1 ELSE 0 END::DOUBLE AS days_in_sale
   FROM g0 g JOIN fold f USING (store, segment_id, t))"""


def as_segments(panel: DataFrame) -> DataFrame:
    return panel.select("store", F.col("name").alias("segment_id"), "date", F.col("price").alias("shelf_price"))


OBS = """,
obs AS (SELECT store, name AS segment_id, date, price AS shelf_price FROM panel)"""
EVENT_GRID = with_sql(EVENT_PANEL, OBS, grid_sql(), recursive=True)
SPARSE_GRID = with_sql(SPARSE_PANEL, OBS, grid_sql(), recursive=True)
LONG_GRID = with_sql(LONG_PANEL, OBS, grid_sql(), recursive=True)
