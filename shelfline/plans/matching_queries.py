"""Text (C), linking (L) and related sampling, set and join queries on the derived listings."""
from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..common import r6
from ..functions import text as T
from ..operators import matching as M
from ..session import settle
from .. import fixed_values as V
from . import datasets as D
from .cleaning_queries import parsed
from .datasets import with_sql
from .listings import LISTINGS
from .registry import query
from .rule_queries import rounded


def kept(spark, sf):
    return parsed(spark, sf).where("not is_unit_price").withColumn("price", F.col("list_price"))


def eras(spark, sf):
    rows = kept(spark, sf)
    return rows.where("product_id is null"), rows.where("product_id is not null")


def norm_sql(x):
    s = f"trim(regexp_replace(lower(regexp_replace({x}, '\\.\\.\\.$', '')), '\\s+', ' ', 'g'))"
    for pattern, repl in V.UNIT_REWRITES:
        s = f"regexp_replace({s}, '{pattern.replace(chr(39), chr(39) * 2)}', '{re.sub(r'[$]([0-9])', r'\\\1', repl)}', 'g')"
    s = f"regexp_replace({s}, '[^\\w.\\s]', ' ', 'g')"
    for _ in range(2):
        s = f"regexp_replace({s}, '(\\d)\\.(\\d)', '\\1~\\2', 'g')"
    s = f"replace(replace({s}, '.', ' '), '~', '.')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


_PK = "regexp_replace(lower(regexp_replace(name, '\\.\\.\\.$', '')), '(\\d),(\\d)', '\\1.\\2', 'g')"
_Q = lambda p: p.replace("'", "''")
NAMES = LISTINGS + f""",
kept AS (SELECT * REPLACE (list_price AS price) FROM parsed WHERE NOT is_unit_price),
n0 AS (SELECT name, is_truncated AS truncated, {norm_sql('name')} AS norm, {_PK} AS pt FROM (SELECT DISTINCT name, is_truncated FROM kept)),
n1 AS (SELECT *, nullif(regexp_extract(pt, '{_Q(V.PACK_MULTI)}', 1), '') AS mc FROM n0),
n2 AS (SELECT *, TRY_CAST(coalesce(mc, nullif(regexp_extract(pt, '{_Q(V.PACK_PIECES)}', 1), '')) AS INT) AS cnt,
  CASE WHEN mc IS NOT NULL THEN regexp_extract(pt, '{_Q(V.PACK_MULTI)}', 2) ELSE regexp_extract_all(pt, '{_Q(V.PACK_SIZE)}', 1)[-1] END AS sz,
  CASE WHEN mc IS NOT NULL THEN regexp_extract(pt, '{_Q(V.PACK_MULTI)}', 3) ELSE regexp_extract_all(pt, '{_Q(V.PACK_SIZE)}', 2)[-1] END AS un FROM n1),
names AS (SELECT name, truncated, norm, array_to_string(list_sort(string_split(norm, ' ')), ' ') AS word_key, cnt,
  round(TRY_CAST(sz AS DOUBLE) * CASE un WHEN 'kg' THEN 1000 WHEN 'l' THEN 1000 WHEN 'lt' THEN 1000 WHEN 'mg' THEN 0.001 WHEN 'cl' THEN 10 ELSE 1 END, 3) AS size,
  CASE WHEN un IN ('kg', 'g', 'gr', 'mg') THEN 'g' WHEN un IN ('l', 'lt', 'ml', 'cl') THEN 'ml' END AS unit FROM n2)"""


def _agree(x, y, ta, tb):
    return f"({x} IS NOT DISTINCT FROM {y} OR ({x} IS NULL AND {ta}) OR ({y} IS NULL AND {tb}))"


def same_pack_sql(a, b):
    imp = lambda t: f"coalesce(nullif({t}.cnt, 0), CASE WHEN coalesce({t}.size, 0) <> 0 THEN 1 END)"
    ta, tb = f"{a}.truncated", f"{b}.truncated"
    return (f"({_agree(a + '.size', b + '.size', ta, tb)} AND {_agree(a + '.unit', b + '.unit', ta, tb)} AND "
            f"({_agree(imp(a), imp(b), ta, tb)} OR {_agree(a + '.cnt', b + '.cnt', ta, tb)}))")


def names(spark, sf):
    return M.name_table(kept(spark, sf))


@query("c1_c2_c12_normalized_names", with_sql(NAMES) + " SELECT name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS fold, norm, word_key FROM names")
def _(spark, sf):
    return names(spark, sf).select("name", "fold", "norm", "word_key")


@query("c3_c6_c7_packs", with_sql(NAMES) + """ SELECT name, cnt AS count, size, unit, CASE WHEN size IS NOT NULL THEN coalesce(cnt, 1) || 'x' || format('{:g}', size) || unit WHEN cnt IS NOT NULL THEN cnt || 'pc' END AS pack_key,
 CASE WHEN unit = 'g' THEN 'TRY/kg' WHEN unit = 'ml' THEN 'TRY/l' WHEN cnt IS NOT NULL THEN 'TRY/piece' ELSE 'none' END AS unit_basis,
 round(CASE WHEN size IS NOT NULL THEN 100.0 / (coalesce(cnt, 1) * size) * 1000 WHEN cnt IS NOT NULL THEN 100.0 / cnt END, 6) AS unit_price FROM names""")
def _(spark, sf):
    return names(spark, sf).select("name", "pack.count", "pack.size", "pack.unit", T.pack_key("pack").alias("pack_key"), T.unit_basis("pack").alias("unit_basis"),
                                   r6(T.unit_price(F.lit(100.0), "pack")).alias("unit_price"))


@query("c4_same_pack", with_sql(NAMES) + f" SELECT a.name AS a, b.name AS b, {same_pack_sql('a', 'b')} AS same FROM names a JOIN names b ON starts_with(b.name, regexp_replace(a.name, '\\s*\\.\\.\\.$', '')) AND a.truncated AND NOT b.truncated")
def _(spark, sf):
    n = names(spark, sf).select("name", "pack", "truncated")
    a = n.where("truncated").select(F.col("name").alias("a"), F.col("pack").alias("pa"), F.col("truncated").alias("ta"), F.regexp_replace("name", r"\s*\.\.\.$", "").alias("cut"))
    b = n.where("not truncated").select(F.col("name").alias("b"), F.col("pack").alias("pb"), F.col("truncated").alias("tb"))
    return M.prefix_hits(a, b, "cut", "b").select("a", "b", T.same_pack("pa", "ta", "pb", "tb").alias("same"))


@query("l1_exact_matches", with_sql(NAMES) + """
, ids AS (SELECT name, count(DISTINCT product_id) AS n_ids, min(product_id) AS id FROM kept WHERE product_id IS NOT NULL GROUP BY name)
SELECT p.name, count(*) AS rows, min(date) AS first_seen, max(date) AS last_seen, coalesce(any_value(n_ids), 0) AS n_ids,
 CASE WHEN any_value(n_ids) = 1 THEN 'exact_unique' WHEN any_value(n_ids) > 1 THEN 'exact_ambiguous' ELSE 'no_exact_match' END AS step1, CASE WHEN any_value(n_ids) = 1 THEN any_value(id) END AS series_id
FROM kept p LEFT JOIN ids USING (name) WHERE p.product_id IS NULL GROUP BY p.name""")
def _(spark, sf):
    return M.exact_matches(*eras(spark, sf))


PAIRS = NAMES + """,
sp AS (SELECT product_id, name, min(date) AS first_seen FROM kept WHERE product_id IS NOT NULL GROUP BY ALL),
pr AS (SELECT product_id, name AS old_name, lead(name) OVER w AS new_name, lead(first_seen) OVER w AS switch_date FROM sp WINDOW w AS (PARTITION BY product_id ORDER BY first_seen, name)),
pt2 AS (SELECT p.*, a.norm AS an, b.norm AS bn, list_distinct(string_split(a.norm, ' ')) AS wa, list_distinct(string_split(b.norm, ' ')) AS wb, a.size AS sa, b.size AS sb, a.cnt AS ca, b.cnt AS cb
  FROM pr p JOIN names a ON a.name = old_name JOIN names b ON b.name = new_name),
pairs AS (SELECT *, list_sort(list_filter(wa, lambda x: NOT list_contains(wb, x))) AS rem, list_sort(list_filter(wb, lambda x: NOT list_contains(wa, x))) AS ad,
  list_distinct([' ' || an || ' ']) AS z FROM pt2)"""


@query("l2_c5_c8_c9_s4_rename_pairs", with_sql(PAIRS) + """
, g AS (SELECT *, list_distinct(list_transform(range(1, length(an) + 1), lambda i: substr(' ' || an || ' ', i, 3))) AS ga, list_distinct(list_transform(range(1, length(bn) + 1), lambda i: substr(' ' || bn || ' ', i, 3))) AS gb,
  string_split(an, ' ') AS la, string_split(bn, ' ') AS lb, list_distinct(list_transform(range(1, len(la)), lambda i: la[i] || ' ' || la[i + 1])) AS ba, list_distinct(list_transform(range(1, len(lb)), lambda i: lb[i] || ' ' || lb[i + 1])) AS bb FROM pairs)
SELECT product_id, old_name, new_name, switch_date, array_to_string(rem, ' ') AS removed, array_to_string(ad, ' ') AS added,
 round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))::DOUBLE, 6) AS word1_jaccard,
 round(CASE WHEN len(ba) + len(bb) = 0 THEN 1.0 ELSE len(list_intersect(ba, bb)) / len(list_distinct(list_concat(ba, bb)))::DOUBLE END, 6) AS word2_jaccard, round(len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE, 6) AS char3_jaccard,
 CASE WHEN old_name = new_name THEN 'identical' WHEN lower(old_name) = lower(new_name) THEN 'case/whitespace/Turkish chars' WHEN an = bn THEN 'unit/number formatting' WHEN len(rem) = 0 AND len(ad) = 0 THEN 'word order'
  WHEN len(rem) = 0 THEN 'words added (e.g. brand/descriptor)' WHEN len(ad) = 0 THEN 'words removed' ELSE 'rewrite (words added and removed)' END AS diff_type,
 coalesce(sa <> sb, false) OR coalesce(ca <> cb, false) AS pack_size_changed FROM g""")
def _(spark, sf):
    out = M.rename_pairs(eras(spark, sf)[1], names(spark, sf))
    return rounded(out, ["word1_jaccard", "word2_jaccard", "char3_jaccard"])


@query("g5_token_frequency", with_sql(PAIRS) + " SELECT token, count(*) AS n FROM (SELECT unnest(ad) AS token FROM pairs) GROUP BY token ORDER BY n DESC, token LIMIT 15")
def _(spark, sf):
    return M.token_frequency(M.rename_pairs(eras(spark, sf)[1], names(spark, sf)), "added")


@query("g6_rename_days", with_sql(PAIRS) + " SELECT switch_date, count(*) AS renames FROM pairs GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf):
    return M.rename_days(M.rename_pairs(eras(spark, sf)[1], names(spark, sf)), 2)


RULES = NAMES + f""",
post AS (SELECT DISTINCT product_id, name FROM kept WHERE product_id IS NOT NULL), cand AS (SELECT product_id, n.* FROM post JOIN names n USING (name)),
todo AS (SELECT n.* FROM names n WHERE name IN (SELECT name FROM kept WHERE product_id IS NULL) AND name NOT IN (SELECT name FROM post)),
pf AS (SELECT *, regexp_replace(name, '\\s*\\.\\.\\.$', '') AS pfx FROM todo WHERE truncated), pf2 AS (SELECT *, {norm_sql('pfx')} AS npfx FROM pf),
raw AS (SELECT p.name, c.product_id, {same_pack_sql('p', 'c')} AS fits FROM pf2 p JOIN cand c ON starts_with(c.name, p.pfx)),
loose AS (SELECT p.name, c.product_id, {same_pack_sql('p', 'c')} AS fits FROM pf2 p JOIN cand c ON starts_with(c.norm, p.npfx) WHERE p.name NOT IN (SELECT name FROM raw)),
hit AS (SELECT name, '3b_truncated_prefix' AS rule, product_id FROM (SELECT * FROM raw UNION ALL SELECT * FROM loose) WHERE fits
  UNION ALL SELECT t.name, '3c_normalized', c.product_id FROM todo t JOIN cand c ON t.norm = c.norm UNION ALL SELECT t.name, '3d_word_order', c.product_id FROM todo t JOIN cand c ON t.word_key = c.word_key),
fnd AS (SELECT name, rule, count(DISTINCT product_id) AS n_ids, min(product_id) AS id FROM hit GROUP BY name, rule QUALIFY row_number() OVER (PARTITION BY name ORDER BY rule) = 1),
ruled AS (SELECT t.name, CASE WHEN rule IS NULL THEN 'no_rule_match' WHEN n_ids = 1 THEN rule ELSE rule || '_ambiguous' END AS rule, CASE WHEN n_ids = 1 THEN id END AS series_id, coalesce(n_ids, 0) AS n_ids FROM todo t LEFT JOIN fnd USING (name))"""


def ruled(spark, sf):
    rows = settle(kept(spark, sf).select("name", "date", "price", "product_id", "is_truncated"), "cleaned")
    pre, post = rows.where("product_id is null"), rows.where("product_id is not null")
    known = settle(post.select("product_id", "name").distinct(), "known")       # all that most steps read of the later rows
    n = M.name_table(rows)
    exact = settle(M.exact_matches(pre, known), "exact")
    todo = exact.where("step1 = 'no_exact_match'")
    return M.rule_matches(todo, known, n), n, pre, post, exact, known


@query("l3_j9_rule_cascade", with_sql(RULES) + " SELECT name, rule, series_id, n_ids FROM ruled")
def _(spark, sf):
    return ruled(spark, sf)[0]


GROUPS = RULES + f""",
ids AS (SELECT name, count(DISTINCT product_id) AS n FROM post GROUP BY name),
lo AS (SELECT name FROM ruled WHERE series_id IS NULL UNION SELECT name FROM ids WHERE n > 1 AND name IN (SELECT name FROM kept WHERE product_id IS NULL)),
lon AS (SELECT n.* FROM names n JOIN lo USING (name)), prd AS (SELECT DISTINCT name, date FROM kept WHERE product_id IS NULL),
lk AS (SELECT a.name, b.name AS full_name FROM lon a JOIN lon b ON a.truncated AND NOT b.truncated AND starts_with(b.norm, a.norm) AND {same_pack_sql('a', 'b')}
  WHERE NOT EXISTS (SELECT 1 FROM prd x JOIN prd y USING (date) WHERE x.name = a.name AND y.name = b.name)),
grp AS (SELECT lo.name, coalesce(g, lo.name) AS "group" FROM lo LEFT JOIN (SELECT name, min(full_name) AS g FROM lk GROUP BY name HAVING count(*) = 1) USING (name))"""


def grouped(spark, sf):
    rules, n, pre, post, exact, known = ruled(spark, sf)
    amb = exact.where("step1 = 'exact_ambiguous'").select("name")
    leftover = rules.where("series_id is null").select("name").unionByName(amb)
    return M.truncation_groups(leftover, pre, n), n, pre, post, rules, exact, known


@query("l4_s3_truncation_groups", with_sql(GROUPS) + ' SELECT name, "group" FROM grp')
def _(spark, sf):
    return grouped(spark, sf)[0]


BLOCK = GROUPS + """,
gq AS (SELECT DISTINCT "group", n.norm FROM grp JOIN names n ON n.name = "group"),
docs AS (SELECT norm FROM gq UNION ALL SELECT norm FROM cand), cnt_d AS (SELECT norm, count(*) AS copies FROM docs GROUP BY norm),
wd AS (SELECT norm, copies, ' ' || unnest(string_split(norm, ' ')) || ' ' AS w FROM cnt_d),
gr AS (SELECT norm, copies, substr(w, i, n) AS gram FROM (SELECT norm, copies, w, unnest([3, 4, 5]) AS n FROM wd) s, LATERAL (SELECT unnest(range(1, length(w) - n + 2)) AS i) r WHERE n <= length(w)),
tf AS (SELECT norm, copies, gram, count(*) AS tf FROM gr GROUP BY ALL), dfq AS (SELECT gram, sum(copies) AS df FROM tf GROUP BY gram),
xw AS (SELECT norm, gram, tf * (ln((1 + (SELECT count(*) FROM docs)) / (1 + df)::DOUBLE) + 1) AS x FROM tf JOIN dfq USING (gram)),
ww AS (SELECT norm, gram, x / sqrt(sum(x * x) OVER (PARTITION BY norm)) AS w FROM xw),
cs AS (SELECT a.norm AS q, b.norm AS c, round(sum(a.w * b.w), 7) AS sim FROM ww a JOIN ww b USING (gram) WHERE a.norm IN (SELECT norm FROM gq) AND b.norm IN (SELECT norm FROM cand) GROUP BY ALL),
nn AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY q ORDER BY sim DESC, c) <= 75)"""


@query("l5_nearest_names", with_sql(BLOCK) + " SELECT q, count(*) AS neighbours, max(sim) AS best, min(sim) AS kth FROM nn GROUP BY q")
def _(spark, sf):
    groups, n, *_, known = grouped(spark, sf)
    info = n.select("name", "norm")
    g = groups.select(F.col("group").alias("name")).distinct().join(info, "name")
    c = known.join(info, "name")
    docs = g.select("norm").unionAll(c.select("norm")).groupBy("norm").agg(F.count("*").alias("copies"))
    near = M.nearest_norms(g, c, M.gram_weights(docs), V.BLOCK_TOP_NAMES)
    return near.groupBy("q").agg(F.count("*").alias("neighbours"), F.round(F.max("sim"), 7).alias("best"), F.round(F.min("sim"), 7).alias("kth"))


def edges(spark, sf):
    groups, n, pre, post, rules, exact, known = grouped(spark, sf)
    linked = exact.select("name", "series_id").unionByName(rules.select("name", "series_id")).where("series_id is not null")
    id_rows = post.select(F.col("product_id").alias("series_id"), "date", "price").unionByName(pre.join(linked, "name").select("series_id", "date", "price"))
    blocked = M.blocked_candidates(groups, known, n)
    e = M.handover_edges(blocked, pre.join(groups, "name").select("group", "date", "price"), id_rows, known, n)
    return settle(e, "edges"), groups, pre, post, rules, exact


@query("l6_c10_c11_j10_assignment")
def _(spark, sf):
    return M.assign_links(edges(spark, sf)[0])


# Customers of a block of 150 keys want slots in a band: customer i wants slots 2i/3 and 2i/3 + 1, three customers to two slots.
CHAIN = """
WITH RECURSIVE c AS (SELECT c_custkey // 150 AS block, c_custkey % 150 AS i, (CAST(round(c_acctbal * 100) AS BIGINT) + 100000) % 997 AS p,
  (CAST(round(c_acctbal * 100) AS BIGINT) + 100000) // 7 % 991 AS q FROM customer),
walk(block, i, used, v) AS (SELECT DISTINCT block, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM c UNION ALL
  SELECT block, i + 1, CASE WHEN 2 * (i + 1) // 3 > 2 * i // 3 THEN w >> 1 ELSE w END, max(v + g)
  FROM (SELECT d.block, d.i, d.used | t.bit AS w, d.v, CASE t.bit WHEN 0 THEN 0 WHEN 1 THEN 1000000000 + p ELSE 1000000000 + q END AS g
        FROM walk d LEFT JOIN c USING (block, i), (VALUES (CAST(0 AS BIGINT)), (1), (2)) t(bit) WHERE d.i < 150 AND d.used & t.bit = 0 AND (t.bit = 0 OR c.p IS NOT NULL))
  GROUP BY ALL)"""


@query("l6_assignment_chains", CHAIN + " SELECT block, max(v) // 1000000000 AS links, max(v) % 1000000000 AS points FROM walk WHERE i = 150 GROUP BY block")
def _(spark, sf):
    a = F.round(F.col("c_acctbal") * 100).cast("long") + 100_000
    block, slot = F.expr("c_custkey div 150"), F.expr("2 * (c_custkey % 150) div 3")
    ways = F.explode(F.array(F.struct(slot.alias("s"), (a % 997).alias("p")), F.struct((slot + 1).alias("s"), (F.floor(a / 7) % 991).alias("p"))))
    rows = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("group"), block.alias("block"), ways.alias("_w"))
    links = rows.select("group", "block", (F.col("block") * 1000 + F.col("_w.s")).alias("series_id"), (F.col("_w.p") / 1000).alias("score"), F.lit(1).alias("gap_days"))
    chosen = M.assign_links(settle(links, "wants"), small=50)
    return chosen.groupBy("block").agg(F.count("*").alias("links"), F.sum(F.round(F.col("score") * 1000).cast("long")).alias("points"))


# Parts of a supplier are names of one series, months of shipping their days.
FIRST_COME = """
WITH RECURSIVE own AS (SELECT l_suppkey, l_partkey, count(*) AS n, bit_or(CAST(1 AS HUGEINT) << CAST(datediff('month', DATE '1992-01-01', l_shipdate) AS INT)) AS days FROM lineitem GROUP BY ALL),
o AS (SELECT *, l_suppkey || '-' || l_partkey AS name, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey % 2, n DESC, l_suppkey || '-' || l_partkey) AS k FROM own),
walk(l_suppkey, k, name, busy, kept) AS (SELECT DISTINCT l_suppkey, CAST(0 AS BIGINT), '', CAST(0 AS HUGEINT), true FROM own UNION ALL
  SELECT w.l_suppkey, o.k, o.name, CASE WHEN w.busy & o.days = 0 THEN w.busy | o.days ELSE w.busy END, w.busy & o.days = 0 FROM walk w JOIN o ON o.l_suppkey = w.l_suppkey AND o.k = w.k + 1),
lost AS (SELECT name, 'd_' || lpad(CAST(row_number() OVER (ORDER BY name) - 1 AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY name) - 1 AS VARCHAR))) AS INT), '0') AS own_id FROM walk WHERE NOT kept)"""


@query("l8_first_come_names", FIRST_COME + """ SELECT o.name, coalesce(own_id, CAST(l_suppkey AS VARCHAR)) AS series_id,
 CASE WHEN own_id IS NOT NULL THEN '6_own_series (demoted overlap)' WHEN l_partkey % 2 = 0 THEN '1_exact' ELSE '3c_normalized' END AS method FROM o LEFT JOIN lost USING (name)""")
def _(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_suppkey", "l_partkey").alias("name"), F.col("l_suppkey").cast("string").alias("series_id"),
        F.when(F.col("l_partkey") % 2 == 0, "1_exact").otherwise("3c_normalized").alias("method"), F.trunc("l_shipdate", "month").alias("date"))
    return M.one_name_per_day(rows.select("name", "series_id", "method").distinct(), rows.select("name", "date"))


def full_map(spark, sf):
    e, groups, pre, post, rules, exact = edges(spark, sf)
    links = M.assign_links(e)
    exact = exact.where("series_id is not null").select("name", "series_id", F.lit("1_exact").alias("method"))
    by_rule = rules.where("series_id is not null").select("name", "series_id", F.col("rule").alias("method"))
    left = M.leftover_map(groups, links).select("name", "series_id", "method")
    return M.first_source([exact, by_rule, left]), pre, post


@query("l7_l8_unified_map")
def _(spark, sf):
    pre_map, pre, _ = full_map(spark, sf)
    return M.one_name_per_day(pre_map, pre)


@query("l7_id_era_names", with_sql(NAMES) + """
, c AS (SELECT name, product_id, count(*) AS n FROM kept WHERE product_id IS NOT NULL GROUP BY ALL)
SELECT name, product_id AS series_id, CASE WHEN k > 1 THEN '0_id_era_multi_id' ELSE '0_id_era' END AS method, 'id_era' AS era
FROM (SELECT *, count(*) OVER (PARTITION BY name) AS k, row_number() OVER (PARTITION BY name ORDER BY n DESC, product_id) AS r FROM c) WHERE r = 1""")
def _(spark, sf):
    pre, post = eras(spark, sf)
    exact = M.exact_matches(pre, post).where("series_id is not null").select("name", "series_id", F.lit("1_exact").alias("method"))
    return M.name_map(post, exact).where("era = 'id_era'").select("name", "series_id", "method", "era")


@query("l10_unassigned_by_month", with_sql(RULES) + """
, l AS (SELECT name, max(date) AS last, count(*) AS rows FROM kept WHERE product_id IS NULL AND name IN (SELECT name FROM todo) GROUP BY name)
SELECT strftime(last, '%Y-%m') AS month, count(*) AS groups, CAST(sum(rows) AS BIGINT) AS rows FROM l WHERE name NOT IN (SELECT name FROM ruled WHERE series_id IS NOT NULL) GROUP BY 1""")
def _(spark, sf):
    rules, _, pre, *_ = ruled(spark, sf)
    rows = pre.join(rules.select("name"), "name").select(F.col("name").alias("group"), "date")
    return M.unassigned_by_month(rows, rules.where("series_id is not null").select(F.col("name").alias("group")))


@query("l9_panel_fully_mapped", with_sql(NAMES) + " SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unmapped FROM kept")
def _(spark, sf):
    pre_map, pre, post = full_map(spark, sf)
    rows = pre.unionByName(post)        # every kept row, cleaned once and written by the first step
    return M.unmapped_rows(M.mapped_panel(rows, M.one_name_per_day(pre_map, pre)))


@query("l10_assignment_quality")
def _(spark, sf):
    return M.assignment_quality(M.assign_links(edges(spark, sf)[0]))


@query("l11_validation_sample", with_sql(RULES) + """
SELECT name, rule AS method, series_id, (SELECT string_agg(name, ' | ' ORDER BY name) FROM post WHERE post.product_id = ruled.series_id) AS id_names, '' AS is_correct
FROM ruled WHERE series_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rule ORDER BY md5(name || '|42'), name) <= 30""")
def _(spark, sf):
    rules, *_, known = ruled(spark, sf)
    links = rules.where("series_id is not null").select("name", F.col("rule").alias("method"), "series_id")
    return M.validation_sample(links, known).select("name", "method", "series_id", "id_names", "is_correct")


@query("g3_stratified_sample", "SELECT p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(CAST(p_partkey AS VARCHAR) || '|42'), p_partkey) <= 30")
def _(spark, sf):
    return M.stratified_sample(D.table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "p_partkey", 30)


@query("g4_random_subset", "SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|42'), c_custkey LIMIT 400")
def _(spark, sf):
    c = D.table(spark, sf, "customer").select("c_custkey")
    return c.orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("|42"))), "c_custkey").limit(400)


@query("s2_priority_union", with_sql(NAMES) + """
, a AS (SELECT name, min(product_id) AS series_id FROM kept WHERE product_id IS NOT NULL GROUP BY name)
SELECT name, coalesce(a.series_id, 'own_' || name) AS series_id, CASE WHEN a.name IS NOT NULL THEN 'id' ELSE 'own' END AS method FROM (SELECT DISTINCT name FROM kept) LEFT JOIN a USING (name)""")
def _(spark, sf):
    rows = kept(spark, sf)
    a = rows.where("product_id is not null").groupBy("name").agg(F.min("product_id").alias("series_id")).withColumn("method", F.lit("id"))
    b = rows.select("name").distinct().select("name", F.concat(F.lit("own_"), "name").alias("series_id"), F.lit("own").alias("method"))
    return M.first_source([a, b])
