"""Linking product names across time: exact and rule matches, blocking, one-to-one assignment.

Text work runs once per distinct name. Joins are equi-joins on names, normal forms, prefixes or grams.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..common import positions, ratio
from ..functions import calendar as K, text as T
from ..session import discard, settle
from .. import fixed_values as V
from . import auction as auctions, graph
from .cells import most_frequent

ID = "product_id"


def name_spans(rows: DataFrame, pid: str = ID) -> DataFrame:
    return rows.groupBy(pid, "name").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"),
                                         F.countDistinct("date").alias("days"))


def method_coverage(panel: DataFrame, before) -> DataFrame:
    early = F.col("date") < F.lit(str(before)[:10]).cast("date")
    table = panel.groupBy("method").agg(F.count("*").alias("all_rows"), F.count_if(early).alias("early_rows"))
    return table.withColumn("early_pct", 100 * ratio("early_rows", F.sum("early_rows").over(Window.partitionBy(F.lit(1)))))


def name_table(rows: DataFrame, compose: bool = True) -> DataFrame:
    """Distinct names with folded, normalised and pack columns, written once because many steps read it."""
    names = T.distinct_names(rows, compose=compose).withColumn("fold", T.fold("name", compose=compose))
    return settle(names, "names")


def pre_names(pre: DataFrame) -> DataFrame:
    return pre.groupBy("name").agg(F.count("*").alias("rows"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"))


def exact_matches(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Early names against the IDs that carry the identical name later."""
    ids = post.groupBy("name").agg(F.countDistinct(ID).alias("n_ids"), F.min(ID).alias("_id"))
    out = pre_names(pre).join(ids, "name", "left").withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))
    step = F.when(F.col("n_ids") == 1, "exact_unique").when(F.col("n_ids") > 1, "exact_ambiguous").otherwise("no_exact_match")
    return out.withColumn("step1", step).withColumn("series_id", F.when(F.col("n_ids") == 1, F.col("_id"))).drop("_id")


def rename_pairs(post: DataFrame, names: DataFrame) -> DataFrame:
    """Consecutive names of one ID with word changes, similarity scores and the kind of difference.

    The successor is looked up inside one day and, at the end of a day, in the ID's next day, so an ID with very
    many names is spread over its days.
    """
    spans = name_spans(post).select(ID, "name", "first_seen")
    inside = Window.partitionBy(ID, "first_seen").orderBy("name")
    along = Window.partitionBy(ID).orderBy("first_seen")
    days = spans.groupBy(ID, "first_seen").agg(F.min("name").alias("_head")).select(
        ID, "first_seen", F.lead("_head").over(along).alias("_next"), F.lead("first_seen").over(along).alias("_when"))
    pairs = (spans.withColumn("_in", F.lead("name").over(inside)).join(days, [ID, "first_seen"])
             .select(ID, F.col("name").alias("old_name"), F.coalesce("_in", "_next").alias("new_name"),
                     F.when(F.col("_in").isNotNull(), F.col("first_seen")).otherwise(F.col("_when")).alias("switch_date"))
             .where("new_name is not null"))
    side = lambda p: names.select(F.col("name").alias(f"{p}_name"), *[F.col(c).alias(f"{p}_{c}") for c in ("norm", "fold", "pack")])
    pairs = pairs.join(side("old"), "old_name").join(side("new"), "new_name")
    a, b = F.array_distinct(T.words("old_norm")), F.array_distinct(T.words("new_norm"))
    ordered = lambda x: F.array_join(F.array_sort(x), " ")
    return pairs.select(
        ID, "old_name", "new_name", "switch_date", ordered(F.array_except(a, b)).alias("removed"), ordered(F.array_except(b, a)).alias("added"),
        T.jaccard(a, b).alias("word1_jaccard"),
        T.jaccard(T.word_ngrams(T.words("old_norm"), 2), T.word_ngrams(T.words("new_norm"), 2)).alias("word2_jaccard"),
        T.jaccard(T.char_ngrams("old_norm"), T.char_ngrams("new_norm")).alias("char3_jaccard"),
        T.classify_pair("old_name", "new_name", "old_fold", "new_fold", "old_norm", "new_norm").alias("diff_type"),
        T.pack_changed("old_pack", "new_pack").alias("pack_size_changed"))


def token_frequency(pairs: DataFrame, col: str, k: int = 15) -> DataFrame:
    words = pairs.select(F.explode(F.split(col, " ")).alias("token")).where("token <> ''")
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(k)


def rename_days(pairs: DataFrame, at_least: int = 10) -> DataFrame:
    return pairs.groupBy("switch_date").agg(F.count("*").alias("renames")).where(F.col("renames") >= at_least)


def prefix_hits(short: DataFrame, full: DataFrame, prefix: str, text: str) -> DataFrame:
    """Pairs where ``short.prefix`` starts ``full.text``.

    Only the prefix lengths that occur are cut from the full texts, and the join is an equi-join on the prefix,
    so it emits true matches only.
    """
    lengths = [r[0] for r in short.select(F.length(prefix)).distinct().collect()]  # at most the longest name
    if not lengths:
        lengths = [0]
    cut = full.withColumn("_n", F.explode(F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length(text))))
    cut = cut.withColumn("_prefix", F.substring(F.col(text), F.lit(1), F.col("_n"))).drop("_n")
    # every text is cut many times: its size on disk says little about the join, so nothing is broadcast
    return short.join(cut.hint("merge"), short[prefix] == cut["_prefix"]).drop("_prefix")


def rule_matches(todo: DataFrame, candidates: DataFrame, names: DataFrame) -> DataFrame:
    """Rule cascade for names without an exact match: truncated prefix, equal normal form, equal word set.

    ``todo``: name. ``candidates``: product_id, name. A rule with more than one ID is ambiguous; a later rule is
    tried only if the earlier one found nothing.
    """
    info = names.select("name", "norm", "word_key", "pack", "truncated")
    # names of many IDs are looked up once; a name-ID table is small on disk and large in memory, so it is never broadcast
    ids = settle(candidates.select(F.col("name").alias("c_name"), ID).distinct(), "candidate_ids").hint("merge")
    cand = settle(ids.select(F.col("c_name").alias("name")).distinct().join(info, "name").select(
        *[F.col(c).alias(f"c_{c}") for c in ("name", "norm", "word_key", "pack", "truncated")]), "candidates")
    mine = settle(todo.select("name").distinct().join(info, "name"), "todo")
    cut = F.regexp_replace("name", r"\s*\.\.\.$", "")
    short = mine.where("truncated").withColumn("prefix", cut).withColumn("norm_prefix", T.normalize(cut))
    raw = prefix_hits(short, cand, "prefix", "c_name")
    rest = short.join(raw.select("name").distinct(), "name", "left_anti")
    loose = prefix_hits(rest, cand, "norm_prefix", "c_norm")
    fits = T.same_pack("pack", "truncated", "c_pack", "c_truncated")
    by_prefix = (raw.unionByName(loose).where(fits).select("name", "c_name").join(ids, "c_name")
                 .select("name", ID, F.lit("3b_truncated_prefix").alias("rule")))
    few = (F.countDistinct(ID).alias("n_ids"), F.min(ID).alias("_id"))

    def equal(key: str, rule: str) -> DataFrame:
        """IDs are counted per key first: a frequent key is one row of the join, not one per ID."""
        found = cand.select("c_name", F.col(f"c_{key}").alias(key)).join(ids, "c_name").groupBy(key).agg(*few)
        return mine.join(found, key).select("name", F.lit(rule).alias("rule"), "n_ids", "_id")
    found = (by_prefix.groupBy("name", "rule").agg(*few)
             .unionByName(equal("norm", "3c_normalized")).unionByName(equal("word_key", "3d_word_order")))
    best = found.groupBy("name").agg(F.min(F.struct("rule", "n_ids", "_id")).alias("_b"))   # rule names sort in priority order
    one = F.col("_b.n_ids") == 1
    rules = mine.select("name").join(best, "name", "left").select(
        "name", F.when(F.col("_b").isNull(), "no_rule_match").when(one, F.col("_b.rule")).otherwise(F.concat("_b.rule", F.lit("_ambiguous"))).alias("rule"),
        F.when(one, F.col("_b._id")).alias("series_id"), F.coalesce("_b.n_ids", F.lit(0)).alias("n_ids"))
    return settle(rules, "rules")


def never_same_day(pairs: DataFrame, rows: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of names without a common day."""
    pairs = settle(pairs, "pairs")
    used = pairs.select(F.explode(F.array(a, b)).alias("name")).distinct()
    seen = rows.join(used, "name", "left_semi").select("name", F.unix_date("date").alias("_day")).distinct()     # one row a day, combined map-side
    days = seen.groupBy("name").agg(F.collect_list("_day").alias("_d"))    # calendar days; a set would have Spark drop the step before
    side = lambda c: days.select(F.col("name").alias(c), F.col("_d").alias(f"_{c}_days")).hint("merge")
    both = pairs.join(side(a), a, "left").join(side(b), b, "left")
    shared = F.coalesce(F.arrays_overlap(f"_{a}_days", f"_{b}_days"), F.lit(False))
    return both.where(~shared).select(*pairs.columns)


def truncation_groups(leftover: DataFrame, pre: DataFrame, names: DataFrame) -> DataFrame:
    """(name, group): a truncated leftover joins the only full leftover it fits; every other name is its own group."""
    info = settle(leftover.select("name").distinct().join(names.select("name", "norm", "pack", "truncated"), "name"), "leftover")
    full = info.where("not truncated").select(*[F.col(c).alias(f"c_{c}") for c in ("name", "norm", "pack", "truncated")])
    hits = prefix_hits(info.where("truncated"), full, "norm", "c_norm").where(T.same_pack("pack", "truncated", "c_pack", "c_truncated"))
    free = never_same_day(hits.select("name", "c_name"), pre, "name", "c_name")
    link = free.groupBy("name").agg(F.count("*").alias("_n"), F.min("c_name").alias("_g")).where("_n = 1")
    return settle(info.select("name").join(link, "name", "left").select("name", F.coalesce("_g", "name").alias("group")), "groups")


# --- blocking ------------------------------------------------------------------------------------------------
def char_grams(norm: Column) -> Column:
    """Character 3- to 5-grams inside each space-padded word, with repeats."""
    padded = F.transform(F.filter(F.split(norm, " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_word(w: Column) -> Column:
        sizes = F.filter(F.array(F.lit(3), F.lit(4), F.lit(5)), lambda n: n <= F.length(w))
        return F.flatten(F.transform(sizes, lambda n: F.transform(
            F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))))

    return F.flatten(F.transform(padded, of_word))


def gram_weights(docs: DataFrame) -> DataFrame:
    """Unit-length TF-IDF vectors (norm, gram, w, df). ``docs``: norm, copies (how often the text counts)."""
    terms = docs.select("norm", "copies", F.explode(char_grams(F.col("norm"))).alias("gram")).groupBy("norm", "copies", "gram").agg(F.count("*").alias("tf"))
    n = docs.agg(F.sum("copies")).scalar()
    df = terms.groupBy("gram").agg(F.sum("copies").alias("df"))
    # grams are many times the size of the texts they come from, by which Spark would broadcast them
    raw = terms.hint("merge").join(df, "gram").withColumn("x", F.col("tf") * (F.ln((1 + n) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("norm")))        # one text's grams
    return raw.select("norm", "gram", (F.col("x") / length).alias("w"), "df")


def _block_vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, row, gram, weight) of a block: its texts in the order of their numbers, and their vectors flat."""
    t = t.sort_by("n").combine_chunks()
    grams, w = t.column("grams").combine_chunks(), t.column("w").combine_chunks()
    rows = np.repeat(np.arange(len(t)), grams.value_lengths().to_numpy())
    return t.column("n").to_numpy(), rows, grams.flatten().to_numpy(), w.flatten().to_numpy()


def _nearest_in_block(k: int, slice_rows: int = 512, dense_bytes: int = 1 << 28):
    """The k nearest targets of every query of a block, by (-similarity in steps of 1e-7, place in text order).

    Grams of many targets are columns of dense matrices, the others are added along their postings.
    """
    def of_pair(queries: pa.Table, targets: pa.Table) -> pa.Table:
        out = pa.schema([("q", pa.int64()), ("top", pa.list_(pa.struct([("n", pa.int64()), ("c", pa.int64())])))])
        if not len(queries) or not len(targets):
            return out.empty_table()
        (qn, qr, qg, qw), (cn, cr, cg, cw) = _block_vectors(queries), _block_vectors(targets)
        common = np.intersect1d(qg, cg)
        mine, theirs = np.isin(qg, common), np.isin(cg, common)
        qr, qg, qw = qr[mine], np.searchsorted(common, qg[mine]), qw[mine]
        cr, cg, cw = cr[theirs], np.searchsorted(common, cg[theirs]), cw[theirs]
        m, postings = len(cn), np.bincount(cg, minlength=len(common))
        by_size = np.argsort(-postings, kind="stable")[:max(1, dense_bytes // (8 * m))]
        dense = by_size[postings[by_size] * 200 >= m]
        column = np.full(len(common), -1)
        column[dense] = np.arange(len(dense))
        flat = column[cg] >= 0
        right = np.zeros((len(dense), m))
        right[column[cg[flat]], cr[flat]] = cw[flat]
        order = np.argsort(cg[~flat], kind="stable")
        pg, pr, pw = cg[~flat][order], cr[~flat][order], cw[~flat][order]
        ids, tops, sizes = [], [], []
        for lo in range(0, len(qn), slice_rows):
            hi = min(lo + slice_rows, len(qn))
            a, b = np.searchsorted(qr, [lo, hi])
            r, g, w = qr[a:b] - lo, qg[a:b], qw[a:b]
            flat = column[g] >= 0
            left = np.zeros((hi - lo, len(dense)))
            left[r[flat], column[g[flat]]] = w[flat]
            sim = left @ right
            rare = np.argsort(g[~flat], kind="stable")
            r, g, w = r[~flat][rare], g[~flat][rare], w[~flat][rare]
            found, first = np.unique(g, return_index=True)
            for gram, i, j in zip(found, first, np.append(first[1:], len(g))):
                x, y = np.searchsorted(pg, [gram, gram + 1])
                sim[np.ix_(r[i:j], pr[x:y])] += np.outer(w[i:j], pw[x:y])
            key = np.where(sim > 0, np.floor(sim * 1e7 + 0.5).astype(np.int64) * m + (m - 1 - np.arange(m)), -1)
            if m > k:
                key = np.partition(key, m - k, axis=1)[:, m - k:]
            at, col = np.nonzero(key >= 0)
            key = key[at, col]
            tops.append((-(key // m), cn[m - 1 - key % m]))
            ids.append(qn[lo:hi])
            sizes.append(np.bincount(at, minlength=hi - lo))
        n, c = (pa.array(np.concatenate(x)) for x in zip(*tops))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
        return pa.Table.from_arrays([pa.array(np.concatenate(ids)), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([n, c], ["n", "c"]))], schema=out)
    return of_pair


def _in_one_number(of_pair):
    """A neighbour's similarity and place as one number in the same order, with the place in the lowest ``PLACE_BITS`` bits."""
    def packed(queries: pa.Table, targets: pa.Table) -> pa.Table:
        t = of_pair(queries, targets).combine_chunks()
        if not len(t):
            return pa.table({"q": t["q"], "top": pa.array([], pa.list_(pa.int64()))})
        top = t["top"].combine_chunks()
        n, c = (x.to_numpy() for x in top.flatten().flatten())
        return pa.table({"q": t["q"], "top": pa.ListArray.from_arrays(top.offsets, pa.array((n << PLACE_BITS) + c))})
    return packed


NORM_BLOCK = (1_000, 20_000)        # least and most texts of a block
PLACE_BITS = 38                     # of a neighbour's number; those above hold its similarity, which takes 25


def nearest_norms(queries: DataFrame, targets: DataFrame, weights: DataFrame, k: int, block: tuple[int, int] = NORM_BLOCK, tasks: int = 64) -> DataFrame:
    """Exact top-k cosine neighbours (q, c, sim) between two sets of texts; ties in the order of the texts."""
    pairs, texts = nearest_places(queries, targets, weights, k, block, tasks)
    text = lambda c: texts.select(F.col("n").alias(c), F.col("norm").alias(f"_{c}"))
    return pairs.join(text("q"), "q").join(text("c"), "c").select(F.col("_q").alias("q"), F.col("_c").alias("c"), "sim")


def nearest_places(queries: DataFrame, targets: DataFrame, weights: DataFrame, k: int, block: tuple[int, int] = NORM_BLOCK,
                   tasks: int = 64) -> tuple[DataFrame, DataFrame]:
    """Exact top-k cosine neighbours (q, c, sim) as places in text order, and the texts (n, norm) of the places.

    Every pair of texts that share a gram has to be compared, so the texts are dealt to blocks and every block of
    queries meets every block of targets as a product of matrices. No pair leaves a task but the k best of a query
    in a block: a task holds two blocks, and what is shuffled grows with the texts and the number of blocks.
    """
    weights = settle(weights, "grams")
    grams = settle(weights.select("gram").distinct().withColumn("_g", F.monotonically_increasing_id()), "gram_numbers")
    wanted = queries.select("norm", F.lit(0).alias("_side")).unionByName(targets.select("norm", F.lit(1).alias("_side"))).distinct()
    texts = settle(positions(wanted.groupBy("norm").agg(F.max(F.col("_side") == 0).alias("asks"), F.max(F.col("_side") == 1).alias("offers")), [], ["norm"], "n"), "texts")
    vectors = weights.hint("merge").join(grams, "gram").groupBy("norm").agg(F.collect_list("_g").alias("grams"), F.collect_list("w").alias("w"))  # one text's grams
    vectors = settle(texts.join(vectors.hint("merge"), "norm").select("n", "asks", "offers", "grams", "w"), "vectors")
    n_q, n_c = vectors.where("asks").count(), vectors.where("offers").count()
    size = min(block[1], max(block[0], math.isqrt(n_q * n_c // tasks)))
    q_blocks, c_blocks = (max(1, -(-n // size)) for n in (n_q, n_c))

    def dealt(side: str, mine: str, own: int, other: str, others: int) -> DataFrame:
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        rows = vectors.where(side).select(F.pmod(F.xxhash64("n"), F.lit(own)).cast("int").alias(mine), each, "n", "grams", "w")
        return rows.repartition(q_blocks * c_blocks, "_bq", "_bc").groupBy("_bq", "_bc")
    best = dealt("asks", "_bq", q_blocks, "_bc", c_blocks).cogroup(dealt("offers", "_bc", c_blocks, "_bq", q_blocks)).applyInArrow(
        _in_one_number(_nearest_in_block(k)), "q long, top array<long>")
    top = best.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))      # k a block
    top = settle(top, "nearest")
    discard(weights, grams, vectors)
    pairs = top.select("q", F.explode("top").alias("_t")).hint("merge").select(
        "q", F.col("_t").bitwiseAND((1 << PLACE_BITS) - 1).alias("c"), F.round(-F.shiftright("_t", PLACE_BITS) / 1e7, 7).alias("sim"))
    return pairs, texts.hint("merge")


def blocked_candidates(groups: DataFrame, candidates: DataFrame, names: DataFrame, top_names: int = V.BLOCK_TOP_NAMES,
                       top_ids: int = V.BLOCK_TOP_IDS) -> DataFrame:
    """(group, product_id, candidate_name, place): the nearest IDs among each group's nearest candidate names."""
    info = names.select("name", "norm")
    # texts that share their words are small on disk and large in memory, so no table of names per group or ID is broadcast
    g = settle(groups.select(F.col("group").alias("name")).distinct().join(info, "name"), "asked").hint("merge")
    c = settle(candidates.select(ID, "name").distinct().join(info, "name"), "offered").hint("merge")
    docs = g.select("norm").unionAll(c.select("norm")).groupBy("norm").agg(F.count("*").alias("copies"))
    # everything up to the last join is done per text, on places in text order in place of the texts
    near, texts = nearest_places(g, c, gram_weights(docs), top_names)
    # more than top_names rows of one text can never be used
    first = Window.partitionBy("c").orderBy(ID, "name")
    few = c.join(texts.withColumnRenamed("n", "c"), "norm").select("c", ID, "name").withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= top_names)
    few = settle(few, "candidate_rows").hint("merge")
    # texts whose rows come after the first top_names rows of nearer texts are left out before rows are joined
    per_text = few.groupBy("c").agg(F.count("*").alias("_n"))
    nearer = Window.partitionBy("q").orderBy(F.desc("sim"), "c").rowsBetween(Window.unboundedPreceding, -1)
    near = near.join(per_text, "c").withColumn("_before", F.coalesce(F.sum("_n").over(nearer), F.lit(0))).where(F.col("_before") < top_names)
    place = Window.partitionBy("q").orderBy(F.desc("sim"), "c", "_k")
    rows = near.select("q", "c", "sim").join(few.select("c", "_k", ID), "c").withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= top_names)
    ids = rows.groupBy("q", ID).agg(F.min(F.struct("_r", "c", "_k", "sim")).alias("_b"))
    by_place = Window.partitionBy("q").orderBy("_b._r")
    best = (ids.withColumn("place", F.row_number().over(by_place)).where(F.col("place") <= top_ids)
            .select("q", ID, F.col("_b.c").alias("c"), F.col("_b._k").alias("_k"), F.col("_b.sim").alias("cosine"), "place"))
    asked = g.join(texts.withColumnRenamed("n", "q"), "norm").select("q", F.col("name").alias("group"))
    return (best.join(few.select("c", "_k", F.col("name").alias("candidate_name")), ["c", "_k"]).join(asked.hint("merge"), "q")
            .select("group", ID, "candidate_name", "cosine", "place"))


# --- edges and one-to-one assignment -----------------------------------------------------------------------------
def handover_edges(blocked: DataFrame, group_rows: DataFrame, id_rows: DataFrame, candidates: DataFrame, names: DataFrame,
                   outage: tuple | None = None) -> DataFrame:
    """Eligible (group, series_id) links with gap, price ratio, name similarity and score.

    ``group_rows``: group, date, price. ``id_rows``: series_id, date, price. An ID qualifies when all its
    observations lie after the group's last day, so only its first observation matters.
    """
    g = group_rows.groupBy("group").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"),
        F.max_by("price", F.when(F.col("price").isNotNull(), F.struct("date", "price"))).alias("last_price"))
    i = id_rows.groupBy(F.col("series_id").alias(ID)).agg(F.min(F.struct("date", "price")).alias("_f")).select(
        ID, F.col("_f.date").alias("next_date"), F.col("_f.price").alias("next_price"))
    info = names.select("name", "norm", "pack", "truncated")
    e = (settle(blocked, "blocked").hint("merge").join(g, "group").join(i.hint("merge"), ID).where(F.col("next_date") > F.col("last"))
         .withColumn("price_ratio", ratio("next_price", "last_price"))
         .where(F.col("price_ratio").between(1 / V.MAX_PRICE_RATIO, V.MAX_PRICE_RATIO))
         .join(info.select(F.col("name").alias("group"), F.col("norm").alias("g_norm"), F.col("pack").alias("g_pack"), F.col("truncated").alias("g_t")), "group")
         .join(info.select(F.col("name").alias("candidate_name"), F.col("norm").alias("c_norm"), F.col("pack").alias("c_pack"), F.col("truncated").alias("c_t")), "candidate_name")
         .where(T.same_pack("g_pack", "g_t", "c_pack", "c_t")))
    gap = K.effective_gap("last", "next_date", outage) if outage else F.datediff("next_date", "last")
    e = settle(e.withColumn("gap_days", gap), "handovers").hint("merge")
    texts = candidates.select(ID, "name").distinct().join(info.select("name", "norm"), "name").select(ID, F.col("norm").alias("id_norm")).distinct()
    sims = (e.select("group", ID, "g_norm").join(texts, ID).select("group", ID, T.token_sort_similarity("g_norm", "id_norm").alias("s"))
            .groupBy("group", ID).agg(F.max("s").alias("name_sim")))
    enough = F.col("name_sim") >= F.when(F.col("gap_days") <= V.SHORT_GAP_DAYS, V.NAME_MIN_SHORT_GAP).otherwise(V.NAME_MIN_LONG_GAP)
    close = 1 - F.abs(F.ln("price_ratio")) / F.ln(F.lit(V.MAX_PRICE_RATIO))
    return (e.join(sims, ["group", ID]).where(enough).where(T.token_guard("g_norm", "c_norm"))
            .withColumn("score", 0.6 * F.col("name_sim") / 100 + 0.4 * close)
            .select("group", F.col(ID).alias("series_id"), "candidate_name", "gap_days", "price_ratio", "name_sim", "score"))


def components(edges: DataFrame) -> DataFrame:
    """Adds ``component``, the smallest group name reachable, to (group, series_id) links of any length of chain."""
    nodes = edges.select(F.concat(F.lit("g"), "group").alias("a"), F.concat(F.lit("s"), F.col("series_id").cast("string")).alias("b"))
    found = graph.components(nodes).where("node like 'g%'").select(F.substring("node", 2, 1 << 30).alias("group"), F.substring("component", 2, 1 << 30).alias("component"))
    return edges.join(found, "group")


def _best_links(groups: list, series: list, scores: list) -> list:
    """Places of the links chosen within one component: most links first, then highest total score.

    Every group may also stay alone, at a cost above any sum of scores. Groups enter in turn; each follows
    the cheapest way over reduced costs, which prices keep from being negative, to an ID nobody holds or to
    a group that is cheapest left alone. A heap settles every ID at most once per group.
    """
    if len(groups) == 1:
        return [0]
    number_of = ({}, {})
    left, right = ([seen.setdefault(x, len(seen)) for x in ends] for seen, ends in zip(number_of, (groups, series)))
    best = max(scores)
    cost = [best - s for s in scores]
    n, m = len(number_of[0]), len(number_of[1])
    alone = (n + 1) * (max(cost) + 1.0)
    ways = [[(m + g, alone, -1)] for g in range(n)]            # (place, cost, edge); places from m on mean alone
    for e, g in enumerate(left):
        ways[g].append((right[e], cost[e], e))
    worth, price, holder, held = [0.0] * n, [0.0] * (m + n), [-1] * (m + n), [-1] * n
    for source in range(n):
        far, came, done, heap = {}, {}, {}, []
        g, base = source, 0.0
        while True:
            for place, c, e in ways[g]:
                d = base + c - worth[g] - price[place]
                if place not in done and d < far.get(place, math.inf):
                    far[place], came[place] = d, (g, e)
                    heapq.heappush(heap, (d, place))
            base, place = heapq.heappop(heap)
            while place in done:
                base, place = heapq.heappop(heap)
            done[place] = base
            if holder[place] < 0:
                break
            g = holder[place]
        worth[source] += base
        for p, d in done.items():
            if p != place:
                worth[holder[p]] += base - d
            price[p] -= base - d
        while True:
            g, e = came[place]
            holder[place], before = g, held[g]
            held[g] = place
            if g == source:
                break
            place = before
    kept = {(g, p) for g, p in enumerate(held) if p < m}
    return [e for e, ends in enumerate(zip(left, right)) if ends in kept]


def _assign(edges: pd.DataFrame) -> pd.DataFrame:
    """The links chosen within one component."""
    edges = edges.sort_values(["group", "series_id"]).reset_index(drop=True)
    return edges.iloc[_best_links(*(edges[c].tolist() for c in ("group", "series_id", "score")))]


def _assign_sorted(batches):
    """The links chosen, for links sorted by component, group and ID; components run on from batch to batch.

    A task solves its components one after the other in plain lists: most have a few links, for which a call of
    its own per component costs far more than the solution.
    """
    def chosen(t: pd.DataFrame) -> pd.DataFrame:
        name = t["component"].to_numpy()
        ends = [*(np.flatnonzero(name[1:] != name[:-1]) + 1).tolist(), len(t)]
        groups, series, scores = (t[c].tolist() for c in ("group", "series_id", "score"))
        kept, lo = [], 0
        for hi in ends:
            kept += [lo + e for e in _best_links(groups[lo:hi], series[lo:hi], scores[lo:hi])]
            lo = hi
        return t.iloc[kept]
    open_ = []
    for b in batches:
        if not len(b):
            continue
        name = b["component"].to_numpy()
        if open_ and name[-1] == open_[-1]["component"].iat[-1]:
            open_.append(b)         # the same component still
            continue
        cut = int(np.flatnonzero(name != name[-1])[-1]) + 1 if name[0] != name[-1] else 0
        whole = pd.concat([*open_, b.iloc[:cut]]) if open_ else b.iloc[:cut]
        if len(whole):
            yield chosen(whole)
        open_ = [b.iloc[cut:]]
    if open_:
        yield chosen(pd.concat(open_))


SMALL_LINKS = 20_000        # a component of so many links at most is solved in one call


def assign_links(edges: DataFrame, small: int = SMALL_LINKS, chunk_links: int = auctions.CHUNK_LINKS) -> DataFrame:
    """One-to-one links with most pairs first, then the highest total score.

    Components of up to ``small`` links are solved one by one, each in one call; larger ones bid in an auction whose
    tasks hold ``chunk_links`` links at most, so that no component, however large, meets in one task.
    """
    tier = F.when(F.col("gap_days") <= V.SHORT_GAP_DAYS, "5_handover_short_gap").otherwise("5_handover_long_gap")
    parts = settle(components(edges), "parts")
    large = settle(parts.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > small).select("component"), "large")
    tasks = max(1, -(-parts.count() // small))       # dealt by links: the work lies in the solver, not in the bytes
    links = (parts.join(large, "component", "left_anti").select(*parts.columns).repartition(tasks, "component")
             .sortWithinPartitions("component", "group", "series_id").mapInPandas(_assign_sorted, parts.schema))
    if not large.isEmpty():
        won = auctions.auction(parts.join(large, "component", "left_semi").select(*parts.columns), chunk_links)
        links = links.unionByName(won.select(*parts.columns))
    return settle(links.drop("component").withColumn("tier", tier), "assigned")


# --- unified map --------------------------------------------------------------------------------------------------
def numbered(df: DataFrame, key: str, prefix: str, out: str) -> DataFrame:
    """Distinct keys with dense text numbers in key order ('n_0000', ...). Numbers are cut into key ranges first."""
    keys = settle(df.select(key).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id()), "keys")
    sizes = keys.groupBy("_p").agg(F.count("*").alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    number = F.col("_before") + inside - 1
    text = F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    return keys.join(F.broadcast(sizes), "_p").select(key, F.concat(F.lit(prefix), text).alias(out))  # one row per partition


def leftover_map(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(name, group, series_id, method): assigned groups take their ID, the others get a series of their own."""
    joined = groups.join(links.select("group", F.col("series_id").alias("_sid"), "tier"), "group", "left")
    own = numbered(joined.where("_sid is null"), "group", "n_", "_own")
    method = F.coalesce("tier", F.lit("6_own_series"))
    return joined.join(own, "group", "left").select(
        "name", "group", F.coalesce("_sid", "_own").alias("series_id"),
        F.when(F.col("name") != F.col("group"), F.concat(method, F.lit("+4_trunc_link"))).otherwise(method).alias("method"))


def main_ids(post: DataFrame) -> DataFrame:
    """Most frequent ID per later name, and whether the name carries several."""
    best = most_frequent(post, ["name"], ID, "series_id").drop("n")
    n = post.groupBy("name").agg(F.countDistinct(ID).alias("_n"))
    return best.join(n, "name").select("name", "series_id", F.when(F.col("_n") > 1, "0_id_era_multi_id").otherwise("0_id_era").alias("method"))


def first_source(sources: Sequence[DataFrame], key: str = "name") -> DataFrame:
    """Union of sources in priority order; the first that knows a key wins."""
    all_rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_p", F.lit(i))
        all_rows = s if all_rows is None else all_rows.unionByName(s)
    others = [c for c in all_rows.columns if c not in (key, "_p")]
    return all_rows.groupBy(key).agg(F.min(F.struct("_p", *others)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others])


def name_map(post: DataFrame, pre_map: DataFrame) -> DataFrame:
    """Every name with series, method and era: later names by their main ID, earlier ones as mapped.

    A name of both eras has a row for each; ``pre_id_method`` of its later row says how the early one was mapped.
    """
    early = pre_map.select("name", "series_id", "method")
    later = main_ids(post).select("name", "series_id", "method").join(early.select("name", F.col("method").alias("pre_id_method")), "name", "left")
    return (later.withColumn("era", F.lit("id_era"))
            .unionByName(early.withColumn("pre_id_method", F.col("method")).withColumn("era", F.lit("pre_id"))))


def unassigned_by_month(group_rows: DataFrame, links: DataFrame) -> DataFrame:
    """Groups without a link, and their rows, by the month in which they were last seen. ``group_rows``: group, date."""
    last = group_rows.groupBy("group").agg(F.max("date").alias("last"), F.count("*").alias("rows"))
    return (last.join(links.select("group").distinct(), "group", "left_anti").groupBy(F.date_format("last", "yyyy-MM").alias("month"))
            .agg(F.count("*").alias("groups"), F.sum("rows").alias("rows")))


def method_rank(method: Column, ranks: Mapping[str, int] = V.METHOD_RANK) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    return F.try_element_at(table, F.split_part(method, F.lit("+"), F.lit(1)))


def _first_come(batches):
    """(name, kept) of names sorted by series and priority. A series is one number whose bits are its busy days."""
    series, busy = None, 0
    for b in batches:
        kept = []
        for s, days in zip(b.column("series_id").to_pylist(), b.column("days").to_pylist()):
            if s != series:
                series, busy = s, 0
            own = 0
            for d in days:
                own |= 1 << d
            kept.append(not own & busy)
            busy |= own if kept[-1] else 0
        yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(kept, pa.bool_())], ["name", "kept"])


def one_name_per_day(pre_map: DataFrame, pre: DataFrame) -> DataFrame:
    """Keeps names of a series in priority order and demotes a name that shares a day with a kept one.

    One pass: names are dealt by series, sorted by priority and streamed, and only the busy days of the series at
    hand are held (one bit a day). A name is one row, whose days are bounded by the calendar.
    """
    first = pre.agg(F.min("date")).first()[0]
    day = F.datediff("date", F.lit(first).cast("date"))
    own = pre.groupBy("name").agg(F.count("*").alias("rows"), F.array_compact(F.collect_set(day)).alias("days"))
    order = ["series_id", "_rank", F.desc("rows"), "name"]
    ranked = pre_map.join(own, "name").withColumn("_rank", method_rank(F.col("method")))
    judged = settle(ranked.repartition("series_id").sortWithinPartitions(*order).select("series_id", "name", "days")
                    .mapInArrow(_first_come, "name string, kept boolean"), "judged")
    out = pre_map.join(judged.where("not kept").select("name", F.lit(True).alias("_d")), "name", "left")
    fresh = numbered(out.where("_d"), "name", "d_", "_new")
    return out.join(fresh, "name", "left").select(
        "name", F.coalesce("_new", "series_id").alias("series_id"),
        F.when(F.col("_d"), "6_own_series (demoted overlap)").otherwise(F.col("method")).alias("method"))


def mapped_panel(rows: DataFrame, pre_map: DataFrame) -> DataFrame:
    """Every row with its series and method; rows that found none keep a null series."""
    m = pre_map.select("name", F.col("series_id").alias("_s"), F.col("method").alias("_m"))
    has = F.col(ID).isNotNull()
    return (rows.join(m, "name", "left").withColumn("series_id", F.coalesce(ID, "_s"))
            .withColumn("method", F.when(has, "0_id_era").otherwise(F.col("_m"))).drop("_s", "_m"))


def unmapped_rows(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("rows"), F.count_if(F.col("series_id").isNull()).alias("unmapped"))


def assignment_quality(links: DataFrame) -> DataFrame:
    """Per tier: links, exact medians of similarity, gap and absolute price change, share at the same price."""
    from ..common import exact_quantiles
    df = links.withColumn("_c", 100 * F.abs(F.col("price_ratio") - 1))
    out = df.groupBy("tier").agg(F.count("*").alias("groups"),
                                 F.avg((F.abs(F.col("price_ratio") - 1) <= 1e-8 + 1e-5).cast("double")).alias("same_price_share"))
    for c, name in (("name_sim", "median_name_sim"), ("gap_days", "median_gap_days"), ("_c", "median_abs_change_pct")):
        out = out.join(exact_quantiles(df, ["tier"], c, {name: 0.5}), "tier")
    return out


def stratified_sample(df: DataFrame, stratum: str, key: str, per: int, seed: int = V.SEED) -> DataFrame:
    """``per`` rows of each stratum in hashed order; the same rows on every run."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per).drop("_r")


def validation_sample(links: DataFrame, candidates: DataFrame, per: int = 30) -> DataFrame:
    """Rows to label by hand, with every name the ID ever had."""
    picked = settle(stratified_sample(links, "method", "name", per), "sample")      # ``per`` rows a method
    texts = (candidates.select(F.col(ID).alias("series_id"), "name").join(picked.select("series_id").distinct(), "series_id", "left_semi").distinct()
             .groupBy("series_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("id_names")))
    return picked.join(texts, "series_id", "left").withColumn("is_correct", F.lit(""))
