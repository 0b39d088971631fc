"""Main text of pages: structure first, then a suffix array per host removes what its pages share."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from shelfline.session import settle

from .html_blocks import Block, blocks
from .textkit import SPACE, words

RUN = 8                     # tokens of a long substring (a power of two)
MIN_PAGES = 3               # distinct pages that must share it
SHARD_PAGES = 256           # pages of a host that one suffix array covers
FACTOR = np.uint64(0x9E3779B97F4A7C15)   # of the hash of a run


def suffix_ranks(token: np.ndarray, length: int) -> np.ndarray:
    """Rank of each suffix by its first ``length`` tokens, by prefix doubling; equal beginnings, equal ranks.

    Past the end stands a token smaller than all others. ``np.argsort`` of the ranks is the suffix array to
    that depth.
    """
    rank, span = np.unique(token, return_inverse=True)[1].astype(np.int64) + 1, 1
    while span < length:
        later = np.concatenate([rank[span:], np.zeros(min(span, len(rank)), np.int64)])
        rank = np.unique(rank * (len(rank) + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        span *= 2
    return rank


def shared_tokens(page: np.ndarray, token: np.ndarray, run: int = RUN, min_pages: int = MIN_PAGES) -> np.ndarray:
    """Which tokens of the concatenated page streams lie in a substring of ``run`` tokens that occurs on
    ``min_pages`` distinct pages. ``page`` is sorted; a substring lies within one page."""
    n = len(token)
    covered = np.zeros(n + 1, np.int64)
    if n >= run:
        rank = suffix_ranks(token, run)[:n - run + 1]
        whole = np.flatnonzero(page[:n - run + 1] == page[run - 1:])
        array = whole[np.lexsort((page[whole], rank[whole]))]              # the suffix array of substrings within a page
        fresh = np.concatenate(([True], rank[array][1:] != rank[array][:-1])) if len(array) else np.zeros(0, bool)
        other = np.concatenate(([True], page[array][1:] != page[array][:-1])) if len(array) else fresh
        group = np.cumsum(fresh) - 1
        often = np.bincount(group, fresh | other) >= min_pages if len(array) else fresh
        hit = array[often[group]] if len(array) else array
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + run, -1)
    return np.cumsum(covered)[:n] > 0


def run_hashes(page: np.ndarray, token: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Where each substring of ``run`` tokens within one page begins, and its hash."""
    n = max(len(token) - run + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(run if n else 0):
        out = out * FACTOR + token[i:i + n].astype(np.uint64)
    whole = np.flatnonzero(page[:n] == page[run - 1:]) if n else np.zeros(0, np.int64)
    return whole, out[whole].view(np.int64)


def listed_tokens(page: np.ndarray, token: np.ndarray, runs: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a substring of ``run`` tokens whose hash is one of ``runs``."""
    at, found = run_hashes(page, token, run)
    hit, covered = at[np.isin(found, runs)], np.zeros(len(token) + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + run, -1)
    return np.cumsum(covered)[:len(token)] > 0


def _tokens(pages: list[list[Block]]):
    """The blocks of all pages, their words, and the page of each word."""
    flat = [(i, b) for i, page in enumerate(pages) for b in page]
    w = words([b.text.encode("utf-8") for _, b in flat], ~SPACE)
    return flat, w, np.array([i for i, _ in flat], np.int64)[w.doc]


def main_texts(pages: list[list[Block]], runs: np.ndarray | None = None) -> tuple[list[str], list[int]]:
    """Main text of each page of one group of pages of a host, and how many blocks lost words.

    A page's content zone is its main text. Without one, blocks outside page furniture are, less the runs of
    words that the host's pages share: those whose hashes are ``runs``, or, if the group is the whole host
    (None), those its suffix array finds. Of a block, the unique runs stay.
    """
    flat, w, owner = _tokens(pages)
    shared = shared_tokens(owner, w.hash) if runs is None else listed_tokens(owner, w.hash, runs)
    first = np.searchsorted(w.doc, np.arange(len(flat) + 1))
    texts, lost, at = [], [], 0
    for page in pages:
        whole, cut = any(b.zone == "content" for b in page), 0
        kept = []
        for k, b in enumerate(page, at):
            if whole:
                kept += [b.text] if b.zone == "content" else []
            elif b.zone == "open":
                gone = shared[first[k]:first[k + 1]]
                cut += bool(gone.any())
                unique = " ".join(x for x, g in zip(b.text.split(" "), gone) if not g) if gone.any() else b.text
                kept += [unique] if unique else []
        at += len(page)
        texts.append("\n\n".join(kept))
        lost.append(cut)
    return texts, lost


def shared_runs(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """_host, _shard, run: hashes of the runs that ``min_pages`` pages of the whole host share, for each shard
    with a page that needs them, one without a content zone. Hosts without such a page count nothing.

    A row is a page, so pages are counted per batch and then summed by host and run: no host meets in one task.
    """
    def parsed(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield part, [blocks(h) for h in part.column("html").to_pylist()]

    def undecided(batches):
        for part, found in parsed(batches):
            hosts = {h for h, page in zip(part.column("_host").to_pylist(), found) if page and not any(b.zone == "content" for b in page)}
            yield pa.RecordBatch.from_pydict({"_host": pa.array(sorted(hosts), pa.string())})

    def count(batches):
        for part, found in parsed(batches):
            _, w, owner = _tokens(found)
            at, run = run_hashes(owner, w.hash)
            each = pd.DataFrame({"page": owner[at], "run": run}).drop_duplicates()
            asks = np.array([not any(b.zone == "content" for b in page) for page in found], bool)
            each["_host"] = part.column("_host").to_pandas().to_numpy()[each.page]
            each["_shard"] = np.where(asks[each.page], part.column("_shard").to_numpy()[each.page], -1)
            sums = each.groupby(["_host", "_shard", "run"], sort=False).size().reset_index(name="n")
            yield pa.RecordBatch.from_pandas(sums.astype({"n": "int64", "_shard": "int64"}), pa.schema(
                [("_host", pa.string()), ("_shard", pa.int64()), ("run", pa.int64()), ("n", pa.int64())]), preserve_index=False)
    hosts = settle(pages.select("_host", "html").mapInArrow(undecided, "_host string").distinct(), "undecided")
    counted = settle(pages.join(hosts, "_host", "left_semi").mapInArrow(count, "_host string, _shard long, run long, n long")
                     .groupBy("_host", "_shard", "run").agg(F.sum("n").alias("n")), "runs")
    often = counted.groupBy("_host", "run").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pages).drop("n")
    return counted.where("_shard >= 0").join(often, ["_host", "run"]).select("_host", "_shard", "run")


def extract(pages: DataFrame, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_cut (blocks that lost shared words), one row per page.

    Pages of a host are parsed and searched together, at most about ``shard_pages`` in a group: a host with
    more pages is dealt into groups by hash, so that no host meets in one task. What its pages share is then
    counted over the whole host (``shared_runs``), so that the size of a group decides nothing. Null html
    gives empty text; a null url is a host of its own. The table of large hosts is settled first, so that
    Spark knows its size when it picks the join.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", "html", host.alias("_host"))
    large = settle(rows.groupBy("_host").agg(F.count("*").alias("_n")).where(F.col("_n") > shard_pages), "hosts")
    shards = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(shard_pages))
    shard = F.pmod(F.xxhash64("page_id", "url"), shards)
    dealt = rows.join(large, "_host", "left").withColumn("_shard", shard).withColumn("_large", F.col("_n").isNotNull()).drop("_n")
    runs = shared_runs(rows.join(large, "_host").select("_host", shard.alias("_shard"), "html"))

    def group(table: pa.Table) -> pa.Table:
        run = table.column("_run")
        table, listed = table.filter(run.is_null()), run.drop_null().to_numpy()
        listed = listed if table.num_rows and table.column("_large")[0].as_py() else None
        texts, lost = main_texts([blocks(h) for h in table.column("html").to_pylist()], listed)
        return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()),
                         "n_chars": pa.array([len(t) for t in texts], pa.int64()), "n_cut": pa.array(lost, pa.int64())})
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType()), T.StructField("n_cut", T.LongType())])
    # the runs travel as rows beside the pages of their shard: one shuffle and one sort, as for the pages alone
    both = dealt.withColumn("_run", F.lit(None).cast("long")).unionByName(runs.withColumnRenamed("run", "_run"), allowMissingColumns=True)
    return both.groupBy("_host", "_shard").applyInArrow(group, schema)
