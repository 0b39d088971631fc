"""One-to-one links with most pairs first, then the highest total score, by a distributed auction.

Groups bid for IDs. A component that fits into a chunk is settled in one task. Of larger ones each bidding round is one
join of the open chunks of links with the prices of their IDs and one maximum per ID, so they never meet in one task. Scores are whole numbers and the last step is too small to
cost a whole point over all bidders, which makes the result exact.
"""
from __future__ import annotations

from collections import deque
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle

CHUNK_LINKS = 1_000_000     # links (of both copies) that one task bids with
TASK_LINKS = 20_000         # links of whole components that one task solves
RESOLUTION = 10 ** 9        # whole points per unit of score
SHRINK = (64, 10_000)       # factor between the steps of two phases: in one chunk, in several (fewer rounds)
_BIDS = "right long, price decimal(38,0), phase int, holder long"


def both_ways(links: DataFrame) -> DataFrame:
    """(left, right, real, points): the links and their mirror image, where everybody finds a partner.

    Left are groups (even) and mirrored IDs (odd), right are IDs (even) and mirrored groups (odd). A group may also
    take its own mirror image, an ID likewise. A best perfect matching of both copies holds a best set of links, and
    prices may start anywhere, as nobody is left over whose price had to be zero.
    """
    g, s = F.col("g"), F.col("s")
    alone = F.lit(0)
    row = lambda l, r, real, points: links.select(l.alias("left"), r.alias("right"), real.alias("real"), points.alias("points"),
                                                  "component", s.alias("anchor"))
    real = row(2 * g, 2 * s, F.lit(1), F.col("points")).unionByName(row(2 * s + 1, 2 * g + 1, F.lit(1), F.col("points")))
    own = row(2 * g, 2 * g + 1, alone, alone.cast("long")).unionByName(row(2 * s + 1, 2 * s, alone, alone.cast("long")))
    return real.unionByName(own.groupBy("left", "right", "real", "points", "component").agg(F.min("anchor").alias("anchor")))


def bid(ways: dict[int, list[tuple[int, int]]], price: dict[int, int], holder: dict[int, int], step: int) -> set[int]:
    """Bids of all who hold nothing, until everybody in ``ways`` holds something; returns what changed hands.

    A bidder offers for the best what it is worth above the second best, and ``step`` more. ``price`` and
    ``holder`` are brought up to date. Holders elsewhere may lose what they hold; they learn of it in the next round.
    """
    holding = {p for p in holder.values() if p in ways}
    queue, changed = deque(sorted(p for p in ways if p not in holding)), set()
    while queue:
        bidder = queue.popleft()
        best = second = target = None
        for right, value in ways[bidder]:
            worth = value - price.get(right, 0)
            if best is None or worth > best:
                best, second, target = worth, best, right
            elif second is None or worth > second:
                second = worth
        loser = holder.get(target)
        if loser in ways:
            queue.append(loser)
        price[target] = price.get(target, 0) + (0 if second is None else best - second) + step
        holder[target] = bidder
        changed.add(target)
    return changed


def _round(step: int, phase: int, big: int, unit: int):
    """The bids of one chunk, given the prices and holders of what its members may take."""
    def of_chunk(links, offers):
        ways: dict[int, list[tuple[int, int]]] = {}
        for l, r, real, points in zip(*[links.column(c).to_pylist() for c in ("left", "right", "real", "points")]):
            ways.setdefault(l, []).append((r, (big * real + points) * unit))
        rows = list(zip(*[offers.column(c).to_pylist() for c in ("right", "price", "holder")]))
        price = {r: int(p) for r, p, _ in rows if p is not None}
        holder = {r: h for r, _, h in rows if h is not None}
        changed = sorted(bid(ways, price, holder, step))
        return pa.table({"right": pa.array(changed, pa.int64()), "price": pa.array([Decimal(price[r]) for r in changed], pa.decimal128(38, 0)),
                         "phase": pa.array([phase] * len(changed), pa.int32()), "holder": pa.array([holder[r] for r in changed], pa.int64())})
    return of_chunk


def _solve(links: list[tuple[int, int, int]], n_groups: int, n_ids: int, resolution: int) -> list[tuple[int, int]]:
    """All phases of the auction over one component, (group, ID, points) with numbers from 0; returns the chosen pairs."""
    big, unit = (n_groups + 1) * (resolution + 1), n_groups + n_ids + 1
    ways: dict[int, list[tuple[int, int]]] = {}
    for g, s, points in links:
        worth = (big + points) * unit
        ways.setdefault(2 * g, []).append((2 * s, worth))
        ways.setdefault(2 * s + 1, []).append((2 * g + 1, worth))
    for g in range(n_groups):
        ways[2 * g].append((2 * g + 1, 0))
    for s in range(n_ids):
        ways[2 * s + 1].append((2 * s, 0))
    price, step = {}, max(1, big * unit // SHRINK[0])
    while True:
        holder: dict[int, int] = {}
        bid(ways, price, holder, step)
        if step == 1:
            return [(h // 2, r // 2) for r, h in holder.items() if r % 2 == 0 and h % 2 == 0]
        step = max(1, step // SHRINK[0])


def _of_component(resolution: int):
    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by([("group", "ascending"), ("series_id", "ascending")])
        g, s = (t.column(c).combine_chunks().dictionary_encode() for c in ("group", "series_id"))
        pairs = _solve(list(zip(g.indices.to_pylist(), s.indices.to_pylist(), t.column("points").to_pylist())), len(g.dictionary), len(s.dictionary), resolution)
        return pa.table({"group": g.dictionary.take(pa.array([p[0] for p in pairs], pa.int64())),
                         "series_id": s.dictionary.take(pa.array([p[1] for p in pairs], pa.int64()))})
    return solve


def auction(edges: DataFrame, chunk_links: int = CHUNK_LINKS, resolution: int = RESOLUTION) -> DataFrame:
    """The chosen rows of ``edges`` (group, series_id, score, component, ...): every group and ID at most once.

    The number of pairs is the greatest possible, and the total of the scores, rounded to whole points, the
    greatest possible for it. Scores lie between 0 and 1; a link that repeats counts with its best row. An empty
    table gives no links. A component that fits into a chunk holds its own auction in one task, without rounds;
    only larger ones are cut up (``_across_chunks``).
    """
    rows = settle(edges.withColumn("_row", F.monotonically_increasing_id()), "links")
    points = F.round(F.col("score") * resolution).cast("long")
    best = settle(rows.groupBy("group", "series_id", "component").agg(F.max(points).alias("points")), "best")
    large = settle(best.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") * 4 > chunk_links).select("component"), "large")
    whole = best.join(large, "component", "left_anti")
    n_whole = whole.count()
    if not n_whole and large.isEmpty():
        return edges
    pairs = best.select("group", "series_id").schema
    chosen = (whole.repartition(max(1, -(-n_whole // TASK_LINKS)), "component").groupBy("component").applyInArrow(_of_component(resolution), pairs))
    if not large.isEmpty():
        chosen = chosen.unionByName(_across_chunks(best.join(large, "component", "left_semi").select(*best.columns), chunk_links, resolution))
    one = (rows.join(settle(chosen, "chosen"), ["group", "series_id"]).groupBy("group", "series_id").agg(F.max(F.struct("score", "_row")).alias("_b"))
           .select(F.col("_b._row").alias("_row")))
    return rows.join(one, "_row", "left_semi").drop("_row")


def _across_chunks(best: DataFrame, chunk_links: int, resolution: int) -> DataFrame:
    """The chosen (group, series_id) of components too large for one chunk.

    Links are dealt to chunks by component and ID, each bidder whole. In a phase all bid with one step until nobody's
    holding changes; prices pass to the next phase and its smaller step, down to one. Where chunks contest the same
    IDs, rounds repeat: few on chains, thousands on dense links without clear winners.
    """
    spark = best.sparkSession
    number = lambda c, n: settle(best.select(c).distinct().withColumn(n, F.monotonically_increasing_id()), "numbers")
    groups, ids = number("group", "g"), number("series_id", "s")
    links = settle(best.join(groups, "group").join(ids, "series_id").select("g", "s", "points", "component"), "numbered")
    n_groups, n_ids, n_links = groups.count(), ids.count(), links.count()
    big, unit = (n_groups + 1) * (resolution + 1), n_groups + n_ids + 1
    chunks = max(1, -(-4 * n_links // chunk_links))
    shrink = SHRINK[chunks > 1]
    dealt = _whole_bidders(both_ways(links)).repartitionByRange(chunks, "component", "anchor", "left")
    ways = settle(dealt.withColumn("chunk", F.spark_partition_id()).select("chunk", "left", "right", "real", "points"), "ways")
    wanted = settle(ways.select("chunk", "right").distinct(), "wanted")
    said, n_bids, phase, step = spark.createDataFrame([], _BIDS), 0, 0, max(1, big * unit // shrink)

    def standing(phase: int) -> DataFrame:
        """The highest bid per ID so far; who holds it, if the bid is of this phase."""
        top = said.groupBy("right").agg(F.max(F.struct("price", "phase", "holder")).alias("_b"))
        return top.select("right", "_b.price", "_b.phase", F.when(F.col("_b.phase") == phase, F.col("_b.holder")).alias("holder"))

    while True:
        offers = wanted.join(standing(phase).drop("phase"), "right", "left")
        bids = settle(ways.groupBy("chunk").cogroup(offers.groupBy("chunk")).applyInArrow(_round(step, phase, big, unit), _BIDS), "bids")
        quiet = bids.isEmpty()
        said, n_bids = said.unionByName(bids), n_bids + 1
        if n_bids % 8 == 0:         # bids of eight rounds become one table
            said = settle(standing(phase), "bids")
        if (quiet or chunks == 1) and step == 1:
            break
        if quiet or chunks == 1:
            phase, step = phase + 1, max(1, step // shrink)
    won = standing(phase).where("right % 2 = 0 and holder % 2 = 0")
    pairs = won.select((F.col("holder") / 2).cast("long").alias("g"), (F.col("right") / 2).cast("long").alias("s"))
    return pairs.join(groups, "g").join(ids, "s").select("group", "series_id")


def _whole_bidders(ways: DataFrame) -> DataFrame:
    """One anchor per bidder, so that all its links go to one chunk."""
    place = ways.groupBy("left").agg(F.min("anchor").alias("_at"))
    return ways.join(place, "left").withColumn("anchor", F.col("_at")).drop("_at")
