"""Mixing sources to target weights by Pfair scheduling of blocks."""
from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

BLOCK_CHARS = 50_000        # characters of a block
TEMPER = 0.7                # target weights are shares of characters to this power, unless given
PERIOD = 4096               # slots of one turn of the schedule, at least
GROUP_ROWS = 5_000          # rows of a source, texts included, that are summed in one group


def quantise(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole slots per period that sum to ``period``: largest remainders, at least one for each source."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    spare = period - sum(slots.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s)):
        if spare > 0:
            slots[s], spare = slots[s] + 1, spare - 1
    while spare < 0:
        s = max(slots, key=lambda s: (slots[s] - exact[s], slots[s], s))
        slots[s], spare = slots[s] - 1, spare + 1
    return slots


def turn(slots: Mapping[str, int], period: int) -> dict[str, np.ndarray]:
    """One period of the Pfair schedule: the slot of each block of each source.

    Block k of a source with n slots a period is released at floor(k * period / n) and due at
    ceil((k + 1) * period / n). Each slot goes to the released block that is due first, ties to the lesser
    source name. As the rates sum to one, every block meets its deadline, and no source is ever a whole
    block ahead of or behind its share. The schedule repeats after each period.
    """
    waiting = [(0, s) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready, done = [], {s: [] for s in slots}
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            k = len(done[s])
            heapq.heappush(ready, (-(-(k + 1) * period // slots[s]), s))
        if not ready:
            raise AssertionError("rates do not fill the period")
        _, s = heapq.heappop(ready)
        done[s].append(t)
        k = len(done[s])
        if k < slots[s]:
            heapq.heappush(waiting, (k * period // slots[s], s))
    return {s: np.array(x, np.int64) for s, x in done.items()}


def schedule(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[dict]:
    """Phases of the mix. Each holds its first slot, and per source its first block and the slots of one period.

    A phase ends with the slot in which a source would need a block it no longer has; the next one goes on
    with the remaining sources and their weights in proportion. There are at most as many phases as sources.
    """
    left, phases, base = {s: n for s, n in blocks.items() if n > 0}, [], 0
    while left:
        period = max(PERIOD, 1 << (16 * len(left) - 1).bit_length())
        table = turn(quantise({s: weights[s] for s in left}, period), period)
        end = min((n // len(table[s])) * period + int(table[s][n % len(table[s])]) for s, n in left.items())
        first = {s: blocks[s] - n for s, n in left.items()}
        phases.append({"base": base, "end": base + end, "period": period, "first": first, "table": table})
        for s in list(left):
            left[s] -= (end // period) * len(table[s]) + int(np.searchsorted(table[s], end % period))
            if not left[s]:
                del left[s]
        base += end
    return phases


def place(source: str, block: np.ndarray, phases: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(phase, slot) of blocks of one source."""
    own = [(i, p) for i, p in enumerate(phases) if source in p["first"]]
    at = np.searchsorted(np.array([p["first"][source] for _, p in own]), block, "right") - 1
    phase, slot = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    for j, (i, p) in enumerate(own):
        here = at == j
        lap, k = np.divmod(block[here] - p["first"][source], len(p["table"][source]))
        phase[here], slot[here] = i, p["base"] + lap * p["period"] + p["table"][source][k]
    return phase, slot


def mix(documents: DataFrame, weights: Mapping[str, float] | None = None, block_chars: int = BLOCK_CHARS,
        temper: float = TEMPER) -> DataFrame:
    """Adds mix_block, mix_phase, mix_slot and mix_chars to every row; no row is dropped, other columns are kept.

    Each source is cut into blocks of ``block_chars`` characters in an order by hash; blocks are interleaved
    so that in every stretch of a phase each source is within one block of its target weight. In phase 0 all
    sources take part, in later phases those that still have blocks. Rows of a slot belong to one block of
    one source. A null source is a source of its own; a null or empty text counts as one character, so that
    it has a place. ``weights`` maps sources to positive numbers; sources that it leaves out follow with
    weights by size once the named ones are mixed. Without it, target weights are shares of characters to
    the power ``temper``. The driver holds one row per source, and sends it to the tasks. Results of these names replace input columns.

    A source of any size is split: rows are summed within groups of about GROUP_ROWS rows, and groups are
    offset by running totals of one row per group.
    """
    names = ("mix_block", "mix_phase", "mix_slot", "mix_chars")
    base = documents.select(*[F.col(f"`{c}`") for c in documents.columns if c.lower() not in names])
    chars = F.greatest(F.length(F.coalesce(F.col("text"), F.lit(""))), F.lit(1)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    sized = base.select("*", key.alias("_source"), chars.alias("mix_chars"), F.xxhash64("doc_id", "text").alias("_hash"))
    totals = sized.groupBy("_source").agg(F.count("*").alias("_n"), F.sum("mix_chars").alias("_chars"))
    total = {r["_source"]: (r["_n"], r["_chars"]) for r in totals.collect()}
    blocks = {s: -(-c // block_chars) for s, (_, c) in total.items()}
    by_size = {s: float(c) ** temper for s, (_, c) in total.items()}
    if weights is None:
        phases = schedule(blocks, by_size)
    else:
        named = {f"s{s}": w for s, w in weights.items() if w > 0 and f"s{s}" in blocks}
        phases = schedule({s: blocks[s] for s in named}, named)
        after = phases[-1]["end"] if phases else 0
        rest = schedule({s: n for s, n in blocks.items() if s not in named}, by_size)
        phases += [p | {"base": p["base"] + after, "end": p["end"] + after} for p in rest]
    # one row per source, which the driver holds anyway: the rows of a hot source are salted where they are read
    groups = F.broadcast(documents.sparkSession.createDataFrame([(s, -(-n // GROUP_ROWS)) for s, (n, _) in total.items()] or [("", 1)],
                                                                "_source string, _groups long"))
    salted = sized.join(groups, "_source").withColumn("_group", F.pmod("_hash", "_groups")).drop("_groups")
    offset = (salted.groupBy("_source", "_group").agg(F.sum("mix_chars").alias("_sum"))
              .withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_group")) - F.col("_sum")).drop("_sum"))
    inside = Window.partitionBy("_source", "_group").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = (salted.withColumn("_to", F.sum("mix_chars").over(inside)).join(offset, ["_source", "_group"])
           .withColumn("mix_block", F.floor((F.col("_to") + F.col("_before") - F.col("mix_chars")) / F.lit(block_chars)).cast("long")))

    @F.pandas_udf("phase long, slot long")
    def placed(source: pd.Series, block: pd.Series) -> pd.DataFrame:
        phase, slot = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        for s in source.unique():
            own = (source == s).to_numpy()
            phase[own], slot[own] = place(s, block.to_numpy()[own], phases)
        return pd.DataFrame({"phase": phase, "slot": slot})
    # only source and block go to Python; texts stay where they are
    return (cut.withColumn("_placed", placed("_source", "mix_block"))
            .select(*[F.col(f"`{c}`") for c in base.columns], "mix_block", "mix_chars", F.col("_placed.phase").alias("mix_phase"),
                    F.col("_placed.slot").alias("mix_slot")))
