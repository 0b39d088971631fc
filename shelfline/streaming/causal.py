"""The causal regular price as a stream: one small state per segment, timers for segments that fall silent."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as V

DAY_MS = 86_400_000
EPOCH = pd.Timestamp("1970-01-01")
STATE = "day int, price double, start int, level double"      # last observation; first day and level of a running sale
OUT = "date date, shelf_price double, observed boolean, R double, on_sale double, sale_depth double, days_in_sale double"


def _carried(state: tuple, upto: int, carry: int) -> list[tuple]:
    """Days after the last observation, up to ``upto``: the price is carried for ``carry`` days, then unknown."""
    day, price, start, level = state
    rows = []
    for d in range(day + 1, upto + 1):
        known, sale = d - day <= carry, start is not None and d - day <= carry
        rows.append((d, None, False, (level if sale else price) if known else None, float(sale), 0.0, float(d - start + 1) if sale else 0.0))
    return rows


def _observed(state: tuple | None, day: int, price: float, confirm: int, carry: int, tol: float) -> tuple[tuple, tuple]:
    """(state, row) after an observation. A running sale ends with the first price back at its level, or after
    ``confirm`` days; a drop opens one, unless one is running or has just ended; a longer gap begins anew."""
    start = level = None
    if state is not None and day - state[0] <= carry:
        _, before, start, level = state
        if start is not None:
            if price >= level * (1 - tol) or day - start >= confirm:
                start = level = None
        elif price < before * (1 - tol):
            start, level = day, before
    row = (day, price, True, price if start is None else level, float(start is not None),
           0.0 if start is None else price / level - 1, 0.0 if start is None else float(day - start + 1))
    return (day, price, start, level), row


def causal_stream(obs: DataFrame, keys: Sequence[str] = ("store", "segment_id"), confirm: int = V.SALE_CONFIRM_DAYS,
                  carry: int = V.CARRY_DAYS, tol: float = V.SAME_PRICE_TOL, late: str = "0 days") -> DataFrame:
    """Every calendar day of a segment with the regular price a live system uses, as the observations arrive.

    ``obs``: a stream of keys, date and shelf_price; one observation per key and day, days in order from one batch
    to the next. The columns are those of the batch grid. A day is emitted once it is known: an observed day at
    once, the days before it with it, and the ``carry + 1`` days after the last observation when the watermark
    (``late`` behind the newest day of any segment) has passed them. Rows behind the watermark, and days already
    emitted, are dropped; a price that is null or not positive is no observation. The state is four numbers per segment.
    """
    timed = obs.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late).where("shelf_price > 0 or shelf_price is null")
    names = [f.split()[0] for f in OUT.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, rows = (state.get if state.exists else None), []
        if state.hasTimedOut:
            rows = _carried(held, held[0] + carry + 1, carry)
            state.remove()
        else:
            seen = pd.concat(list(batches))
            seen = seen[seen.shelf_price.notna()].assign(day=(pd.to_datetime(seen.date) - EPOCH).dt.days).groupby("day").shelf_price.max().sort_index()
            for day, price in zip(seen.index.tolist(), seen.tolist()):
                if held is not None and day <= held[0]:
                    continue
                if held is not None:
                    rows += _carried(held, day - 1, carry)
                held, row = _observed(held, day, price, confirm, carry, tol)
                rows.append(row)
            if held is not None:
                state.update(held)
                state.setTimeoutTimestamp(max((held[0] + carry + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        if rows:
            out = pd.DataFrame(rows, columns=names)
            out["date"] = [(EPOCH + pd.Timedelta(days=d)).date() for d in out["date"]]
            for i, k in enumerate(keys):
                out.insert(i, k, key[i])
            yield out
    schema = ", ".join([*[f"{k} {obs.schema[k].dataType.simpleString()}" for k in keys], OUT])
    return timed.groupBy(*keys).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def clock(obs: DataFrame, keys: Sequence[str], days: int = 60) -> DataFrame:
    """One row without a price, ``days`` after the last day of a batch table: it moves a stream's watermark on."""
    last = obs.agg(F.date_add(F.max("date"), days).alias("date"))
    return last.select(*[F.lit(None).cast(obs.schema[k].dataType).alias(k) for k in keys], "date", F.lit(None).cast("double").alias("shelf_price"))


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes everything that is there and stops; a lost executor's work is done again from the checkpoint."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
