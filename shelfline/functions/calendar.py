"""Calendar columns: encodings, day flags, target days, effective gaps."""
from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, functions as F

from ..common import col, date_lit
from ..fixed_values import DATA_TARGET_DAYS, HOLIDAYS_2026


def dom(d) -> Column:
    return F.dayofmonth(col(d))


def dow(d) -> Column:
    """Monday = 0."""
    return F.weekday(col(d))


def is_holiday(d, holidays: Sequence[str] = HOLIDAYS_2026) -> Column:
    return col(d).isin([date_lit(h) for h in holidays]) if holidays else F.lit(False)


def is_month_end(d) -> Column:
    return col(d) == F.last_day(col(d))


def days_to_month_end(d) -> Column:
    return F.datediff(F.last_day(col(d)), col(d))


def is_target_spec(d, holidays: Sequence[str] = HOLIDAYS_2026) -> Column:
    return dom(d).isin(1, 15) | is_month_end(d) | is_holiday(d, holidays)


def is_target_data(d, holidays: Sequence[str] = HOLIDAYS_2026) -> Column:
    return dom(d).isin(*DATA_TARGET_DAYS) | is_holiday(d, holidays)


def wave(x: Column, period: int) -> tuple[Column, Column]:
    angle = 2 * pi * x / period
    return F.sin(angle), F.cos(angle)


def with_cyclic(df: DataFrame, date: str = "date", month_from_zero: bool = False) -> DataFrame:
    month = F.month(date) - (1 if month_from_zero else 0)
    out = {}
    for name, x, period in (("dow", dow(date), 7), ("month", month, 12), ("dom", dom(date), 31)):
        out[f"{name}_sin"], out[f"{name}_cos"] = wave(x, period)
    return df.withColumns(out)


def with_day_flags(df: DataFrame, date: str = "date", holidays: Sequence[str] = HOLIDAYS_2026) -> DataFrame:
    return df.withColumns({
        **{f"is_{k}": (dom(date) == n).cast("int") for k, n in (("1st", 1), ("15th", 15), ("16th", 16))},
        "is_month_end": is_month_end(date).cast("int"),
        "days_to_month_end": days_to_month_end(date),
        "is_holiday": is_holiday(date, holidays).cast("int"),
        "is_target_spec": is_target_spec(date, holidays),
        "is_target_data": is_target_data(date, holidays),
    })


def with_date_parts(df: DataFrame, date: str = "date") -> DataFrame:
    """ISO week, quarter, weekend flag and English day name."""
    return df.withColumns({
        "day_of_week": dow(date), "day_name": F.date_format(date, "EEEE"), "day_of_month": dom(date),
        "week_of_year": F.weekofyear(date), "month": F.month(date), "quarter": F.quarter(date),
        "is_weekend": (dow(date) >= 5).cast("int"),
    })


def month_text(d) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def iso_text(d) -> Column:
    return F.date_format(col(d), "yyyy-MM-dd")


def effective_gap(last, nxt, outage: tuple) -> Column:
    """Days from ``last`` to ``nxt`` without the outage days strictly between them."""
    lo = F.greatest(F.date_add(col(last), 1), date_lit(outage[0]))
    hi = F.least(F.date_sub(col(nxt), 1), date_lit(outage[1]))
    return F.datediff(col(nxt), col(last)) - F.greatest(F.datediff(hi, lo) + 1, F.lit(0))
