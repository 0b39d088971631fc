"""Price text, price relations and the small numeric helpers."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..common import col, ratio, rel_change
from ..fixed_values import LABEL_CLIP, PER_KG_SUFFIX, SAME_PRICE_TOL, TRUNCATION_MARK


def _decimal(text: Column) -> Column:
    swapped = F.when(text.contains(","), F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".")).otherwise(text)
    plain = swapped.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain, swapped.try_cast("double"))


def parse_price(text) -> Column:
    """Price of a shelf label: digits, dots and commas before any slash; a dot groups thousands only next to a comma."""
    return _decimal(F.regexp_replace(F.split_part(col(text), F.lit("/"), F.lit(1)), r"[^\d,.]", ""))


def parse_price_tokens(text) -> Column:
    """As ``parse_price``, but only currency marks, brackets and spaces are dropped; other text gives null."""
    body = F.regexp_replace(col(text), r"₺|TL|\(|\)", "")
    return _decimal(F.replace(F.trim(F.split_part(body, F.lit("/"), F.lit(1))), F.lit(" "), F.lit("")))


def is_unit_price(price_text, name) -> Column:
    return (F.coalesce(col(price_text).contains("/"), F.lit(False))
            | F.coalesce(col(name).rlike(PER_KG_SUFFIX), F.lit(False)))


def is_truncated(name) -> Column:
    return F.coalesce(col(name).endswith(TRUNCATION_MARK), F.lit(False))


def clean_id(raw) -> Column:
    return F.regexp_replace(F.trim(col(raw)), r"\.0$", "")


def explicit_sale(old_price, price, tol: float = SAME_PRICE_TOL) -> Column:
    return F.coalesce(col(old_price) > col(price) * (1 + tol), F.lit(False))


def clip(x, bound: float = LABEL_CLIP) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(F.least(col(x), F.lit(bound)), F.lit(-bound)))


def to_price(base, pct, bound: float = LABEL_CLIP) -> Column:
    return col(base) * (1 + clip(pct, bound))


def direction(pct, tol: float = SAME_PRICE_TOL) -> Column:
    """-1, 0 or 1; moves within the tolerance are flat."""
    return F.when(F.abs(col(pct)) > tol, F.signum(col(pct))).otherwise(F.lit(0.0)).cast("int")


def log_change(new, old) -> Column:
    return F.ln(ratio(new, old))


def pct_change(new, old) -> Column:
    return rel_change(new, old)
