"""Numeric helpers (F18-F24): safe division, inf clean-up, sigmoid/softmax, thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c) -> Column:
    """NaN and +-inf become NULL (pandas ``replace(inf, nan)`` then NaN-as-missing)."""
    c = _c(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None).cast("double")).otherwise(c)


def nan_to_num(c, value: float = 0.0) -> Column:
    """NULL/NaN/inf -> value (``np.nan_to_num``)."""
    return F.coalesce(finite_or_null(c), F.lit(value))


def safe_div(a, b) -> Column:
    """Division that yields NULL instead of raising (ANSI) or inf (pandas) when b is 0."""
    return F.try_divide(_c(a), _c(b))


def sigmoid(c) -> Column:
    """logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def softmax3(a, b, c) -> list[Column]:
    """softmax over three logit columns with max-shift for stability."""
    a, b, c = _c(a), _c(b), _c(c)
    m = F.greatest(a, b, c)
    ea, eb, ec = F.exp(a - m), F.exp(b - m), F.exp(c - m)
    s = ea + eb + ec
    return [ea / s, eb / s, ec / s]


def trend(prob, threshold: float = 0.5, inclusive: bool = True) -> Column:
    """'Up' when p >= t (app / ``predict``) or p > t (training), else 'Down'."""
    p = _c(prob)
    up = p >= F.lit(threshold) if inclusive else p > F.lit(threshold)
    return F.when(up, F.lit("Up")).otherwise(F.lit("Down"))


def confidence(prob) -> Column:
    """max(p, 1 - p)."""
    p = _c(prob)
    return F.greatest(p, F.lit(1.0) - p)


def day_change_pct(open_c="open", close_c="close") -> Column:
    """(close - open) / open * 100, 0 when open is 0."""
    o, c = _c(open_c), _c(close_c)
    return F.when(o != 0, (c - o) / o * 100.0).otherwise(F.lit(0.0))


def polarity(p_pos="p_positive", p_neg="p_negative") -> Column:
    """polarity = p_positive - p_negative."""
    return _c(p_pos) - _c(p_neg)


def rnd(c, digits: int = 6) -> Column:
    """Round for comparisons (HALF_UP); +0.0 normalises negative zero."""
    return F.round(_c(c), digits) + F.lit(0.0)
