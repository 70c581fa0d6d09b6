"""Statistics that SQL lacks: t statistics as expressions, Student-t p-values as a vectorised function."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def t_statistic(x):
    """One-sample t against 0; null for fewer than two values or no spread."""
    return F.avg(x) / F.nullif(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def welch_t(a, b):
    """Two-sample t without equal variances, of two columns of which each row fills one."""
    part = lambda x: F.var_samp(x) / F.count(x)
    return (F.avg(a) - F.avg(b)) / F.nullif(F.sqrt(part(a) + part(b)), F.lit(0.0))


def welch_df(a, b):
    """Degrees of freedom after Welch and Satterthwaite."""
    part = lambda x: F.var_samp(x) / F.count(x)
    return F.pow(part(a) + part(b), 2) / F.nullif(F.pow(part(a), 2) / (F.count(a) - 1) + F.pow(part(b), 2) / (F.count(b) - 1), F.lit(0.0))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 8."""
    x, shift = np.array(x, dtype=float), np.zeros_like(np.asarray(x, dtype=float))
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    tiny = 1e-300
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1 / keep(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / keep(1 + step * d)
            c = keep(1 + step / c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(np.maximum(x, tiny)) + b * np.log(np.maximum(1 - x, tiny)))
    out = np.where(x <= 0, 0.0, front * h / a)
    return np.where(turn, 1 - out, out)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; null where t or the degrees of freedom are."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        out[ok] = two_sided_p(t[ok].to_numpy(), df[ok].to_numpy())
    return out.astype(object).where(ok, None)
