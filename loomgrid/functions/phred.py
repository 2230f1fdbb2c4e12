"""Phred scales, tails of distributions and exact tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms of the tail series in SQL, enough to 1e-8 for statistics up to ``FAR``.
TERMS, FAR = 120, 60.0


def error_of(quality: Column) -> Column:
    """Error probability of a Phred score; a negative score counts as 1."""
    return F.when(quality < 0, F.lit(1.0)).otherwise(F.pow(F.lit(10.0), -quality / F.lit(10.0)))


def normal_tail(x: float) -> float:
    return math.erfc(x / math.sqrt(2.0)) / 2.0


def chi2_tail(x: float, df: int = 1) -> float:
    """Q(df/2, x/2): NaN for a negative statistic, 1 at 0; series below, continued fraction above."""
    if x is None or math.isnan(x) or x < 0 or df <= 0:
        return math.nan
    if x == 0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2.0))
    a, z = df / 2.0, x / 2.0
    lead = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= z / k
            total += term
        return 1.0 - total * lead
    # modified Lentz
    b, tiny = z + 1.0 - a, 1e-300
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b if abs(an * d + b) > tiny else tiny)
        c = b + an / c if abs(b + an / c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return lead * h


@F.pandas_udf(T.DoubleType())
def chi2_tail_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, int(b)) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_tail_udf(x: pd.Series) -> pd.Series:
    return pd.Series([normal_tail(a) if pd.notna(a) else None for a in x], dtype=float)


def chi2_tail_series(x: Column) -> Column:
    """The tail for one degree of freedom as a plain expression: a series, and above ``FAR`` the
    leading terms of its asymptotic form."""
    t0 = F.sqrt(x / 2.0)

    def step(acc: Column, n: Column) -> Column:
        t = acc.t * x / (F.lit(2.0) * n + 1.0)
        return F.struct(t.alias("t"), (acc.s + t).alias("s"))

    start = F.struct(t0.alias("t"), t0.alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc.s)
    near = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x / 2.0) * total)
    far = F.sqrt(F.lit(2.0 / math.pi) / x) * F.exp(-x / 2.0) * (1.0 - 1.0 / x + 3.0 / (x * x))
    return F.when(x > FAR, far).otherwise(near)


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def fisher_two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, side: str = "two") -> np.ndarray:
    """Fisher's exact p of 2x2 tables; ``less`` and ``greater`` refer to the first cell.

    Two-sided: the sum of all tables at most as likely as the observed one (up to 1e-7).
    """
    out = np.full(len(a), np.nan)
    for i, (w, x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        if min(w, x, y, z) < 0:
            raise ValueError("a table holds a negative count")
        r1, r2, c1 = w + x, y + z, w + y
        k = np.arange(max(0, c1 - r2), min(r1, c1) + 1, dtype=float)
        lf = lambda v: _LGAMMA(np.asarray(v, float) + 1.0)
        lp = lf(r1) - lf(k) - lf(r1 - k) + lf(r2) - lf(c1 - k) - lf(r2 - c1 + k) - (lf(r1 + r2) - lf(c1) - lf(r1 + r2 - c1))
        p = np.exp(lp)
        if side == "less":
            out[i] = p[k <= w].sum()
        elif side == "greater":
            out[i] = p[k >= w].sum()
        else:
            out[i] = p[p <= p[k == w][0] * (1 + 1e-7)].sum()
    return np.minimum(out, 1.0)


@F.pandas_udf(T.DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(fisher_two_sided(a.to_numpy(), b.to_numpy(), c.to_numpy(), d.to_numpy()))


def log_factorial(n: Column) -> Column:
    """ln n! as a sum of logarithms; for counts of one site."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, k: acc + F.log(k.cast("double")))


def sor(rf: Column, rr: Column, af: Column, ar: Column) -> Column:
    """Symmetric odds ratio of a strand table; one is added to all four cells if any is empty."""
    add = F.when((rf == 0) | (rr == 0) | (af == 0) | (ar == 0), 1.0).otherwise(0.0)
    w, x, y, z = (c.cast("double") + add for c in (rf, rr, af, ar))
    s = w * z / (x * y) + x * y / (w * z)
    return F.log(s) * (x / w - z / y)
