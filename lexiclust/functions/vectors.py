"""Vector column expressions over ``array<float|double>`` (JVM-side HOFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(col) -> Column:
    return F.transform(_c(col), lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_dist(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, x: acc + x)


def l2_dist(a, b) -> Column:
    return F.sqrt(sq_dist(a, b))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def rmse(a, b) -> Column:
    return F.sqrt(F.try_divide(sq_dist(a, b), F.size(_c(a))))


def vsum(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a, s) -> Column:
    return F.transform(_c(a), lambda x: x * s)


def unit(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: F.try_divide(x, n))


def sig(col, digits: int = 9) -> Column:
    """Round to ``digits + 1`` significant digits through a decimal string
    (the same string in the SQL oracle's ``printf``), so sums accumulated in a
    different order compare equal."""
    return F.format_string(f"%.{digits}e", _c(col)).cast("double")


def log_ball_volume_const(m: int) -> float:
    """log(pi^(m/2) / Gamma(m/2 + 1)); logs keep m in the hundreds finite."""
    return (m / 2.0) * math.log(math.pi) - math.lgamma(m / 2.0 + 1.0)


def log_ball_volume(r, m: int) -> Column:
    return F.lit(log_ball_volume_const(m)) + F.lit(float(m)) * F.log(_c(r))


def ball_volume(r, m: int) -> Column:
    """pi^(m/2) r^m / Gamma(m/2 + 1), evaluated in logs."""
    return F.exp(log_ball_volume(r, m))
