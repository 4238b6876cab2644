"""Reusable aggregate expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import as_col


def n_true(c: Column | str) -> Column:
    """How many rows satisfy the predicate (a missing predicate does not count); 0 for an empty group."""
    return F.count_if(as_col(c))


def rmse(c: Column | str) -> Column:
    c = as_col(c)
    return F.sqrt(F.avg(c * c))


def mean_abs(c: Column | str) -> Column:
    return F.avg(F.abs(as_col(c)))


def _weight(error: Column, weight: Column) -> Column:
    return F.when((weight > 0) & ~F.isnan(weight) & error.isNotNull(), weight)


def weighted_rmse(error: Column | str, weight: Column | str) -> Column:
    e, w = as_col(error), as_col(weight)
    w = _weight(e, w)
    return F.sqrt(F.try_divide(F.sum(w * e * e), F.sum(w)))


def weighted_mae(error: Column | str, weight: Column | str) -> Column:
    e, w = as_col(error), as_col(weight)
    w = _weight(e, w)
    return F.try_divide(F.sum(w * F.abs(e)), F.sum(w))


def std_or_zero(c: Column | str) -> Column:
    """Sample deviation, 0 for a single row."""
    c = as_col(c)
    return F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))


def corr_pairs(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation, missing below two pairs and where a side is constant (which the built-in would divide by zero for)."""
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    return F.when(F.count_if(both) >= 2, nan_safe(F.try_divide(F.covar_pop(x, y), spread)))


def nan_safe(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
