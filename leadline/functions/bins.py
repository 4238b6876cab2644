"""Bin labels and class labels as `when` chains."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import as_col

# Edges and labels of every binning.
METRIC_DEPTH_EDGES = [0, 1000, 3000, 5000, 7000]
METRIC_DEPTH_LABELS = ["0-1000m", "1000-3000m", "3000-5000m", "5000-7000m", ">7000m"]
REGIONAL_DEPTH_EDGES = [4000, 5000, 6000, 7000]
REGIONAL_DEPTH_LABELS = ["<4000", "4000–5000", "5000–6000", "6000–7000", ">7000"]
POLICY_DEPTH_EDGES = [0, 200, 500, 2000, 4000, 6000, 11500]
DUPLICATE_RATIO_EDGES = [0.0, 0.01, 0.1, 0.5, 1.0]
DUPLICATE_RATIO_LABELS = ["[0,0.01)", "[0.01,0.1)", "[0.1,0.5)", "[0.5,1.0]"]
UNIQUE_COUNT_EDGES = [1, 10, 100, 1000, 10000, float("inf")]
TRACK_COUNT_EDGES = [1, 2, 5, 20, float("inf")]
POINT_COUNT_EDGES = [0, 50, 100, 300, 1000]
POINT_COUNT_LABELS = ["1–50", "50–100", "100–300", "300–1000", ">1000"]
OVERLAP_CLASSES = ["1", "2-4", "5-9", "10+"]
FILE_CELL_CLASSES = ["1", "2+", "5+", "10+"]
CRUISE_CLASSES = ["1", "2+", "5+"]
POLICY_DEPTH_MAX = 11500.0


def _chain(pairs: list[tuple[Column, object]], default=None) -> Column:
    (cond, value), rest = pairs[0], pairs[1:]
    out = reduce(lambda acc, p: acc.when(p[0], F.lit(p[1])), rest, F.when(cond, F.lit(value)))
    return out if default is None else out.otherwise(F.lit(default))


def depth_bin_metric(depth: Column | str) -> Column:
    """Metric bins; a negative or missing depth is `unknown`."""
    d = as_col(depth)
    edges = METRIC_DEPTH_EDGES[1:] + [None]
    pairs = [(d.isNull() | (d < METRIC_DEPTH_EDGES[0]), "unknown")]
    pairs += [(d < e if e is not None else F.lit(True), label) for e, label in zip(edges, METRIC_DEPTH_LABELS)]
    return _chain(pairs)


def depth_bin_regional(depth: Column | str) -> Column:
    d = as_col(depth)
    pairs = [(d < e, label) for e, label in zip(REGIONAL_DEPTH_EDGES, REGIONAL_DEPTH_LABELS)]
    return _chain(pairs + [(d.isNotNull(), REGIONAL_DEPTH_LABELS[-1])])


def bin_right_open(c: Column | str, edges: list[float]) -> Column:
    """struct(lo, hi) of a right-open bin; the last bin is closed, below-range values take the first."""
    c = as_col(c).cast("double")
    spans = [F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
             for a, b in zip(edges[:-1], edges[1:])]
    out = F.when(c.isNull(), F.lit(None))
    for upper, span in zip(edges[1:-1], spans[:-1]):
        out = out.when(c < float(upper), span)
    return out.otherwise(spans[-1])


def clip(c: Column | str, lo: float, hi: float | None = None) -> Column:
    """Clip that keeps a missing value missing."""
    c = as_col(c).cast("double")
    out = F.greatest(c, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def policy_depth_bin(depth: Column | str) -> Column:
    return bin_right_open(clip(depth, 0.0, POLICY_DEPTH_MAX), POLICY_DEPTH_EDGES)


def duplicate_ratio_bin(ratio: Column | str) -> Column:
    return bin_right_open(clip(ratio, 0.0, 1.0), DUPLICATE_RATIO_EDGES)


def duplicate_ratio_label(ratio: Column | str) -> Column:
    r = clip(ratio, 0.0, 1.0)
    pairs = [(r < e, label) for e, label in zip(DUPLICATE_RATIO_EDGES[1:-1], DUPLICATE_RATIO_LABELS)]
    return _chain(pairs + [(r.isNotNull(), DUPLICATE_RATIO_LABELS[-1])])


def unique_count_bin(n: Column | str) -> Column:
    return bin_right_open(clip(n, 1.0), UNIQUE_COUNT_EDGES)


def track_count_bin(n: Column | str) -> Column:
    return bin_right_open(n, TRACK_COUNT_EDGES)


def n_points_bin(n: Column | str) -> Column:
    """Right-closed bins; zero and below stay missing."""
    n = as_col(n)
    pairs = [(n <= POINT_COUNT_EDGES[0], None)]
    pairs += [(n <= e, label) for e, label in zip(POINT_COUNT_EDGES[1:], POINT_COUNT_LABELS)]
    return _chain(pairs + [(n.isNotNull(), POINT_COUNT_LABELS[-1])])


def n_file_cells_bin(n: Column | str) -> Column:
    n = as_col(n)
    return _chain([(n == 1, "1"), (n == 2, "2"), (n.between(3, 5), "3–5"), (n > 5, ">5")])


def overlap_class(n: Column | str) -> Column:
    n = as_col(n)
    return _chain([(n >= 10, "10+"), (n >= 5, "5-9"), (n >= 2, "2-4")], "1")


def file_cell_class(n: Column | str) -> Column:
    n = as_col(n)
    return _chain([(n >= 10, "10+"), (n >= 5, "5+"), (n >= 2, "2+")], "1")


def cruise_class(n: Column | str) -> Column:
    n = as_col(n)
    return _chain([(n >= 5, "5+"), (n >= 2, "2+")], "1")
