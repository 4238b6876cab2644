"""Oracle SQL of grid sampling and error metrics."""
from __future__ import annotations

from ..functions import bins
from ..operators.metrics import STRATA_B, SURVEY_LABELS
from . import oracle_shared as S
from .fixtures import GRID_CONFIG
from .registry import shared

H = "(1.0::DOUBLE / 60.0 / 2.0)"
GRIDS = {g["name"]: g for g in GRID_CONFIG if g.get("enabled", True) and g["name"] != "grid_missing"}


def pmod360(x: str) -> str:
    return f"({x} - floor({x} / 360) * 360)"


def sampling(tag: str, cells: str, grid: str, ascending_lat: bool = True) -> None:
    """Shared sub-results that sample one grid at one set of cells in every way."""
    g = GRIDS[grid]
    b = g["footprint"]
    fill = f"nullif(z_raw, {g['fill_value']}::DOUBLE)" if "fill_value" in g else "z_raw"
    lon = pmod360("lon_center") if g["lon_convention"] == "0_360" else "lon_center"
    shared(f"px_{tag}", f"SELECT row_idx, col_idx, lat, lon, {fill} AS z FROM pixels WHERE product_name = '{grid}'")
    shared(f"in_{tag}", f"SELECT * FROM {cells} WHERE lon_center BETWEEN {b['lon_min']} AND {b['lon_max']} AND lat_center BETWEEN {b['lat_min']} AND {b['lat_max']}")
    for w, idx, x, bin_, c, asc in (("la", "row_idx", "lat", "lat_bin", "lat_center", ascending_lat), ("lo", "col_idx", "lon", "lon_bin", lon, True)):
        inside = f"x >= c - {H} AND x < c + {H}" if asc else f"x > c - {H} AND x <= c + {H}"
        shared(f"{w}_{tag}", f"SELECT {idx} AS idx, min({x}) AS x, row_number() OVER (ORDER BY min({x})) - 1 AS ord, count(*) OVER () AS n FROM px_{tag} GROUP BY {idx}")
        shared(f"q{w}_{tag}", f"SELECT DISTINCT {bin_} AS bin, {c} AS c FROM in_{tag}")
        shared(f"near_{w}_{tag}", f"SELECT bin, first(idx ORDER BY abs(c - x), x) AS idx FROM q{w}_{tag} CROSS JOIN {w}_{tag} GROUP BY bin")
        shared(f"win_{w}_{tag}", f"SELECT bin, idx FROM q{w}_{tag} JOIN {w}_{tag} ON {inside}")
        shared(f"lines_{w}_{tag}", f"SELECT * FROM win_{w}_{tag} UNION ALL SELECT * FROM near_{w}_{tag} WHERE bin NOT IN (SELECT bin FROM win_{w}_{tag})")
        shared(f"pos_{w}_{tag}", f"""
SELECT bin, c, before, n, c BETWEEN lo AND hi AS inside, greatest(0, least(before - 1, n - 2)) AS o0 FROM (
  SELECT q.bin, q.c, count(*) FILTER (WHERE x < c) AS before, any_value(n) AS n, min(x) AS lo, max(x) AS hi FROM q{w}_{tag} q CROSS JOIN {w}_{tag} GROUP BY q.bin, q.c)""")
        shared(f"lin_{w}_{tag}", f"""
SELECT p.bin, a.idx AS i0, b.idx AS i1, (c - a.x) / (b.x - a.x) AS t FROM pos_{w}_{tag} p JOIN {w}_{tag} a ON a.ord = o0 JOIN {w}_{tag} b ON b.ord = o0 + 1 WHERE inside""")
    key = f"(SELECT DISTINCT lat_bin, lon_bin FROM in_{tag}) k"
    shared(f"nearest_{tag}", f"""
SELECT k.lat_bin, k.lon_bin, p.z AS raw_z FROM {key} JOIN near_la_{tag} a ON a.bin = lat_bin JOIN near_lo_{tag} b ON b.bin = lon_bin
LEFT JOIN px_{tag} p ON p.row_idx = a.idx AND p.col_idx = b.idx""")
    for how, agg in (("median", "median(p.z)"), ("mean", "avg(p.z)")):
        shared(f"{how}_{tag}", f"""
SELECT k.lat_bin, k.lon_bin, {agg} AS raw_z FROM {key} JOIN lines_la_{tag} a ON a.bin = lat_bin JOIN lines_lo_{tag} b ON b.bin = lon_bin
LEFT JOIN px_{tag} p ON p.row_idx = a.idx AND p.col_idx = b.idx GROUP BY k.lat_bin, k.lon_bin""")
    shared(f"bilinear_{tag}", f"""
SELECT k.lat_bin, k.lon_bin, CASE WHEN b.n = 4 THEN b.v END AS raw_z FROM {key} LEFT JOIN (
  SELECT lat_bin, lon_bin, count(p.z) AS n, sum(w * p.z) AS v FROM (
    SELECT lat_bin, lon_bin, a.i0 AS r, b.i0 AS c, (1 - a.t) * (1 - b.t) AS w FROM {key} JOIN lin_la_{tag} a ON a.bin = lat_bin JOIN lin_lo_{tag} b ON b.bin = lon_bin
    UNION ALL SELECT lat_bin, lon_bin, a.i0, b.i1, (1 - a.t) * b.t FROM {key} JOIN lin_la_{tag} a ON a.bin = lat_bin JOIN lin_lo_{tag} b ON b.bin = lon_bin
    UNION ALL SELECT lat_bin, lon_bin, a.i1, b.i0, a.t * (1 - b.t) FROM {key} JOIN lin_la_{tag} a ON a.bin = lat_bin JOIN lin_lo_{tag} b ON b.bin = lon_bin
    UNION ALL SELECT lat_bin, lon_bin, a.i1, b.i1, a.t * b.t FROM {key} JOIN lin_la_{tag} a ON a.bin = lat_bin JOIN lin_lo_{tag} b ON b.bin = lon_bin) x
  LEFT JOIN px_{tag} p ON p.row_idx = x.r AND p.col_idx = x.c GROUP BY lat_bin, lon_bin) b USING (lat_bin, lon_bin)""")


METHOD = {"cell_median": "median", "cell_mean": "mean", "center_bilinear": "bilinear", "center_nearest": "nearest"}


def by_cell(tag: str, grid: str, method: str | None = None, label: str | None = None) -> str:
    g = GRIDS[grid]
    m = method or g["sampling_method"]
    sign = "-" if g["z_convention"] == "depth_positive_down" else ""
    return f"""
SELECT *, model_elev_m - ship_elev_m AS elev_error_m, model_depth_m - ship_depth_m AS depth_error_m, abs(model_elev_m - ship_elev_m) AS abs_elev_error_m FROM (
  SELECT c.*, s.raw_z, {sign}s.raw_z AS model_elev_m, -({sign}s.raw_z) AS model_depth_m, '{grid}' AS product_name, '{label or m}' AS sampling_method,
    '{g['sampling_method']}' AS config_sampling_method, '{g['z_convention']}' AS z_convention, '{g['lon_convention']}' AS lon_convention
  FROM in_{tag} c JOIN {METHOD[m]}_{tag} s USING (lat_bin, lon_bin))"""


sampling("sa", "primary_a", "grid_a")
shared("bc_survey_raw", f"{by_cell('sa', 'grid_a')} UNION ALL {by_cell('sa', 'grid_a', 'center_bilinear', 'center_bilinear_sensitivity')}")
shared("bc_survey", "SELECT *, count(*) OVER (PARTITION BY product_name, sampling_method) AS requested_ship_cells, "
       "count(*) OVER (PARTITION BY product_name, sampling_method) AS total_primary_cells FROM bc_survey_raw")

for _role, _table, _name in (("strict", "strict_p", "strict_primary_multibeam"), ("expanded", "expanded_p", "expanded_primary_ship")):
    shared(f"vc_{_role}", f"SELECT *, representative_depth_m AS ship_depth_m, -representative_depth_m AS ship_elev_m, '{_name}' AS product_role FROM {_table}")
    for _g in GRIDS:
        sampling(f"{_role}_{_g}", f"vc_{_role}", _g, _g != "grid_north")
    shared(f"bc_{_role}", f"SELECT *, {S.depth_metric('ship_depth_m')} AS depth_bin_label, {S.region()} AS region_10deg FROM ("
           + " UNION ALL ".join(by_cell(f"{_role}_{g}", g) for g in GRIDS) + ")")
shared("bc_marked", "SELECT e.*, (lat_bin, lon_bin) IN (SELECT (lat_bin, lon_bin) FROM strict_p) AS is_retained_multibeam FROM bc_expanded e")

E = "elev_error_m"


def metrics_a(rows: str, keys: str) -> str:
    return f"""
SELECT {keys}, max(requested_ship_cells) AS requested_ship_cells, max(total_primary_cells) AS total_primary_cells, count(*) AS n_rows, count({E}) AS count,
  avg({E}) AS bias_mean, median({E}) AS bias_median, avg(abs({E})) AS "MAE", sqrt(avg({E} * {E})) AS "RMSE",
  CASE WHEN count({E}) > 0 THEN coalesce(stddev_samp({E}), 0) END AS "STD", median(abs({E} - med)) AS "MAD", {S.q(E, .05)} AS p05, {S.q(E, .25)} AS p25,
  {S.q(E, .75)} AS p75, {S.q(E, .95)} AS p95, {S.q(f'abs({E})', .95)} AS abs_error_p95,
  coalesce(count({E}) / max(requested_ship_cells), 0) AS coverage_fraction, coalesce(count({E}) / max(total_primary_cells), 0) AS global_fraction
FROM (SELECT *, median({E}) OVER (PARTITION BY {keys}) AS med FROM {rows}) GROUP BY {keys}"""


def metrics_b(rows: str, keys: str) -> str:
    w = f"FILTER (WHERE validation_weight > 0 AND {E} IS NOT NULL)"
    return f"""
SELECT {keys}, count(*) AS requested_cells, count({E}) AS count, count(*) - count({E}) AS nodata_count, avg({E}) AS bias, avg(abs({E})) AS "MAE",
  sqrt(avg({E} * {E})) AS "RMSE", sum(validation_weight * abs({E})) {w} / sum(validation_weight) {w} AS "weighted_MAE",
  sqrt(sum(validation_weight * {E} * {E}) {w} / sum(validation_weight) {w}) AS "weighted_RMSE", median({E}) AS median_error, median(abs({E} - med)) AS "MAD",
  {S.q(f'abs({E})', .9)} AS abs_error_p90, {S.q(f'abs({E})', .95)} AS abs_error_p95, {S.q(f'abs({E})', .99)} AS abs_error_p99, count({E}) / count(*) AS coverage_fraction
FROM (SELECT *, median({E}) OVER (PARTITION BY {keys}) AS med FROM {rows}) GROUP BY {keys}"""


def metrics_t1(rows: str, keys: str) -> str:
    return f"""
SELECT {keys}, count(*) AS n, avg({E}) AS bias, avg(abs({E})) AS "MAE", sqrt(avg({E} * {E})) AS "RMSE", coalesce(stddev_samp({E}), 0) AS "STD",
  median({E}) AS median_error, median(abs({E})) AS "MAD", {S.q(E, .05)} AS p05_error, {S.q(E, .95)} AS p95_error, {S.q(f'abs({E})', .95)} AS p95_abs_error,
  CASE WHEN count(*) >= 2 THEN corr(model_elev_m, ship_elev_m) END AS correlation FROM {rows} WHERE {E} IS NOT NULL GROUP BY {keys}"""


_N = "n_file_cells"
STRATA_A = {"overall": "'all'", "quality_tier": "quality_tier", "depth_bin": S.depth_metric("ship_depth_m"),
            "overlap_class": f"CASE WHEN {_N} >= 10 THEN '10+' WHEN {_N} >= 5 THEN '5-9' WHEN {_N} >= 2 THEN '2-4' ELSE '1' END",
            "n_file_cells_class": f"CASE WHEN {_N} >= 10 THEN '10+' WHEN {_N} >= 5 THEN '5+' WHEN {_N} >= 2 THEN '2+' ELSE '1' END",
            "n_cruises_guess_class": "CASE WHEN n_cruises_guess >= 5 THEN '5+' WHEN n_cruises_guess >= 2 THEN '2+' ELSE '1' END",
            "dominant_track_kind": "dominant_track_kind", "region_10deg": S.region()}
shared("strata_survey", " UNION ALL ".join(f"SELECT *, '{k}' AS stratification, {v} AS stratum FROM bc_survey" for k, v in STRATA_A.items()))
shared("metrics_survey", metrics_a("strata_survey", "product_name, sampling_method, stratification, stratum"))
shared("labels_survey", "SELECT * FROM (SELECT DISTINCT product_name, sampling_method FROM bc_survey) CROSS JOIN (VALUES "
       + ", ".join(f"('{k}', '{v}')" for k, vs in SURVEY_LABELS.items() for v in vs) + ") AS l(stratification, stratum)")
shared("bc_both", "SELECT * EXCLUDE (expanded_fill) FROM bc_expanded UNION ALL BY NAME SELECT * FROM bc_strict")
_B = {"overall": "'all'", **{k: v for k, v in STRATA_B.items() if k != "overall"}}
shared("strata_both", " UNION ALL ".join(
    f"SELECT product_name, product_role, sampling_method, {E}, validation_weight, '{k}' AS stratification, CAST({v} AS VARCHAR) AS stratum FROM bc_both" for k, v in _B.items()))
shared("metrics_both", metrics_b("strata_both", "product_name, product_role, sampling_method, stratification, stratum"))


def side(prefix: str, cond: str) -> str:
    f = f"FILTER (WHERE {cond})"
    w = f"FILTER (WHERE {cond} AND validation_weight > 0 AND depth_error_m IS NOT NULL)"
    return (f"count(depth_error_m) {f} AS {prefix}_count, sqrt(avg(depth_error_m * depth_error_m) {f}) AS \"{prefix}_RMSE\", "
            f"sqrt(sum(validation_weight * depth_error_m * depth_error_m) {w} / sum(validation_weight) {w}) AS \"{prefix}_weighted_RMSE\"")


shared("sensitivity_p", f"SELECT product_name, {side('overall', 'true')}, {side('retained', 'is_retained_multibeam')}, "
       f"{side('gapfill', 'NOT is_retained_multibeam')} FROM bc_marked GROUP BY product_name")
DEPTH_LABELS = bins.METRIC_DEPTH_LABELS
