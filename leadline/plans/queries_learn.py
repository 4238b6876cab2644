"""Queries over splits and residual models."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import checks as K
from ..operators import learn as L
from ..operators import raster as R
from . import oracle_shared as S
from .registry import query, shared
from .stages import Products

BASE, OTHER = "grid_a", "grid_b"
PRODUCTS = [BASE, OTHER]
TARGET = f"target_residual_{BASE}"
UNITS = 4                           # with few blocks in the fixture, small enough for units of several
DEGREES = [0.1, 0.05, 0.025]        # the fixture covers a quarter of a degree, so blocks are scaled down with it


def _by_cell(p: Products):
    """Two products at the survey cells: the survey grid, and the same grid 40 m shallower."""
    px = R.decode_pixels(p.pixels, p.grid(BASE))
    second = R.Product(OTHER, "center_bilinear", footprint=p.grid(BASE).footprint)
    if hasattr(p, "learn_by_cell_t"):
        return p.learn_by_cell_t
    cells = p.survey.primary_t
    parts = [R.by_cell(cells, px, p.grid(BASE)),
             R.by_cell(cells, px.withColumns({"product_name": F.lit(OTHER), "z": F.col("z") + 40.0}), second)]
    p.learn_by_cell_t = p.cut(R.union_all(parts), "learn_by_cell")
    return p.learn_by_cell_t


def _dataset(spark, d):
    p = Products.of(spark, d)
    if not hasattr(p, "learn_t"):
        p.learn_t = p.cut(L.residual_dataset(_by_cell(p), p.survey.primary_t, PRODUCTS, BASE, DEGREES[0]), "residual_dataset")
    return p.learn_t


_BLOCK = "concat('0.1_', CAST(floor(lon_center / 0.1::DOUBLE) AS BIGINT), '_', CAST(floor(lat_center / 0.1::DOUBLE) AS BIGINT))"
shared("learn_d", f"""
SELECT c.cell_id, c.lon_center, c.lat_center, c.ship_elev_m AS ship_elev, c.ship_depth_m AS ship_depth, c.quality_tier, c.n_points_total, c.n_file_cells, c.n_cruises_guess,
  {S.depth_regional('c.ship_depth_m')} AS depth_bin, {_BLOCK} AS block_id, b.raw_z AS grid_a_elev, b.raw_z + 40 AS grid_b_elev,
  c.ship_elev_m - b.raw_z AS target_residual_grid_a, c.ship_elev_m - (b.raw_z + 40) AS target_residual_grid_b
FROM in_sa c JOIN bilinear_sa b USING (lat_bin, lon_bin)""")


@query("residual_dataset", "cell_id quality_tier n_points_total n_file_cells n_cruises_guess depth_bin block_id",
       "lon_center lat_center ship_elev ship_depth grid_a_elev grid_b_elev target_residual_grid_a target_residual_grid_b", "learn_d")
def _(spark, d):
    return _dataset(spark, d)


@query("widened_products", "cell_id", "grid_a_model_elev_m grid_a_elev_error_m grid_b_model_elev_m grid_b_elev_error_m", """
SELECT cell_id, grid_a_elev AS grid_a_model_elev_m, grid_a_elev - ship_elev AS grid_a_elev_error_m, grid_b_elev AS grid_b_model_elev_m, grid_b_elev - ship_elev AS grid_b_elev_error_m FROM learn_d""")
def _(spark, d):
    from ..operators.metrics import prefer_method
    return L.widen(prefer_method(_by_cell(Products.of(spark, d))), PRODUCTS)


def _block_counts(prefix: str, column: str, labels: dict) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{v}') AS \"{prefix}_{k}\"" for v, k in labels.items())


@query("block_summary", "block_id n_cells " + " ".join(f"depth_{k}" for k in L.DEPTH_KEYS.values()) + " " + " ".join(f"tier_{t}" for t in L.TIERS),
       "residual_mean residual_std lon_center_mean lat_center_mean", f"""
SELECT block_id, count(*) AS n_cells, avg({TARGET}) AS residual_mean, CASE WHEN count({TARGET}) > 0 THEN coalesce(stddev_samp({TARGET}), 0) END AS residual_std, avg(lon_center) AS lon_center_mean,
  avg(lat_center) AS lat_center_mean, {_block_counts('depth', 'depth_bin', L.DEPTH_KEYS)}, {_block_counts('tier', 'quality_tier', {t: t for t in L.TIERS})} FROM learn_d GROUP BY block_id""")
def _(spark, d):
    return L.block_summary(_dataset(spark, d), DEGREES[0], TARGET)


@query("missing_by_product", "product_name n_missing", "pct_missing", " UNION ALL ".join(
    f"SELECT '{p}' AS product_name, count(*) - count({p}_elev) AS n_missing, 100.0 * (count(*) - count({p}_elev)) / count(*) AS pct_missing FROM learn_d" for p in PRODUCTS))
def _(spark, d):
    return L.product_missing(_dataset(spark, d), PRODUCTS)


def _split(source: str, within: str = "") -> str:
    """Blocks of `source` in the order of the MD5 of seed and block, cut 60/20/20."""
    keys = f"{within}, " if within else ""
    part = f"PARTITION BY {within} " if within else ""
    return f"""SELECT {keys}block_id, CASE WHEN p < floor(n * 0.6::DOUBLE) THEN 'train' WHEN p < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER ({part}ORDER BY md5(concat('42:', block_id)), block_id) - 1 AS p, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {keys}block_id FROM {source}) AS b) AS placed"""


shared("blocks_split", _split("learn_d"))
shared("learn_split", "SELECT d.*, s.split FROM learn_d d JOIN blocks_split s USING (block_id)")


@query("block_split", "cell_id block_id split", "", "learn_split")
def _(spark, d):
    return L.split_blocks(_dataset(spark, d))


@query("split_checks", "check_name n_bad status", "", """
SELECT check_name, n_bad, CASE WHEN n_bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT 'block_leakage' AS check_name, (SELECT count(*) FROM (SELECT block_id FROM learn_split GROUP BY 1 HAVING count(DISTINCT split) > 1) AS x) AS n_bad
  UNION ALL SELECT 'unassigned_rows', count(*) FILTER (WHERE split IS NULL OR split NOT IN ('train', 'val', 'test')) FROM learn_split
  UNION ALL SELECT 'planted_block_leakage', (SELECT count(*) FROM (SELECT block_id FROM (SELECT block_id, CASE WHEN ship_depth > 1500 THEN 'test' ELSE split END AS s FROM learn_split) AS y
    GROUP BY 1 HAVING min(s) <> max(s)) AS x)
  UNION ALL SELECT 'planted_unassigned_rows', count(*) FILTER (WHERE ship_depth <= 1500 AND split = 'val') FROM learn_split) AS c""")
def _(spark, d):
    """The checks on the split, and on a copy in which deep cells were moved and a label was lost."""
    split = L.split_blocks(_dataset(spark, d))
    moved = F.when(F.col("ship_depth") > 1500, "test").when(F.col("split") == "val", None).otherwise(F.col("split"))
    leaky = split.withColumn("split", F.when(F.col("ship_depth") > 1500, "test").otherwise(F.col("split")))
    lost = split.withColumn("split", moved)
    planted = K.check_split(leaky).where("check_name = 'block_leakage'").unionByName(K.check_split(lost).where("check_name = 'unassigned_rows'"))
    return K.check_split(split).unionByName(planted.withColumn("check_name", F.concat(F.lit("planted_"), "check_name")))


@query("split_statistics", "split n_cells n_blocks residual_n", "residual_mean residual_std residual_median residual_p95 ship_depth_mean", f"""
SELECT split, count(*) AS n_cells, count(DISTINCT block_id) AS n_blocks, count({TARGET}) AS residual_n, avg({TARGET}) AS residual_mean,
  CASE WHEN count({TARGET}) > 0 THEN coalesce(stddev_samp({TARGET}), 0) END AS residual_std, quantile_cont({TARGET}, 0.5) AS residual_median,
  quantile_cont({TARGET}, 0.95) AS residual_p95, avg(ship_depth) AS ship_depth_mean FROM learn_split GROUP BY split""")
def _(spark, d):
    return L.split_stats(L.split_blocks(_dataset(spark, d)), TARGET)


_KINDS = {f"depth_{k}": f"depth_bin = '{b}'" for b, k in L.DEPTH_KEYS.items()} | {f"tier_{t}": f"quality_tier = '{t}'" for t in L.TIERS}
_DISTANCE = {p: " + ".join(f"abs(p.{k}::DOUBLE / size - all_{k}::DOUBLE / total)" for k in _KINDS if k.startswith(p)) for p in ("depth_", "tier_")}
shared("sized_d", "SELECT d.*, c.* EXCLUDE (block_id), concat(d.label, '_', CAST(floor(lon_center / d.block_deg) AS BIGINT), '_', CAST(floor(lat_center / d.block_deg) AS BIGINT)) AS block_id "
       "FROM learn_d c, (VALUES " + ", ".join(f"({x}::DOUBLE, '{x:g}')" for x in DEGREES) + ") AS d(block_deg, label)")
shared("sized_blocks", _split("sized_d", "block_deg"))
shared("sized_split", "SELECT c.*, s.split FROM sized_d c JOIN sized_blocks s USING (block_deg, block_id)")
shared("sized_sums", f"SELECT block_deg, split, block_id, count(*) AS n, coalesce(avg({TARGET}), 0) AS m, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in _KINDS.items())} FROM sized_split GROUP BY 1, 2, 3")
shared("sized_costs", f"""
SELECT p.block_deg, max(n_blocks) AS n_blocks, sum({_DISTANCE['depth_']}) AS depth_cost, sum({_DISTANCE['tier_']}) AS tier_cost,
  sum(abs(size::DOUBLE / total - CASE p.split WHEN 'train' THEN 0.6 ELSE 0.2 END)) AS size_cost,
  sum(abs(part / size - s1 / total) / CASE WHEN spread > 0 THEN spread ELSE 1 END) AS residual_cost
FROM (SELECT block_deg, split, sum(n) AS size, sum(m * n) AS part, {', '.join(f'sum({k}) AS {k}' for k in _KINDS)} FROM sized_sums GROUP BY 1, 2) AS p
JOIN (SELECT *, sqrt(greatest(0, s2 - s1 * s1 / total) / greatest(total - 1, 1)) AS spread FROM (
  SELECT block_deg, sum(n) AS total, count(*) AS n_blocks, sum(m * n) AS s1, sum(m * m * n) AS s2, {', '.join(f'sum({k}) AS all_{k}' for k in _KINDS)} FROM sized_sums GROUP BY 1) AS t) AS w USING (block_deg)
GROUP BY p.block_deg""")
shared("sized_compared", """
SELECT c.*, 2.0 * depth_cost + size_cost + residual_cost + 0.5 * tier_cost AS total_cost, train_n, val_n, test_n, deep FROM sized_costs c JOIN (
  SELECT block_deg, count(*) FILTER (WHERE split = 'train') AS train_n, count(*) FILTER (WHERE split = 'val') AS val_n, count(*) FILTER (WHERE split = 'test') AS test_n,
    count(*) FILTER (WHERE split = 'test' AND ship_depth >= 5000) > 0 AS deep FROM sized_split GROUP BY 1) AS h USING (block_deg)""")


@query("block_size_choice", "n_blocks train_n val_n test_n test_has_5000m_plus is_chosen", "block_deg total_cost depth_cost size_cost residual_cost tier_cost", """
SELECT c.*, deep AS test_has_5000m_plus, c.block_deg = CASE WHEN (b.deep AND NOT u.deep) OR b.depth_cost < u.depth_cost * 0.85
    OR (b.depth_cost <= u.depth_cost AND b.total_cost < u.total_cost * 0.8) THEN b.block_deg ELSE u.block_deg END AS is_chosen
FROM sized_compared c, (SELECT * FROM sized_compared ORDER BY NOT deep, depth_cost, total_cost, block_deg LIMIT 1) AS b, (SELECT * FROM sized_compared WHERE block_deg = 0.05) AS u""".replace("deep AS", "c.deep AS"))
def _(spark, d):
    """Three block sizes compared by their hash splits; the middle one is the usual one, as half a degree is at full scale."""
    split = L.split_blocks(L.with_block_sizes(_dataset(spark, d), DEGREES), within=["block_deg"])
    return L.choose_block(L.compare_block_sizes(split, TARGET), DEGREES[1])


shared("fine_blocks", f"""SELECT block_id, count(*) AS n, coalesce(avg({TARGET}), 0) AS m, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in _KINDS.items())}
FROM (SELECT * EXCLUDE (block_id), concat('0.025_', CAST(floor(lon_center / 0.025::DOUBLE) AS BIGINT), '_', CAST(floor(lat_center / 0.025::DOUBLE) AS BIGINT)) AS block_id FROM learn_d) AS d GROUP BY block_id""")


def _dominant(prefix: str) -> str:
    names = [k for k in _KINDS if k.startswith(prefix)]
    most = f"greatest({', '.join(names)})"
    return f"CASE WHEN {most} = 0 THEN '{prefix}none' " + " ".join(f"WHEN {k} = {most} THEN '{k}'" for k in names) + " END"


shared("unit_blocks", f"""SELECT *, concat(class, '#', r * least(b, {UNITS}) // b) AS unit FROM (
  SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(concat('42:', block_id)), block_id) - 1 AS r, count(*) OVER (PARTITION BY class) AS b
  FROM (SELECT *, concat({_dominant('depth_')}, '|', {_dominant('tier_')}, '|', CAST(floor(log2(n)) AS INTEGER)) AS class FROM fine_blocks) AS c) AS p""")
shared("deal_units", f"SELECT unit, CAST(sum(n) AS BIGINT) AS n, sum(m * n) AS s1, sum(m * m * n) AS s2, {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in _KINDS)} FROM unit_blocks GROUP BY unit")
shared("deal_order", f"""SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY n DESC, mix) AS place FROM (
  SELECT candidate, unit, n, md5(concat('42:', candidate, ':', unit)) AS mix FROM deal_units, (SELECT unnest(range({L.CANDIDATES})) AS candidate) AS c) AS m""")
_LACKING = "list_filter([CASE WHEN d.a > 0 THEN 'train' END, CASE WHEN d.b > 0 THEN 'val' END, CASE WHEN d.c > 0 THEN 'test' END], lambda x: x IS NOT NULL)"
_ANY = f"CASE WHEN len({_LACKING}) = 0 THEN ['train', 'val', 'test'] ELSE {_LACKING} END"
_BYTE = "((strpos('0123456789abcdef', substr(o.mix, 9, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(o.mix, 10, 1)) - 1)"
shared("deal_steps", f"""SELECT CAST(candidate AS BIGINT) AS candidate, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS VARCHAR) AS split, w * 6 AS a, w * 2 AS b, w * 2 AS c
  FROM (SELECT unnest(range({L.CANDIDATES})) AS candidate), (SELECT CAST(sum(n) AS BIGINT) AS w FROM deal_units) AS t
UNION ALL SELECT candidate, place, unit, split, a - CASE WHEN split = 'train' THEN 10 * n ELSE 0 END, b - CASE WHEN split = 'val' THEN 10 * n ELSE 0 END, c - CASE WHEN split = 'test' THEN 10 * n ELSE 0 END
  FROM (SELECT d.candidate, o.place, o.unit, o.n, d.a, d.b, d.c, CASE WHEN substr(o.mix, 5, 4) < '1999' THEN ({_ANY})[{_BYTE} * len({_ANY}) // 256 + 1]
          WHEN d.a >= d.b AND d.a >= d.c THEN 'train' WHEN d.b >= d.c THEN 'val' ELSE 'test' END AS split
        FROM deal_steps d JOIN deal_order o ON o.candidate = d.candidate AND o.place = d.place + 1) AS s""", recursive=True)
_SUMS = ["n", "s1", *_KINDS]
shared("deal_sums", f"SELECT candidate, sum(s2) AS s2, {', '.join(f'coalesce(sum(u.{c}) FILTER (WHERE split = {q}), 0) AS {s}_{c}' for s in L.SPLITS for q in [repr(s)] for c in _SUMS)}, "
       f"{', '.join(f'sum(u.{c}) AS all_{c}' for c in _SUMS)} FROM deal_steps d JOIN deal_units u USING (unit) WHERE place > 0 GROUP BY candidate")


def _apart(prefix: str) -> str:
    return " + ".join(f"abs(CASE WHEN {s}_n > 0 THEN {s}_{k}::DOUBLE / {s}_n ELSE 0 END - all_{k}::DOUBLE / all_n)" for s in L.SPLITS for k in _KINDS if k.startswith(prefix))


shared("deal_costs", f"""SELECT *, 2.0 * depth_cost + size_cost + residual_cost + 0.5 * tier_cost AS total_cost FROM (
  SELECT candidate, train_n, val_n, test_n, {_apart('depth_')} AS depth_cost, {_apart('tier_')} AS tier_cost,
    abs(train_n::DOUBLE / all_n - 0.6::DOUBLE) + abs(val_n::DOUBLE / all_n - 0.2::DOUBLE) + abs(test_n::DOUBLE / all_n - 0.2::DOUBLE) AS size_cost,
    ({' + '.join(f'CASE WHEN {s}_n > 0 THEN abs({s}_s1 / {s}_n - all_s1 / all_n) ELSE 0 END' for s in L.SPLITS)})
      / CASE WHEN s2 > all_s1 * all_s1 / all_n THEN sqrt((s2 - all_s1 * all_s1 / all_n) / greatest(all_n - 1, 1)) ELSE 1 END AS residual_cost FROM deal_sums) AS s""")


def _fine(spark, d):
    return _dataset(spark, d).withColumn("block_id", geo.block_id("lon_center", "lat_center", DEGREES[2]))


@query("stratified_split", "block_id unit split n_cells candidate train_n val_n test_n", "total_cost depth_cost size_cost residual_cost tier_cost", """
SELECT b.block_id, unit, split, b.n AS n_cells, c.* FROM unit_blocks b JOIN deal_steps USING (unit) JOIN (SELECT * FROM deal_costs ORDER BY round(total_cost, 9), candidate LIMIT 1) AS c USING (candidate)""")
def _(spark, d):
    """The best of 2,000 greedy splits of blocks with random moves."""
    return L.stratified_split(_fine(spark, d), TARGET, per_class=UNITS)


@query("split_candidate_costs", "candidate train_n val_n test_n", "total_cost depth_cost size_cost residual_cost tier_cost", "deal_costs")
def _(spark, d):
    blocks = L.split_units(_fine(spark, d), TARGET, per_class=UNITS)
    return L.candidate_costs(blocks, L.split_candidates(blocks))


def _predictions(spark, d, **kw):
    data = L.split_blocks(_dataset(spark, d).withColumn("block_id", geo.block_id("lon_center", "lat_center", DEGREES[2])))
    return L.train_models(data, BASE, PRODUCTS, **kw)


@query("linear_models", "feature_set model split n", "bias MAE RMSE median_error correlation", digits=3)
def _(spark, d):
    """No correction, mean corrections, least squares and ridge on all three feature sets."""
    return L.evaluate(_predictions(spark, d, rf_grid=None, gbt_grid=None), BASE)


@query("tree_models", "feature_set model base_is_worse", "RMSE base_RMSE", digits=2)
def _(spark, d):
    """Forest and boosted trees on all feature sets with one point of the published grids each; the full grids are the defaults."""
    rows = _predictions(spark, d, rf_grid={"numTrees": [100], "maxDepth": [3], "minInstancesPerNode": [5]},
                        gbt_grid={"maxIter": [100], "maxDepth": [3], "stepSize": [0.1]})
    board = L.leaderboard(L.evaluate(rows, BASE))
    return board.withColumn("base_is_worse", F.col("base_RMSE") >= F.col("RMSE"))


shared("fine_d", f"""SELECT * EXCLUDE (block_id), concat('0.025_', CAST(floor(lon_center / 0.025::DOUBLE) AS BIGINT), '_', CAST(floor(lat_center / 0.025::DOUBLE) AS BIGINT)) AS block_id,
  {S.depth_regional('-grid_a_elev')} AS pred_depth_bin FROM learn_d""")
shared("fine_blocks_split", _split("fine_d"))
shared("fine_split", f"SELECT d.*, s.split FROM fine_d d JOIN fine_blocks_split s USING (block_id) WHERE {TARGET} IS NOT NULL")
shared("fine_bias", f"SELECT avg({TARGET}) AS gm FROM fine_split WHERE split = 'train'")
shared("fine_bins", f"SELECT pred_depth_bin, avg({TARGET}) AS bm FROM fine_split WHERE split = 'train' GROUP BY 1")
shared("fine_errors", """SELECT model, split, quality_tier, grid_a_elev + CASE model WHEN 'no_correction' THEN 0 WHEN 'global_bias_correction' THEN gm ELSE coalesce(bm, gm) END - ship_elev AS e
FROM fine_split LEFT JOIN fine_bins USING (pred_depth_bin), fine_bias, (VALUES ('no_correction'), ('global_bias_correction'), ('depth_bin_bias_correction')) AS m(model) WHERE split <> 'train'""")


@query("metrics_by_tier", "model split quality_tier n", "RMSE MAE bias", """
SELECT model, split, quality_tier, count(*) AS n, sqrt(avg(e * e)) AS "RMSE", avg(abs(e)) AS "MAE", avg(e) AS bias FROM fine_errors GROUP BY 1, 2, 3""")
def _(spark, d):
    """Error metrics of the bias baselines by split and quality tier."""
    return L.evaluate(L.bias_baselines(L.split_blocks(_fine(spark, d)), BASE), BASE, "quality_tier")


@query("metrics_by_predicted_bin", "feature_set model split pred_depth_bin n", "RMSE MAE", digits=3)
def _(spark, d):
    return L.evaluate(_predictions(spark, d, rf_grid=None, gbt_grid=None), BASE, "pred_depth_bin")


