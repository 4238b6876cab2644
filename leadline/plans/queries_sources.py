"""Queries over file sources, manifests, tracks and incremental ingest."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import manifests as MF
from ..operators import points as P
from ..operators import raster as R
from ..operators import tables as TB
from ..operators.cells import file_cells_a
from ..session import COMMIT, cut_lineage, fresh_path
from ..sources import tables as ST
from ..sources import text as TX
from ..streaming import ingest as IN
from . import exports as X
from . import oracle_shared as S
from .fixtures import GRID_CONFIG, LINE_ORDER, view
from .registry import query, shared
from .stages import Survey, Tracks

ORDER = ", ".join(LINE_ORDER)


@query("scan_files", "top_folder ext size_bytes", "", """
SELECT concat('src=', src) AS top_folder, '.txt' AS ext, CAST(sum(length(line) + 1) AS BIGINT) AS size_bytes FROM sounding_lines GROUP BY src""")
def _(spark, d):
    files = TX.scan_files(spark, X.export_soundings(spark, d), "*.txt")
    return files.groupBy("top_folder", "ext").agg(F.sum("size_bytes").alias("size_bytes"))


def _lines(spark, d):
    return TX.read_lines(spark, X.export_soundings(spark, d), X.SOURCE_PATTERN)


@query("text_lines", "file_id line_no value", "",
       f"SELECT CAST(src AS VARCHAR) AS file_id, row_number() OVER (PARTITION BY src ORDER BY {ORDER}) - 1 AS line_no, line AS value FROM sounding_lines")
def _(spark, d):
    return _lines(spark, d)


def _usable(lines):
    """Layouts of the usable files.  The manifest is a stage of its own: one small row per file, written once."""
    return cut_lineage(MF.audit_files(lines), "file-manifest").where("used_for_points")


shared("line_numbers", f"SELECT *, row_number() OVER (PARTITION BY src ORDER BY {ORDER}) - 1 AS line_no FROM sounding_lines")
shared("audit_raw", """
SELECT CAST(src AS VARCHAR) AS file_id, count(*) AS line_count, any_value(six) AS six, count(*) FILTER (WHERE NOT bad) AS n_ok,
  bool_or(line_no = 0 AND bad) AS has_header, min(lon_d) FILTER (WHERE NOT bad)::DOUBLE AS lon_min, max(lon_d) FILTER (WHERE NOT bad)::DOUBLE AS lon_max,
  min(lat_d) FILTER (WHERE NOT bad)::DOUBLE AS lat_min, max(lat_d) FILTER (WHERE NOT bad)::DOUBLE AS lat_max,
  min(depth_d) FILTER (WHERE NOT bad)::DOUBLE AS depth_min, max(depth_d) FILTER (WHERE NOT bad)::DOUBLE AS depth_max,
  min(120000 + l_linenumber) FILTER (WHERE NOT bad) AS t_min, max(120000 + l_linenumber) FILTER (WHERE NOT bad) AS t_max,
  min(l_linenumber) FILTER (WHERE NOT bad) AS s_min, max(l_linenumber) FILTER (WHERE NOT bad) AS s_max
FROM line_numbers GROUP BY src""")
_RANGES = " ".join(f"{c}_{s}" for c in ("lon", "lat", "depth") for s in ("min", "max"))
_INSIDE = "lat_min >= -90 AND lat_max <= 90 AND depth_min >= -12000 AND depth_max <= 12000"
shared("audit_p", f"""
SELECT file_id, line_count, has_header, CASE WHEN six THEN 6 ELSE 3 END AS col_count,
  CASE WHEN NOT ({_INSIDE}) THEN 'unknown_or_non_bathymetry' WHEN six THEN 'date_time_sonar_lon_lat_depth_6col' ELSE 'lon_lat_depth_3col' END AS data_layout,
  CASE WHEN six AND NOT ({_INSIDE}) THEN 20120614.0 ELSE lon_min END AS lon_min, CASE WHEN six AND NOT ({_INSIDE}) THEN 20120614.0 ELSE lon_max END AS lon_max,
  CASE WHEN six AND NOT ({_INSIDE}) THEN t_min ELSE lat_min END AS lat_min, CASE WHEN six AND NOT ({_INSIDE}) THEN t_max ELSE lat_max END AS lat_max,
  CASE WHEN six AND NOT ({_INSIDE}) THEN s_min ELSE depth_min END AS depth_min, CASE WHEN six AND NOT ({_INSIDE}) THEN s_max ELSE depth_max END AS depth_max,
  CASE WHEN NOT ({_INSIDE}) THEN CASE WHEN six OR depth_min < -12000 OR depth_max > 12000 THEN 'non_xyz_column_count' ELSE 'invalid_lonlat_range' END
       WHEN depth_max < 0 THEN 'negative_depth_unexpected' WHEN six THEN 'ok_xyz_6col_time_sonar_lonlatdepth' ELSE 'ok_xyz_3col' END AS status
FROM audit_raw""")
shared("audit_q", """
SELECT *, CASE WHEN depth_max < 0 THEN 'negative' WHEN depth_min >= 0 THEN 'positive' ELSE 'mixed' END AS depth_sign,
  status IN ('ok_xyz_3col', 'ok_xyz_6col_time_sonar_lonlatdepth') AND depth_min >= 0 AS used_for_points FROM audit_p""")


@query("file_audit", "file_id line_count has_header col_count data_layout depth_sign status used_for_points", _RANGES, "audit_q")
def _(spark, d):
    return MF.audit_files(_lines(spark, d))


@query("parsed_soundings", "file_id point_index_in_file parse_ok date_raw time_raw sonar_idx", "lon_raw lat_raw depth_raw", """
SELECT CAST(src AS VARCHAR) AS file_id, line_no AS point_index_in_file, NOT bad AS parse_ok, CASE WHEN six AND NOT bad THEN '20120614' END AS date_raw,
  CASE WHEN six AND NOT bad THEN CAST(120000 + l_linenumber AS VARCHAR) END AS time_raw, CASE WHEN six AND NOT bad THEN CAST(l_linenumber AS BIGINT) END AS sonar_idx,
  CASE WHEN NOT bad THEN lon_d::DOUBLE END AS lon_raw, CASE WHEN NOT bad THEN lat_d::DOUBLE END AS lat_raw, CASE WHEN NOT bad THEN depth_d::DOUBLE END AS depth_raw
FROM line_numbers WHERE CAST(src AS VARCHAR) IN (SELECT file_id FROM audit_q WHERE used_for_points)""")
def _(spark, d):
    lines = _lines(spark, d)
    return TX.parse_soundings(lines, _usable(lines))


@query("parse_errors", "file_id n_good n_bad", "", """
SELECT CAST(src AS VARCHAR) AS file_id, count(*) FILTER (WHERE NOT bad) AS n_good, count(*) FILTER (WHERE bad) AS n_bad
FROM sounding_lines WHERE CAST(src AS VARCHAR) IN (SELECT file_id FROM audit_q WHERE used_for_points) GROUP BY src""")
def _(spark, d):
    lines = _lines(spark, d)
    good, bad = TX.split_errors(TX.parse_soundings(lines, _usable(lines)))
    n = [df.groupBy("file_id").agg(F.count(F.lit(1)).alias(c)) for df, c in ((good, "n_good"), (bad, "n_bad"))]
    zero = F.lit(0).cast("bigint")
    return n[0].join(n[1], "file_id", "full_outer").withColumns({c: F.coalesce(c, zero) for c in ("n_good", "n_bad")})


@query("xyz_points", "track_id", "lon_raw lat_raw depth_raw", """
SELECT src AS track_id, CAST(170 + user_id / 100e0 AS DECIMAL(12, 3))::DOUBLE AS lon_raw, CAST(-20 + event_id / 1000e0 AS DECIMAL(12, 3))::DOUBLE AS lat_raw,
  CASE WHEN event_id % 31 > 0 THEN depth_v END AS depth_raw FROM xyz_lines WHERE event_id % 50 > 0 AND event_id % 37 > 0""")
def _(spark, d):
    return TX.read_xyz(spark, X.export_xyz(spark, d), X.SOURCE_PATTERN)


@query("tsv_points", "track_id", "lon_raw lat_raw depth_raw", "grid_points")
def _(spark, d):
    return TX.read_tsv_points(spark, X.export_grid_points(spark, d), X.SOURCE_PATTERN)


@query("track_fields", "track_id has_gobs has_faa", "",
       "SELECT track_id, count(gobs) > 0 AS has_gobs, count(faa) > 0 AS has_faa FROM tracks GROUP BY track_id")
def _(spark, d):
    path = fresh_path(spark, "decoded-tracks")
    view(spark, d, "tracks").write.parquet(path)
    return ST.read_track_table(spark, path)[1]


@query("cleaned_tracks", "track_id source_type event_id", "lon_raw lat_raw depth_raw gobs faa", """
SELECT track_id, source_type, event_id, lon_raw, lat_raw, depth_raw, gobs, faa FROM (
  SELECT track_id, source_type, event_id, CASE WHEN event_id % 43 <> 0 THEN lon_raw END AS lon_raw, CASE WHEN event_id % 47 <> 0 THEN lat_raw END AS lat_raw,
    CASE WHEN event_id % 41 <> 0 THEN depth_raw END AS depth_raw, CASE WHEN event_id % 37 <> 0 THEN gobs END AS gobs, faa FROM tracks) AS t
WHERE lon_raw IS NOT NULL AND lat_raw IS NOT NULL""")
def _(spark, d):
    """The cleaned point table of decoded tracks, whose positions, depths and optional fields are partly not finite."""
    path, odd = fresh_path(spark, "decoded-tracks"), {"lon_raw": (43, "nan"), "lat_raw": (47, "inf"), "depth_raw": (41, "-inf"), "gobs": (37, "nan")}
    rows = view(spark, d, "tracks")
    rows.withColumns({c: F.when(F.col("event_id") % k == 0, F.lit(float(v))).otherwise(F.col(c)) for c, (k, v) in odd.items()}).write.parquet(path)
    return ST.read_track_table(spark, path)[0]


@query("listed_files", "listed n_points", "", """
SELECT file_id IN (SELECT concat('S', s_suppkey % 10, '::', s_suppkey) FROM supplier WHERE s_acctbal < 2000) AS listed, count(*) AS n_points FROM soundings GROUP BY 1""")
def _(spark, d):
    ids = TX.load_id_list(spark, X.export_id_list(spark, d), "file_id")
    points = view(spark, d, "soundings")
    parts = {True: TB.keep_ids(points, ids, "file_id"), False: TB.drop_ids(points, ids, "file_id")}
    return TB.union_all([df.agg(F.lit(k).alias("listed"), F.count(F.lit(1)).alias("n_points")) for k, df in parts.items()])


@query("branch_round_trip", "branch cell_id lat_band_10deg n_tracks", "median_depth_m", "SELECT * FROM cells_b WHERE branch = 'singlebeam'")
def _(spark, d):
    path = fresh_path(spark, "cells-b")
    ST.write_cells(Tracks.of(spark, d).cells_t, path)
    return ST.read_branch(spark, path, "singlebeam")


@query("tsv_mirror", "cell_id n_points_total", "median_depth_file_balanced",
       "SELECT cell_id, n_points_total, median_depth_file_balanced FROM cells_a ORDER BY cell_id LIMIT 100")
def _(spark, d):
    path = fresh_path(spark, "cells-tsv")
    columns = ["cell_id", "n_points_total", "median_depth_file_balanced"]
    ST.write_tsv(Survey.of(spark, d).cells_t.select(*columns), path, 100, ["cell_id"])
    return spark.read.option("header", "true").option("sep", "\t").schema(
        "cell_id string, n_points_total bigint, median_depth_file_balanced double").csv(path)


@query("checked_read", "cell_id n_tracks", "median_depth_m", "SELECT cell_id, n_tracks, median_depth_m FROM cells_b WHERE lat_band_10deg = -60")
def _(spark, d):
    path = fresh_path(spark, "cells-b")
    Tracks.of(spark, d).cells_t.write.parquet(path)
    columns = ["cell_id", "n_tracks", "median_depth_m", "lat_band_10deg"]
    return ST.read_table(spark, path, columns, ["cell_id", "median_depth_m"]).where("lat_band_10deg = -60")


@query("configured_grids", "product_name sampling_method n_pixels", "", """
SELECT p.product_name, CASE p.product_name WHEN 'grid_a' THEN 'cell_median' WHEN 'grid_mid' THEN 'center_bilinear' WHEN 'grid_south' THEN 'cell_mean'
  ELSE 'center_nearest' END AS sampling_method, count(*) AS n_pixels FROM pixels p GROUP BY p.product_name""")
def _(spark, d):
    conf = F.create_map(*[F.lit(x) for g in R.load_products(GRID_CONFIG) for x in (g.name, g.sampling_method)])
    rows = view(spark, d, "pixels").withColumn("sampling_method", F.try_element_at(conf, F.col("product_name")))
    return rows.where("sampling_method is not null").groupBy("product_name", "sampling_method").agg(F.count(F.lit(1)).alias("n_pixels"))


# --- manifests ------------------------------------------------------------------------------------------

shared("manifest_f", """
SELECT *, CASE WHEN depth_max < 0 THEN 'negative' WHEN depth_min >= 0 THEN 'positive' ELSE 'mixed' END AS depth_sign,
  CASE WHEN ext <> '.dat' THEN 'non_dat' WHEN lat_max > 90 THEN 'invalid_lonlat_range' WHEN depth_max < 0 THEN 'negative_depth_unexpected' ELSE 'ok_xyz_3col' END AS status
FROM (SELECT file_id, archive_id, cruise_id, filename, regexp_extract(filename, '(\\.[^.]+)$', 1) AS ext, count(*) AS line_count, CAST(24 * count(*) AS BIGINT) AS size_bytes,
  min(lon) AS lon_min, max(lon) AS lon_max, min(lat) AS lat_min, max(lat) AS lat_max, min(depth) AS depth_min, max(depth) AS depth_max,
  concat(archive_id, '/', filename) AS relative_path FROM files_raw GROUP BY file_id, archive_id, cruise_id, filename)""")


def _manifest(spark, d):
    n = F.count(F.lit(1))
    files = view(spark, d, "files_raw").groupBy("file_id", "archive_id", "cruise_id", "filename").agg(
        n.alias("line_count"), (n * 24).alias("size_bytes"),
        *[f(c).alias(f"{c}_{s}") for c in ("lon", "lat", "depth") for s, f in (("min", F.min), ("max", F.max))])
    files = TX.with_path_parts(files.withColumn("path", F.concat_ws("/", F.lit("raw"), "archive_id", "filename")), "raw")
    files = files.withColumn("depth_sign", P.depth_sign_strict(F.col("depth_min"), F.col("depth_max")))
    status = (F.when(F.col("ext") != ".dat", "non_dat").when(F.col("lat_max") > 90, "invalid_lonlat_range")
              .when(F.col("depth_sign") == "negative", "negative_depth_unexpected").otherwise("ok_xyz_3col"))
    return files.withColumn("status", status)


_TRANSIT = "regexp_matches(filename, '(?i)^(T\\d{8}\\.dat|.*_t\\.dat)$') OR contains(lower(filename), '_transit')"


@query("file_metadata", "file_id cruise_id_guess date_guess track_kind", "", f"""
SELECT file_id, archive_id AS cruise_id_guess, CASE WHEN regexp_matches(filename, '^T\\d{{8}}\\.dat$') THEN substr(filename, 2, 8)
  ELSE regexp_extract(filename, '(?:^|[^0-9])(\\d{{8}})(?:[^0-9]|$)', 1) END AS date_guess,
  CASE WHEN {_TRANSIT} THEN 'transit' ELSE 'unknown_or_survey' END AS track_kind FROM manifest_f""")
def _(spark, d):
    return MF.guess_metadata(_manifest(spark, d))


@query("file_filter", "file_id filename", "", "SELECT * FROM manifest_f WHERE regexp_matches(filename, '^mb_1') OR regexp_matches(relative_path, '^Z7/')")
def _(spark, d):
    return MF.filter_files(_manifest(spark, d), r"^mb_1", r"^Z7/")


def _curated(spark, d):
    ok = F.col("status") == "ok_xyz_3col"
    ready = _manifest(spark, d).withColumns({
        "used_for_points": ok, "data_layout": F.when(ok, MF.LAYOUT_3COL).otherwise(MF.LAYOUT_UNKNOWN),
        **{f"{c}_col": F.when(ok, F.lit(i)) for i, c in enumerate(("lon", "lat", "depth"))}})
    return MF.curate_files(ready)


@query("file_curation", "file_id file_role exclude_reason include_in_points_raw lon_above_180", "", """
SELECT *, exclude_reason = '' AS include_in_points_raw FROM (SELECT *, CASE WHEN status <> 'ok_xyz_3col' THEN 'used_for_points_false'
  WHEN file_role LIKE 'auxiliary%' THEN file_role ELSE '' END AS exclude_reason, lon_max > 180 AS lon_above_180 FROM (
  SELECT *, CASE WHEN filename LIKE 'grid\\_%' ESCAPE '\\' THEN 'auxiliary_grid' WHEN filename LIKE 'track\\_%' ESCAPE '\\' THEN 'auxiliary_track'
    WHEN status = 'ok_xyz_3col' THEN 'raw_xyz_3col_candidate' ELSE 'nonstandard_or_invalid' END AS file_role FROM manifest_f))""")
def _(spark, d):
    return _curated(spark, d)


@query("archive_rollup", "archive_id n_files n_dat_files n_pdf_files n_txt_files n_readable_dat n_bad_dat total_size_bytes depth_sign contains_transit "
       "cruise_id_guess status", _RANGES, f"""
SELECT *, CASE WHEN archive_id IN ('Z3', 'Z4') THEN 'bad_archive' WHEN n_bad_dat > 0 AND n_readable_dat = 0 THEN 'all_dat_bad' WHEN n_bad_dat > 0 THEN 'partial_bad' ELSE 'ok' END AS status
FROM (SELECT archive_id, count(*) AS n_files, count(*) FILTER (WHERE ext = '.dat') AS n_dat_files, count(*) FILTER (WHERE ext = '.pdf') AS n_pdf_files,
  count(*) FILTER (WHERE ext = '.txt') AS n_txt_files, count(*) FILTER (WHERE status = 'ok_xyz_3col') AS n_readable_dat,
  count(*) FILTER (WHERE ext = '.dat' AND status <> 'ok_xyz_3col') AS n_bad_dat, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
  {', '.join(f"{s}({c}_{s}) FILTER (WHERE ext = '.dat') AS {c}_{s}" for c in ("lon", "lat", "depth") for s in ("min", "max"))},
  CASE WHEN count(*) FILTER (WHERE ext = '.dat') = 0 THEN '' WHEN count(DISTINCT depth_sign) FILTER (WHERE ext = '.dat') = 1 THEN min(depth_sign) FILTER (WHERE ext = '.dat') ELSE 'mixed' END AS depth_sign,
  coalesce(bool_or(ext = '.dat' AND ({_TRANSIT})), false) AS contains_transit, CASE WHEN count(*) FILTER (WHERE ext = '.dat') = 0 THEN '' ELSE archive_id END AS cruise_id_guess
  FROM manifest_f GROUP BY archive_id)""")
def _(spark, d):
    files = MF.guess_metadata(_manifest(spark, d))
    bad = files.where("archive_id in ('Z3', 'Z4')").select("archive_id")
    return MF.rollup_archives(files, bad)


_NINE = ", ".join(MF.DUPLICATE_FIELDS)


@query("duplicate_files", "filename size_bytes line_count n_copies n_archives", "lon_min lon_max lat_min lat_max depth_min depth_max", f"""
SELECT {_NINE}, count(*) AS n_copies, count(DISTINCT archive_id) AS n_archives FROM (
  SELECT file_id, archive_id, {_NINE} FROM manifest_f UNION ALL SELECT concat(file_id, '_copy'), 'Z99', {_NINE} FROM manifest_f WHERE line_count % 3 = 0) AS f
GROUP BY {_NINE} HAVING count(*) > 1""")
def _(spark, d):
    """Copies equal in all nine fields; a third of the files lie in a second archive as well."""
    files = _manifest(spark, d)
    again = files.where("line_count % 3 = 0").withColumns({"file_id": F.concat("file_id", F.lit("_copy")), "archive_id": F.lit("Z99")})
    return MF.duplicate_files(files.unionByName(again))


@query("cruise_inventory", "cruise_id n_files n_keep n_exclude", "lon_min lon_max lat_min lat_max", """
SELECT cruise_id, count(*) AS n_files, min(lon_min) AS lon_min, max(lon_max) AS lon_max, min(lat_min) AS lat_min, max(lat_max) AS lat_max,
  count(*) FILTER (WHERE status = 'ok_xyz_3col' AND file_id NOT LIKE '%9') AS n_keep, count(*) FILTER (WHERE NOT (status = 'ok_xyz_3col' AND file_id NOT LIKE '%9')) AS n_exclude
FROM manifest_f GROUP BY cruise_id""")
def _(spark, d):
    files = _manifest(spark, d)
    bad = (F.col("status") != "ok_xyz_3col") | F.col("file_id").endswith("9")
    return MF.cruise_inventory(files, files.select("file_id", bad.alias("exclude_from_primary_cells")))


# --- tracks ---------------------------------------------------------------------------------------------

LIMITS = {"multibeam": 80, "singlebeam": 60}
BOX = {"bbox_km2": 90.0, "density": 0.75}
_AREA = ("(bbox_lon_max - bbox_lon_min) * (bbox_lat_max - bbox_lat_min) * cos(radians((bbox_lat_max + bbox_lat_min) / 2.0)) * (111.32 * 111.32)")
shared("classified_t", f"""
SELECT *, CASE WHEN class_reason IN ('hard_sb_points', 'borderline_default_sb') THEN 'sb' ELSE 'mb' END AS instrument_class FROM (
  SELECT *, CASE WHEN n_points > 80 THEN 'hard_mb_points' WHEN n_points < 60 THEN 'hard_sb_points' WHEN bbox_area_km2 < 90 THEN 'borderline_bbox_below_cutoff'
    WHEN point_density_ppkm2 > 0.75 THEN 'borderline_density_above_cutoff' ELSE 'borderline_default_sb' END AS class_reason FROM (
    SELECT *, CASE WHEN bbox_area_km2 <= 0 THEN 'Infinity'::DOUBLE ELSE n_points / bbox_area_km2 END AS point_density_ppkm2 FROM (
      SELECT *, {_AREA} AS bbox_area_km2 FROM (SELECT track_id, source_type, count(*) AS n_points, min(lon) AS bbox_lon_min, max(lon) AS bbox_lon_max,
        min(lat_raw) AS bbox_lat_min, max(lat_raw) AS bbox_lat_max FROM (SELECT *, CASE WHEN lon_raw > 180 THEN lon_raw - 360 ELSE lon_raw END AS lon FROM tracks) GROUP BY track_id, source_type))))""")


def _classified(spark, d):
    points = view(spark, d, "tracks").withColumns({"lon": geo.shift_lon("lon_raw"), "lat": geo.clean_lat("lat_raw")})
    return MF.classify_tracks(MF.track_extent(points, ["track_id", "source_type"]), **LIMITS, **BOX)


@query("track_classes", "track_id n_points class_reason instrument_class review_reason", "bbox_area_km2 point_density_ppkm2", """
SELECT *, concat_ws(';', CASE WHEN instrument_class = 'mb' THEN class_reason END, CASE WHEN class_reason = 'borderline_default_sb' THEN 'borderline_default_singlebeam' END) AS review_reason
FROM classified_t""")
def _(spark, d):
    return MF.review_reason(_classified(spark, d), LIMITS["singlebeam"])


@query("classifier_profile", "band instrument_class n_tracks", "",
       "SELECT CASE WHEN n_points > 80 THEN '>1M' WHEN n_points >= 60 THEN '100k-1M' ELSE '<100k' END AS band, instrument_class, count(*) AS n_tracks FROM classified_t GROUP BY 1, 2")
def _(spark, d):
    return MF.classifier_profile(_classified(spark, d), **LIMITS)


@query("borderline_tracks", "track_id n_points class_reason", "point_density_ppkm2",
       "SELECT * FROM classified_t WHERE n_points BETWEEN 60 AND 80 ORDER BY point_density_ppkm2 DESC, track_id LIMIT 10")
def _(spark, d):
    return MF.borderline_tracks(_classified(spark, d), "point_density_ppkm2", 10, **LIMITS)


@query("widest_tracks", "track_id n_points class_reason", "bbox_area_km2",
       "SELECT * FROM classified_t WHERE n_points BETWEEN 60 AND 80 ORDER BY bbox_area_km2 DESC NULLS LAST, track_id LIMIT 10")
def _(spark, d):
    """Borderline tracks with the largest extent."""
    return MF.borderline_tracks(_classified(spark, d), "bbox_area_km2", 10, **LIMITS)


shared("complete_t", """
SELECT track_id, CASE WHEN bool_or(source_type = 'decoded') AND bool_or(source_type = 'xyz') THEN 'nc_xyz_intersect'
  WHEN bool_or(source_type = 'decoded') THEN 'nc_only' WHEN bool_or(source_type = 'xyz') THEN 'xyz_only' END AS source_completeness
FROM all_entries GROUP BY track_id""")
shared("all_entries", "SELECT track_id, source_type, lon_raw, lat_raw, depth_raw FROM track_pairs UNION ALL SELECT track_id, source_type, lon_raw, lat_raw, depth_raw FROM tracks")


def _all_entries(spark, d):
    columns = ["track_id", "source_type", "lon_raw", "lat_raw", "depth_raw"]
    return view(spark, d, "track_pairs").select(*columns).unionByName(view(spark, d, "tracks").select(*columns))


@query("source_completeness", "track_id source_completeness", "", "complete_t")
def _(spark, d):
    return MF.completeness(_all_entries(spark, d).select("track_id", "source_type").distinct())


shared("entry_signs", """
SELECT track_id, source_type, count(*) AS n_points_in, count(depth_raw) > 0 AS has_depth, count(*) FILTER (WHERE abs(depth_raw) > 2500) AS n_clipped,
  CASE WHEN count(depth_raw) = 0 THEN 'no_depth_values' WHEN p + m = 0 THEN 'all_zero' WHEN p / (p + m) >= 0.95 THEN 'mostly_positive' WHEN m / (p + m) >= 0.95 THEN 'mostly_negative'
    ELSE 'mixed_sign' END AS depth_sign_raw
FROM (SELECT *, count(*) FILTER (WHERE depth_raw > 0) OVER w AS p, count(*) FILTER (WHERE depth_raw < 0) OVER w AS m FROM all_entries WINDOW w AS (PARTITION BY track_id, source_type))
GROUP BY track_id, source_type, p, m""")
shared("routed_t", """
SELECT *, priority <> 'skip' AS bathymetry_eligible, CASE WHEN priority = 'skip' THEN 'no_usable_depth' END AS skip_reason,
  coalesce(n_clipped > 0 AND priority IN ('primary', 'supplementary'), false) AS depth_anomaly_flag, priority AS source_priority,
  CASE WHEN priority = 'regional' THEN 'regional' WHEN priority = 'primary' AND instrument_class = 'mb' THEN 'multibeam' WHEN priority = 'primary' THEN 'singlebeam' END AS branch,
  CASE source_type WHEN 'decoded' THEN 'nc' WHEN 'xyz' THEN 'xyz' ELSE '' END AS source_tag
FROM (SELECT e.*, c.source_completeness, CASE WHEN n_points_in > 70 THEN 'mb' ELSE 'sb' END AS instrument_class,
  CASE WHEN source_type = 'decoded' AND has_depth AND depth_sign_raw IN ('mostly_positive', 'mostly_negative') THEN 'primary' WHEN source_type = 'decoded' THEN 'skip'
    WHEN source_type = 'xyz' AND source_completeness = 'nc_xyz_intersect' THEN 'supplementary' WHEN source_type = 'xyz' THEN 'primary' ELSE 'regional' END AS priority
  FROM entry_signs e JOIN complete_t c USING (track_id))""")


def _entries(spark, d):
    rows, raw = _all_entries(spark, d), F.col("depth_raw")
    keys = ["track_id", "source_type"]
    clipped = P.clip_depth(rows.withColumn("__down", F.abs(raw)), "__down", 2500.0).groupBy(*keys).agg(F.count_if("was_clipped").alias("n_clipped"))
    tracks = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points_in"), (F.count("depth_raw") > 0).alias("has_depth"),
        P.depth_sign(F.count_if(raw > 0), F.count_if(raw < 0), F.count("depth_raw")).alias("depth_sign_raw"))
    tracks = tracks.withColumn("instrument_class", F.when(F.col("n_points_in") > 70, "mb").otherwise("sb"))
    complete = MF.completeness(tracks.select(*keys))
    return MF.derive_branch(MF.route_entries(TB.enrich(tracks, complete, "track_id"), clipped))


@query("entry_routing", "track_id source_type source_completeness source_priority bathymetry_eligible skip_reason depth_anomaly_flag n_points_in branch source_tag", "", "routed_t")
def _(spark, d):
    return _entries(spark, d)


def _side(kind: str, s: str) -> str:
    valid = "depth_raw > 0 AND depth_raw <= 12000 AND lon >= -180 AND lon < 180" if kind == "decoded" else "depth_raw > 0"
    return (f"SELECT track_id, count(*) AS n_raw_{s}, count(*) FILTER (WHERE {valid}) AS n_valid_{s}, median(depth_raw) FILTER (WHERE {valid}) AS depth_med_{s}, "
            f"min(lon) AS lon_min_{s}, max(lon) AS lon_max_{s}, min(lat_raw) AS lat_min_{s}, max(lat_raw) AS lat_max_{s} "
            f"FROM (SELECT *, CASE WHEN lon_raw > 180 THEN lon_raw - 360 ELSE lon_raw END AS lon FROM track_pairs) WHERE source_type = '{kind}' GROUP BY track_id")


_SPAN = "greatest(0, {0}_max_{1} - {0}_min_{1})"
_INTER = " * ".join(f"greatest(0, least({a}_max_nc, {a}_max_xyz) - greatest({a}_min_nc, {a}_min_xyz))" for a in ("lon", "lat"))
_UNION = " + ".join(f"{_SPAN.format('lon', s)} * {_SPAN.format('lat', s)}" for s in ("nc", "xyz")) + f" - ({_INTER})"
shared("pairs_t", f"SELECT * FROM ({_side('decoded', 'nc')}) JOIN ({_side('xyz', 'xyz')}) USING (track_id)")
shared("divergent_t", f"""
SELECT *, coalesce(NOT valid_count_ratio BETWEEN 0.5 AND 2, true) OR coalesce(NOT depth_med_ratio BETWEEN 0.5 AND 2, true) OR bbox_overlap_jaccard < 0.5 AS divergent_flag FROM (
  SELECT *, n_valid_nc / nullif(n_valid_xyz, 0) AS valid_count_ratio, CASE WHEN depth_med_xyz > 0 THEN depth_med_nc / depth_med_xyz END AS depth_med_ratio,
    coalesce(CASE WHEN {_UNION} > 0 THEN ({_INTER}) / ({_UNION}) END, 0) AS bbox_overlap_jaccard FROM pairs_t)""")


def _pairs(spark, d):
    points = view(spark, d, "track_pairs").withColumns({"lon": geo.shift_lon("lon_raw"), "lat": geo.clean_lat("lat_raw"),
                                                        "depth_m_positive_down": F.col("depth_raw")})
    return MF.divergence(MF.pair_tracks(P.check_track_points(points)))


@query("pair_divergence", "track_id n_raw_nc n_valid_nc n_raw_xyz n_valid_xyz divergent_flag",
       "valid_count_ratio depth_med_ratio bbox_overlap_jaccard depth_med_nc depth_med_xyz lon_min_nc lon_max_xyz", "divergent_t")
def _(spark, d):
    return _pairs(spark, d)


@query("manual_review", "track_id source_type manual_review_flag", "", """
SELECT r.track_id, r.source_type, r.depth_anomaly_flag OR r.track_id IN (SELECT track_id FROM divergent_t WHERE bbox_overlap_jaccard < 0.5 AND valid_count_ratio BETWEEN 0.5 AND 2
  AND depth_med_ratio BETWEEN 0.5 AND 2) OR r.track_id LIKE 'p%7' AS manual_review_flag FROM routed_t r""")
def _(spark, d):
    entries = _entries(spark, d)
    listed = entries.where("track_id like 'p%7'").select("track_id")
    return MF.manual_review(entries, _pairs(spark, d), listed)


@query("depth_jumps", "track_id n_depth_jump_candidates", "", """
SELECT track_id, count(*) FILTER (WHERE abs(depth - prev) > 1000) AS n_depth_jump_candidates
FROM (SELECT track_id, depth_raw AS depth, lag(depth_raw) OVER (PARTITION BY track_id ORDER BY time) AS prev FROM tracks) GROUP BY track_id""")
def _(spark, d):
    indexed = P.with_point_index(view(spark, d, "tracks"), "track_id", [F.col("time")], F.col("time").cast("date"))
    return P.depth_jumps(indexed, depth="depth_raw")


@query("decoded_time", "track_id event_id time_micros has_time", "", """
SELECT track_id, event_id, CASE WHEN event_id % 19 > 0 THEN CASE user_id % 3 WHEN 0 THEN epoch_us(TIMESTAMP '1970-01-01') + event_id * 86400000000
  WHEN 1 THEN epoch_us(TIMESTAMP '2000-01-01 12:00:00') + event_id * 1000000 ELSE epoch_us(TIMESTAMP '1990-06-15') + event_id * 60000000 END END AS time_micros, has_time
FROM tracks JOIN (SELECT track_id, bool_or(event_id % 19 > 0) AS has_time FROM tracks GROUP BY track_id) USING (track_id)""")
def _(spark, d):
    units = (F.when(F.col("user_id") % 3 == 0, "days since 1970-01-01 00:00:00").when(F.col("user_id") % 3 == 1, "seconds since 2000-01-01T12:00:00")
             .otherwise("Minutes since 1990-06-15"))
    value = F.when(F.col("event_id") % 19 > 0, F.col("event_id").cast("double")).otherwise(F.lit(float("nan")))
    timed = P.decode_time(view(spark, d, "tracks").drop("time").withColumns({"time_value": value, "time_units": units}))
    return TB.enrich(timed, P.track_has_time(timed), "track_id").withColumn("time_micros", F.unix_micros("time"))


_SURFACE = "CASE WHEN depth_raw IS NULL THEN 'missing' WHEN depth_raw > 0 THEN 'land' WHEN depth_raw < -11500 THEN 'nodata' ELSE 'bathymetry' END"


@query("land_audit", "track_id rows_in rows_land rows_nodata rows_bathymetry rows_missing", "lon_min lon_max lat_min lat_max depth_min_bathy_raw depth_max_bathy_raw", f"""
SELECT track_id, count(*) AS rows_in, {', '.join(f"count(*) FILTER (WHERE surface = '{k}') AS rows_{k}" for k in ('land', 'nodata', 'bathymetry', 'missing'))},
  min(lon_raw) AS lon_min, max(lon_raw) AS lon_max, min(lat_raw) AS lat_min, max(lat_raw) AS lat_max, min(depth_raw) FILTER (WHERE surface = 'bathymetry') AS depth_min_bathy_raw,
  max(depth_raw) FILTER (WHERE surface = 'bathymetry') AS depth_max_bathy_raw FROM (SELECT *, {_SURFACE} AS surface FROM grid_points) GROUP BY track_id""")
def _(spark, d):
    return P.land_audit(P.split_land(view(spark, d, "grid_points")), "track_id")


@query("bathymetry_points", "track_id o_orderkey point_index_in_track", "lon depth_m_positive_down elev_m", f"""
SELECT *, CASE WHEN lon_raw > 180 THEN lon_raw - 360 ELSE lon_raw END AS lon, -depth_raw AS depth_m_positive_down, depth_raw AS elev_m,
  row_number() OVER (PARTITION BY track_id ORDER BY o_orderkey) - 1 AS point_index_in_track FROM grid_points WHERE {_SURFACE} = 'bathymetry'""")
def _(spark, d):
    return P.to_bathymetry(P.split_land(view(spark, d, "grid_points")), "track_id", [F.col("o_orderkey")],
                           F.floor(F.col("o_orderkey") / 100_000))


@query("land_points", "track_id", "lon_raw lat_raw lon lat elevation_m", f"""
SELECT *, CASE WHEN lon_raw > 180 THEN lon_raw - 360 ELSE lon_raw END AS lon, lat_raw AS lat, depth_raw AS elevation_m FROM grid_points WHERE {_SURFACE} = 'land'""")
def _(spark, d):
    return P.to_land(P.split_land(view(spark, d, "grid_points")), "track_id")


# --- incremental ----------------------------------------------------------------------------------------

def _ingest(spark, d):
    """Files of both layouts arrive in two lots; each run picks up the new ones."""
    source, sink, errors, checkpoint = (fresh_path(spark, n) for n in ("new-files", "points", "parse-errors", "ingest-checkpoint"))
    lines = view(spark, d, "sounding_lines")
    for part in (0, 1):
        X.write_text(lines.where(F.col("l_suppkey") % 2 == part), source, "src", LINE_ORDER)
        IN.ingest_incremental(spark, source, sink, errors, checkpoint, X.SOURCE_PATTERN, _usable).awaitTermination()
    return sink, errors


@query("ingested_points", "file_id point_index_in_file data_layout date_raw sonar_idx qc_pass_basic qc_reason", "lon lat depth_m_positive_down", f"""
SELECT l.file_id, line_no AS point_index_in_file, data_layout, CASE WHEN six THEN '20120614' END AS date_raw, CASE WHEN six THEN CAST(l_linenumber AS BIGINT) END AS sonar_idx,
  {S.wrap_lon('lon_d::DOUBLE')} AS lon, lat_d::DOUBLE AS lat, depth_d::DOUBLE AS depth_m_positive_down,
  (lat_d <= 90 AND depth_d > 0 AND depth_d <= 12000) AS qc_pass_basic, concat_ws(',', CASE WHEN lat_d > 90 THEN 'invalid_lat' END, CASE WHEN depth_d <= 0 THEN 'non_positive_depth' END,
    CASE WHEN depth_d > 12000 THEN 'extreme_depth' END, CASE WHEN depth_d <= 0 THEN 'non_negative_elev' END) AS qc_reason
FROM (SELECT *, CAST(src AS VARCHAR) AS file_id FROM line_numbers) AS l JOIN audit_q USING (file_id) WHERE used_for_points AND NOT bad""")
def _(spark, d):
    return spark.read.option("basePath", (sink := _ingest(spark, d)[0])).parquet(sink)


@query("ingest_errors", "file_id point_index_in_file data_layout", "", """
SELECT l.file_id, line_no AS point_index_in_file, data_layout FROM (SELECT *, CAST(src AS VARCHAR) AS file_id FROM line_numbers) AS l JOIN audit_q USING (file_id) WHERE used_for_points AND bad""")
def _(spark, d):
    return spark.read.parquet(_ingest(spark, d)[1])


@query("refreshed_file_cells", "file_id cell_id n_points cruise_id data_layout", "median_depth_m_positive_down q75_depth_m std_depth_m", "fc_a")
def _(spark, d):
    """Points arrive in two lots; only the touched files of the file-cell table are replaced."""
    points, target, checkpoint = (fresh_path(spark, n) for n in ("points", "file-cells", "refresh-checkpoint"))
    rows = view(spark, d, "soundings").withColumn("point_index_in_file", F.lit(None).cast("bigint"))
    columns = [c.split()[0] for c in IN.POINT_SCHEMA.split(", ")]
    rows = rows.select(*columns, "l_orderkey")
    for part in (0, 1):
        rows.where(F.col("l_orderkey") % 2 == part).drop("l_orderkey").repartition("file_id").write.mode("append").partitionBy("file_id").option(*COMMIT).parquet(points)
        IN.refresh_file_cells(spark, points, target, checkpoint).awaitTermination()
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in spark.read.parquet(target).schema if f.name != 'file_id')}, file_id string").parquet(target)


@query("ingested_file_cells", "file_id cell_id n_points version", "median_depth_m_positive_down", f"""
SELECT file_id, {S.CELL_ID}, count(*) AS n_points, any_value(CASE WHEN src % 3 = 0 THEN 2 ELSE 1 END) AS version, median(depth) AS median_depth_m_positive_down FROM (
  SELECT src, CAST(src AS VARCHAR) AS file_id, depth_d::DOUBLE AS depth, CAST(floor(({S.wrap_lon('lon_d::DOUBLE')} + 180) * 60) AS BIGINT) AS lon_bin, CAST(floor((lat_d::DOUBLE + 90) * 60) AS BIGINT) AS lat_bin
  FROM sounding_lines WHERE NOT bad AND depth_d > 0 AND depth_d <= 12000 AND lat_d <= 90 AND CAST(src AS VARCHAR) IN (SELECT file_id FROM audit_q WHERE used_for_points))
GROUP BY file_id, lat_bin, lon_bin""")
def _(spark, d):
    """Text files arrive, are replaced by a second version, and the file-cells follow: ingest, then refresh from its log."""
    names = ("new-files", "points", "parse-errors", "versions", "ingest-checkpoint", "file-cells", "refresh-checkpoint")
    source, sink, errors, log, seen, target, done = (fresh_path(spark, n) for n in names)
    lines = view(spark, d, "sounding_lines")
    # the first version of every third file lacks most of its lines
    lots = [(1, lines.where("src % 3 <> 0 OR l_orderkey % 5 = 0")), (2, lines.where("src % 3 = 0"))]
    for version, rows in lots:
        X.write_text(rows, f"{source}/v={version}", "src", LINE_ORDER)
        IN.ingest_incremental(spark, source, sink, errors, seen, X.SOURCE_PATTERN, _usable, log, r"/v=(\d+)/").awaitTermination()
        IN.refresh_ingested(spark, sink, log, target, done).awaitTermination()
    found = spark.read.parquet(target).schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString() if f.name != 'file_id' else 'string'}" for f in found)
    return IN.current_file_cells(spark, target, log, schema)


@query("file_cells_from_text", "file_id cell_id n_points", "median_depth_m_positive_down", f"""
SELECT file_id, {S.CELL_ID}, count(*) AS n_points, median(depth) AS median_depth_m_positive_down FROM (
  SELECT CAST(src AS VARCHAR) AS file_id, depth_d::DOUBLE AS depth, CAST(floor(({S.wrap_lon('lon_d::DOUBLE')} + 180) * 60) AS BIGINT) AS lon_bin, CAST(floor((lat_d::DOUBLE + 90) * 60) AS BIGINT) AS lat_bin
  FROM sounding_lines WHERE NOT bad AND depth_d > 0 AND CAST(src AS VARCHAR) IN (SELECT file_id FROM audit_q WHERE used_for_points)) GROUP BY file_id, lat_bin, lon_bin""")
def _(spark, d):
    """Text files to file-cells end to end: audit, parse, check, aggregate."""
    lines = _lines(spark, d)
    good, _bad = TX.split_errors(TX.parse_soundings(lines, _usable(lines)))
    return file_cells_a(P.qc_survey_points(P.survey_points(good)), attributes=("data_layout",))
