"""File, archive and track manifests: audits, classification, routing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stats import n_true
from .groups import digest_agg, null_safe_join
from .points import depth_sign_strict
from .tables import flag_ids

# Ranges, layouts, statuses and class limits.
DEPTH_BOUND_M = 12000.0
LAYOUT_3COL = "lon_lat_depth_3col"
LAYOUT_6COL = "date_time_sonar_lon_lat_depth_6col"
LAYOUT_UNKNOWN = "unknown_or_non_bathymetry"
OK_STATUSES = ["ok_xyz_3col", "ok_xyz_6col_time_sonar_lonlatdepth"]
AUXILIARY = {"grid_": "auxiliary_grid", "track_": "auxiliary_track", "dist_": "auxiliary_dist"}
DUPLICATE_FIELDS = ["filename", "size_bytes", "line_count", "lon_min", "lon_max", "lat_min", "lat_max", "depth_min",
                    "depth_max"]
MULTIBEAM_POINTS, SINGLEBEAM_POINTS = 1_000_000, 100_000
BBOX_CUTOFF_KM2, DENSITY_CUTOFF = 5000.0, 50.0
REVIEW_MIN_POINTS, REVIEW_BBOX_KM2, REVIEW_DENSITY = 1000, 5000.0, 50.0
RATIO_LOW, RATIO_HIGH, JACCARD_MIN = 0.5, 2.0, 0.5


def _within(lo: Column, hi: Column, a: float, b: float) -> Column:
    return F.coalesce(lo.between(a, b) & hi.between(a, b), F.lit(False))


def _position_ok(lon: str, lat: str) -> Column:
    lo, hi = F.col(f"{lon}_min"), F.col(f"{lon}_max")
    lon_ok = _within(lo, hi, -180.0, 180.0) | _within(lo, hi, 0.0, 360.0)
    return lon_ok & _within(F.col(f"{lat}_min"), F.col(f"{lat}_max"), -90.0, 90.0)


def _depth_ok(c: str) -> Column:
    return F.coalesce((F.col(f"{c}_min") >= -DEPTH_BOUND_M) & (F.col(f"{c}_max") <= DEPTH_BOUND_M), F.lit(False))


def audit_files(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per text file from its lines (`value`, 0-based `line_no`): layout, ranges, sign and status.

    Write the result before filtering on it: the status depends on the layout, the layout on the ranges, and a
    filter pushed through that chain makes the optimizer expand it many times over.
    """
    tokens = F.split(F.trim(F.col("value")), r"\s+")
    parsed = lines.select(
        key, "line_no", (F.trim("value") == "").alias("blank"), F.size(tokens).alias("n_tokens"),
        *[geo.nan_to_null(F.try_element_at(tokens, F.lit(i)).try_cast("double")).alias(f"c{i}") for i in range(1, 7)])
    three = F.col("c1").isNotNull() & F.col("c2").isNotNull() & F.col("c3").isNotNull()
    six = three & F.col("c4").isNotNull() & F.col("c5").isNotNull() & F.col("c6").isNotNull()
    ranges = []
    for i in range(1, 7):
        v = F.when(three if i <= 3 else six, F.col(f"c{i}"))
        ranges += [F.min(v).alias(f"c{i}_min"), F.max(v).alias(f"c{i}_max")]

    def at(n: int, c: Column) -> Column:
        return F.max(F.when(F.col("line_no") == n, c))

    first_blank, header = at(0, F.col("blank")), at(0, F.col("c1").isNull() & ~F.col("blank"))
    second = at(1, ~F.col("blank"))
    files = parsed.groupBy(key).agg(
        F.sum(F.when(~F.col("blank"), 1).otherwise(0)).alias("line_count"), n_true(three).alias("n_parsed"),
        n_true(six).alias("n_parsed6"), first_blank.alias("first_blank"), header.alias("has_header"),
        F.coalesce(second, F.lit(False)).alias("has_second"), at(0, F.col("n_tokens")).alias("cols_first"),
        at(1, F.col("n_tokens")).alias("cols_second"), *ranges)
    files = files.withColumn("col_count", F.when(F.col("first_blank"), 0).when(
        F.col("has_header") & F.col("has_second"), F.col("cols_second")).otherwise(F.col("cols_first")).cast("bigint"))
    return _with_status(files).drop("first_blank", "has_second", "cols_first", "cols_second", "n_parsed", "n_parsed6",
                                    *[f"c{i}_{s}" for i in range(1, 7) for s in ("min", "max")])


def _with_status(files: DataFrame) -> DataFrame:
    unread = F.col("first_blank") | (F.col("has_header") & ~F.col("has_second")) | (F.col("col_count") < 3) | (
        F.col("n_parsed") == 0)
    as3 = _position_ok("c1", "c2") & _depth_ok("c3")
    six_cols = (F.col("col_count") >= 6) & (F.col("n_parsed6") > 0)
    as6 = six_cols & _position_ok("c4", "c5") & _depth_ok("c6")
    layout = (F.when(unread, LAYOUT_UNKNOWN).when(as3, LAYOUT_3COL).when(as6, LAYOUT_6COL).otherwise(LAYOUT_UNKNOWN))
    files = files.withColumn("data_layout", layout)
    is6 = F.col("data_layout") == LAYOUT_6COL
    for name, a, b in (("lon", "c1", "c4"), ("lat", "c2", "c5"), ("depth", "c3", "c6")):
        for s in ("min", "max"):
            files = files.withColumn(f"{name}_{s}", F.when(is6, F.col(f"{b}_{s}")).when(~unread, F.col(f"{a}_{s}")))
    files = files.withColumn("depth_sign", F.coalesce(
        depth_sign_strict(F.col("depth_min"), F.col("depth_max")), F.lit("unknown")))
    known = F.col("data_layout") != LAYOUT_UNKNOWN
    status = (F.when(F.col("first_blank"), "zero_or_empty_file")
              .when(F.col("has_header") & ~F.col("has_second"), "parse_error")
              .when(F.col("col_count") < 3, "non_xyz_column_count").when(F.col("n_parsed") == 0, "zero_or_empty_file")
              .when(known & (F.col("depth_sign") == "negative"), "negative_depth_unexpected")
              .when(is6, OK_STATUSES[1]).when(known, OK_STATUSES[0])
              .when(six_cols | ~_depth_ok("c3"), "non_xyz_column_count").otherwise("invalid_lonlat_range"))
    files = files.withColumn("status", status)
    usable = F.col("status").isin(OK_STATUSES) & (F.col("depth_sign") == "positive")

    def column(three: int | None, six: int) -> Column:
        return F.when(is6, six).when(F.col("data_layout") == LAYOUT_3COL, F.lit(three))

    return files.withColumns({
        "used_for_points": usable, "lon_col": column(0, 3), "lat_col": column(1, 4), "depth_col": column(2, 5),
        "date_col": column(None, 0), "time_col": column(None, 1), "sonar_idx_col": column(None, 2)})


def guess_metadata(files: DataFrame) -> DataFrame:
    """Cruise, date and track kind read off the archive and file names."""
    name, archive = F.col("filename"), F.col("archive_id")
    transit = (name.rlike(r"(?i)^(T\d{8}\.dat|.*_t\.dat)$") | F.lower(name).contains("_transit")
               | F.lower(F.concat_ws("/", archive, name)).contains("/transit/"))
    cruise = F.regexp_replace(archive, r"_(?:bathymetry|leg\d+_bathymetry|bathymetry_dmo|bathymetry_pi)(?:_.*)?$", "")
    date = F.coalesce(*[F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for p in (
        r"(?i)^T(\d{8})\.dat$", r"^(\d{8})\.dat$", r"(?:^|[^0-9])(\d{8})(?:[^0-9]|$)")], F.lit(""))
    return files.withColumns({"track_kind": F.when(transit, "transit").otherwise("unknown_or_survey"),
                              "cruise_id_guess": cruise, "date_guess": date})


def filter_files(files: DataFrame, filename_regex: str | None = None, path_regex: str | None = None) -> DataFrame:
    """Keep a file when its name or its path matches; without patterns keep all."""
    tests = [F.col(c).rlike(p) for c, p in (("filename", filename_regex), ("relative_path", path_regex)) if p]
    return files if not tests else files.where(tests[0] if len(tests) == 1 else tests[0] | tests[1])


def curate_files(files: DataFrame) -> DataFrame:
    """File role, include flag with the first reason against it, and the beyond-180-degrees flag."""
    role = F.lit(None).cast("string")
    chain = None
    for prefix, label in AUXILIARY.items():
        cond = F.col("filename").startswith(prefix)
        chain = F.when(cond, label) if chain is None else chain.when(cond, label)
    role = (chain.when(F.col("status") == OK_STATUSES[0], "raw_xyz_3col_candidate")
            .when(F.col("status") == OK_STATUSES[1], "raw_xyz_6col_candidate")
            .when(~F.col("used_for_points"), "nonstandard_or_invalid").otherwise("unknown"))
    files = files.withColumn("file_role", role)
    reason = (F.when(~F.col("used_for_points"), "used_for_points_false")
              .when(F.col("file_role").isin(list(AUXILIARY.values())), F.col("file_role"))
              .when(~F.col("status").isin(OK_STATUSES), "invalid_status")
              .when(~F.col("data_layout").isin(LAYOUT_3COL, LAYOUT_6COL), "unknown_layout")
              .when(F.col("lon_col").isNull() | F.col("lat_col").isNull() | F.col("depth_col").isNull(),
                    "missing_column_index").otherwise(""))
    files = files.withColumn("exclude_reason", reason)
    return files.withColumns({"include_in_points_raw": F.col("exclude_reason") == "",
                              "lon_above_180": F.coalesce(F.col("lon_max") > 180, F.lit(False))})


def duplicate_files(files: DataFrame, fields: Sequence[str] = DUPLICATE_FIELDS) -> DataFrame:
    """Groups of candidate copies: equal in all nine fields, missing equal to missing."""
    return (files.groupBy(*fields).agg(F.count(F.lit(1)).alias("n_copies"),
                                       F.count_distinct("archive_id").alias("n_archives"))
            .where(F.col("n_copies") > 1))


def rollup_archives(files: DataFrame, bad_archives: DataFrame | None = None) -> DataFrame:
    """One row per archive: files by extension and status, ranges, sign, transit and a four-state status."""
    dat = F.col("ext") == ".dat"
    ok = dat & F.col("status").isin(OK_STATUSES)
    bad = dat & ~F.col("status").isin(*OK_STATUSES, "non_dat")
    sign = F.when(dat, F.col("depth_sign"))
    out = files.groupBy("archive_id").agg(
        F.count(F.lit(1)).alias("n_files"), n_true(dat).alias("n_dat_files"),
        n_true(F.col("ext") == ".pdf").alias("n_pdf_files"), n_true(F.col("ext") == ".txt").alias("n_txt_files"),
        n_true(ok).alias("n_readable_dat"), n_true(bad).alias("n_bad_dat"),
        F.sum("size_bytes").alias("total_size_bytes"),
        *[f(F.when(dat, F.col(f"{c}_{s}"))).alias(f"{c}_{s}") for c in ("lon", "lat", "depth")
          for s, f in (("min", F.min), ("max", F.max))],
        F.min(sign).alias("__s1"), F.max(sign).alias("__s2"),
        F.coalesce(F.bool_or(dat & (F.col("track_kind") == "transit")), F.lit(False)).alias("contains_transit"),
        F.coalesce(F.min(F.when(dat, F.col("cruise_id_guess"))), F.lit("")).alias("cruise_id_guess"))
    out = out.withColumn("depth_sign", F.when(F.col("__s1").isNull(), "").when(
        F.col("__s1") == F.col("__s2"), F.col("__s1")).otherwise("mixed")).drop("__s1", "__s2")
    if bad_archives is None:
        out = out.withColumn("is_bad", F.lit(False))
    else:
        out = flag_ids(out, bad_archives, "archive_id", "is_bad")
    status = (F.when(F.col("is_bad"), "bad_archive")
              .when((F.col("n_bad_dat") > 0) & (F.col("n_readable_dat") == 0), "all_dat_bad")
              .when(F.col("n_bad_dat") > 0, "partial_bad").otherwise("ok"))
    return out.withColumn("status", status).drop("is_bad")


def cruise_inventory(files: DataFrame, flags: DataFrame) -> DataFrame:
    """Files, ranges, and kept and excluded file counts per cruise."""
    joined = files.join(flags.select("file_id", "exclude_from_primary_cells"), "file_id", "left")
    excluded = F.coalesce(F.col("exclude_from_primary_cells"), F.lit(False))
    return joined.groupBy("cruise_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.min("lon_min").alias("lon_min"), F.max("lon_max").alias("lon_max"),
        F.min("lat_min").alias("lat_min"), F.max("lat_max").alias("lat_max"), n_true(~excluded).alias("n_keep"),
        n_true(excluded).alias("n_exclude"))


# --- track manifest -----------------------------------------------------------------------------------

def track_extent(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("lon").alias("bbox_lon_min"), F.max("lon").alias("bbox_lon_max"),
        F.min("lat").alias("bbox_lat_min"), F.max("lat").alias("bbox_lat_max"))
    return out.withColumn("bbox_area_km2", geo.bbox_km2("bbox_lon_min", "bbox_lon_max", "bbox_lat_min", "bbox_lat_max"))


def classify_tracks(tracks: DataFrame, multibeam: int = MULTIBEAM_POINTS, singlebeam: int = SINGLEBEAM_POINTS,
                    bbox_km2: float = BBOX_CUTOFF_KM2, density: float = DENSITY_CUTOFF) -> DataFrame:
    """Single- or multibeam by point count, and by extent and density in between."""
    n, area = F.col("n_points"), F.col("bbox_area_km2")
    many, few = n > multibeam, n < singlebeam
    dense = F.when(area <= 0, F.lit(float("inf"))).otherwise(F.try_divide(n.cast("double"), area))
    tracks = tracks.withColumn("point_density_ppkm2", dense)
    reason = (F.when(many, "hard_mb_points").when(few, "hard_sb_points")
              .when(area < bbox_km2, "borderline_bbox_below_cutoff")
              .when(F.col("point_density_ppkm2") > density, "borderline_density_above_cutoff")
              .otherwise("borderline_default_sb"))
    tracks = tracks.withColumn("class_reason", reason)
    single = F.col("class_reason").isin("hard_sb_points", "borderline_default_sb")
    return tracks.withColumn("instrument_class", F.when(single, "sb").otherwise("mb"))


def review_reason(tracks: DataFrame, singlebeam: int = SINGLEBEAM_POINTS) -> DataFrame:
    """Semicolon list of reasons to review a classification."""
    small = (F.col("n_points") < singlebeam) & (F.col("n_points") >= REVIEW_MIN_POINTS)
    compact = F.col("bbox_area_km2") < REVIEW_BBOX_KM2
    dense = (F.col("point_density_ppkm2") > REVIEW_DENSITY) & (F.col("point_density_ppkm2") < float("inf"))
    reasons = F.array(F.when(F.col("instrument_class") == "mb", F.col("class_reason")),
                      F.when(small & dense & compact, "review_multibeam_candidate")
                      .when(small & dense, "review_high_density_small_track"),
                      F.when(F.col("class_reason") == "borderline_default_sb", "borderline_default_singlebeam"))
    return tracks.withColumn("review_reason", F.array_join(F.array_distinct(F.array_compact(reasons)), ";"))


def size_band(n: Column, multibeam: int = MULTIBEAM_POINTS, singlebeam: int = SINGLEBEAM_POINTS) -> Column:
    return F.when(n > multibeam, ">1M").when(n >= singlebeam, "100k-1M").otherwise("<100k")


def classifier_profile(tracks: DataFrame, multibeam: int = MULTIBEAM_POINTS, singlebeam: int = SINGLEBEAM_POINTS) -> DataFrame:
    band = size_band(F.col("n_points"), multibeam, singlebeam).alias("band")
    return tracks.groupBy(band, "instrument_class").agg(F.count(F.lit(1)).alias("n_tracks"))


def borderline_tracks(tracks: DataFrame, by: str, n: int = 10, multibeam: int = MULTIBEAM_POINTS,
                      singlebeam: int = SINGLEBEAM_POINTS) -> DataFrame:
    """Borderline tracks with the largest density or extent."""
    return (tracks.where(F.col("n_points").between(singlebeam, multibeam))
            .orderBy(F.col(by).desc_nulls_last(), "track_id").limit(n))


def completeness(tracks: DataFrame) -> DataFrame:
    """Which archives hold a track: both, or only one side."""
    has = tracks.groupBy("track_id").agg(F.bool_or(F.col("source_type") == "decoded").alias("in_nc"),
                                         F.bool_or(F.col("source_type") == "xyz").alias("in_xyz"))
    label = (F.when(F.col("in_nc") & F.col("in_xyz"), "nc_xyz_intersect").when(F.col("in_nc"), "nc_only")
             .when(F.col("in_xyz"), "xyz_only"))
    return has.select("track_id", label.alias("source_completeness"))


def route_entries(tracks: DataFrame, clipped: DataFrame) -> DataFrame:
    """Route each track entry to primary, supplementary, regional or skip, with reason and anomaly flag."""
    joined = null_safe_join(tracks, clipped, ["track_id", "source_type"], "left")
    usable = F.col("has_depth") & F.col("depth_sign_raw").isin("mostly_positive", "mostly_negative")
    decoded, xyz = F.col("source_type") == "decoded", F.col("source_type") == "xyz"
    both = F.col("source_completeness") == "nc_xyz_intersect"
    priority = (F.when(decoded & usable, "primary").when(decoded, "skip").when(xyz & both, "supplementary")
                .when(xyz, "primary").otherwise("regional"))
    out = joined.withColumn("source_priority", priority)
    p = F.col("source_priority")
    anomaly = F.coalesce((F.col("n_clipped") > 0) & p.isin("primary", "supplementary"), F.lit(False))
    return out.withColumns({
        "bathymetry_eligible": p != "skip", "use_for_primary_bathymetry": p == "primary",
        "use_for_supplementary_bathymetry": p == "supplementary",
        "skip_reason": F.when(p == "skip", "no_usable_depth"), "depth_anomaly_flag": anomaly})


def derive_branch(entries: DataFrame) -> DataFrame:
    """Branch and source tag of an entry; supplementary and skipped entries have none."""
    p = F.col("source_priority")
    branch = (F.when(p == "regional", "regional").when((p == "primary") & (F.col("instrument_class") == "mb"), "multibeam")
              .when(p == "primary", "singlebeam"))
    tag = F.when(F.col("source_type") == "decoded", "nc").when(F.col("source_type") == "xyz", "xyz").otherwise("")
    return entries.withColumns({"branch": branch, "source_tag": tag})


def pair_tracks(points: DataFrame) -> DataFrame:
    """Per track and side: raw and valid counts, median valid depth and bounding box."""
    d = F.col("depth_m_positive_down")
    valid = F.when(F.col("source_type") == "decoded", F.col("point_check_pass_basic")).otherwise(d > 0)
    rows = points.where(F.col("source_type").isin("decoded", "xyz")).withColumn(
        "__valid_depth", F.when(F.coalesce(valid, F.lit(False)), d))
    aggs = [F.count(F.lit(1)).alias("n_raw"), F.count("__valid_depth").alias("n_valid"),
            F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"),
            F.max("lat").alias("lat_max")]
    sides = digest_agg(rows, ["track_id", "source_type"], aggs, {"depth_med": ("__valid_depth", 0.5)})

    def side(kind: str, suffix: str) -> DataFrame:
        return (sides.where(F.col("source_type") == kind).drop("source_type")
                .withColumnsRenamed({c: f"{c}_{suffix}" for c in sides.columns if c not in ("track_id", "source_type")}))

    return side("decoded", "nc").join(side("xyz", "xyz"), "track_id")


def divergence(pairs: DataFrame) -> DataFrame:
    """Do the two submissions of one track disagree in count, depth or place?"""
    def span(a: str, s: str) -> Column:
        return F.greatest(F.lit(0.0), F.col(f"{a}_max_{s}") - F.col(f"{a}_min_{s}"))

    def shared(a: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(f"{a}_max_nc", f"{a}_max_xyz") - F.greatest(f"{a}_min_nc", f"{a}_min_xyz"))

    inter = shared("lon") * shared("lat")
    union = span("lon", "nc") * span("lat", "nc") + span("lon", "xyz") * span("lat", "xyz") - inter
    jaccard = F.coalesce(F.when(union > 0, F.try_divide(inter, union)), F.lit(0.0))
    out = pairs.withColumns({
        "valid_count_ratio": F.try_divide(F.col("n_valid_nc"), F.col("n_valid_xyz")),
        "depth_med_ratio": F.when(F.col("depth_med_xyz") > 0, F.try_divide(F.col("depth_med_nc"), F.col("depth_med_xyz"))),
        "bbox_overlap_jaccard": jaccard})

    def off(c: str) -> Column:
        return F.coalesce(~F.col(c).between(RATIO_LOW, RATIO_HIGH), F.lit(True))

    return out.withColumn("divergent_flag", off("valid_count_ratio") | off("depth_med_ratio")
                          | (F.col("bbox_overlap_jaccard") < JACCARD_MIN))


def manual_review(entries: DataFrame, divergent: DataFrame, listed: DataFrame) -> DataFrame:
    """Review flag: a depth anomaly, a divergence in place only, or an explicit listing."""
    place_only = divergent.where((F.col("bbox_overlap_jaccard") < JACCARD_MIN)
                                 & F.col("valid_count_ratio").between(RATIO_LOW, RATIO_HIGH)
                                 & F.col("depth_med_ratio").between(RATIO_LOW, RATIO_HIGH))
    out = flag_ids(flag_ids(entries, place_only, "track_id", "__place"), listed, "track_id", "__listed")
    flag = F.col("depth_anomaly_flag") | F.col("__place") | F.col("__listed")
    return out.withColumn("manual_review_flag", flag).drop("__place", "__listed")
