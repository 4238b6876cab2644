import math

import pytest
from pyspark.sql import functions as F

from leadline.functions import bins, geo
from leadline.operators import manifests as MF
from leadline.operators import points as P
from leadline.operators import tables as TB
from leadline.operators.products import map_tier
from leadline.plans import exports as X
from leadline.sources import text as TX
from leadline.streaming import ingest as IN


def values(spark, expr, inputs, kind="double"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_longitudes_and_cells(spark):
    assert values(spark, geo.wrap_lon, [-180.0, 179.999, 180.0, 190.0, 359.5, -190.0]) == pytest.approx([-180, 179.999, -180, -170, -0.5, 170])
    assert values(spark, geo.shift_lon, [180.0, 190.0, -180.0, None]) == [180.0, -170.0, -180.0, None]
    assert values(spark, geo.clean_lat, [90.0, 90.001, -90.0]) == [90.0, None, -90.0]
    assert values(spark, geo.lat_band, [90.0, -90.0, 29.99, None]) == [80, -90, 20, None]
    assert values(spark, lambda c: geo.region_10deg(c, F.lit(-11.0)), [-170.0, 5.0, None]) == ["lon-170_lat-020", "lon0000_lat-020", "unknown"]
    assert values(spark, lambda c: geo.cell_key(geo.lat_bin(F.lit(90.0)), geo.lon_bin(c)), [180.0]) == [10800 * 21601 + 21600]


def test_bin_edges(spark):
    assert values(spark, bins.depth_bin_metric, [-1.0, 0.0, 1000.0, 6999.9, 7000.0, None]) == ["unknown", "0-1000m", "1000-3000m", "5000-7000m", ">7000m", "unknown"]
    lo = lambda f: (lambda c: f(c)["lo"])
    assert values(spark, lo(bins.policy_depth_bin), [-5.0, 0.0, 200.0, 11500.0, 20000.0, None]) == [0, 0, 200, 6000, 6000, None]
    assert values(spark, lo(bins.duplicate_ratio_bin), [0.0, 0.01, 0.5, 1.0]) == [0.0, 0.01, 0.5, 0.5]
    assert values(spark, lo(bins.unique_count_bin), [0.0, 10.0, 1e9]) == [1, 10, 10000]
    assert values(spark, bins.n_points_bin, [0, 50, 51, 1000, 1001], "int") == [None, "1–50", "50–100", "300–1000", ">1000"]


def test_survey_checks_keep_missing_values_failing(spark):
    rows = [(10.0, 0.0, 5.0), (180.0, 0.0, 5.0), (10.0, 90.001, 5.0), (10.0, 0.0, 0.0), (10.0, 0.0, 12000.0), (10.0, 0.0, 12000.001), (10.0, 0.0, None)]
    df = spark.createDataFrame(rows, "lon double, lat double, depth_m_positive_down double").withColumn("elev_m", -F.col("depth_m_positive_down"))
    got = P.qc_survey_points(df).select("qc_pass_basic", "qc_reason").collect()
    assert [r[0] for r in got] == [True, False, False, False, True, False, False]
    assert [r[1] for r in got] == ["", "invalid_lon", "invalid_lat", "non_positive_depth,non_negative_elev", "", "extreme_depth",
                                   "non_positive_depth,extreme_depth,non_negative_elev,nan_value"]


def test_depth_sign_and_clip(spark):
    rows = [("neg", -10.0)] * 30 + [("neg", 4.0), ("neg", -11500.001), ("mix", 1.0), ("mix", -1.0), ("zero", 0.0), ("none", None)]
    df = spark.createDataFrame(rows, "track_id string, depth_raw double")
    signs = P.track_signs(df)
    assert dict(signs.collect()) == {"neg": "mostly_negative", "mix": "mixed_sign", "zero": "all_zero", "none": "no_depth_values"}
    got = P.normalize_depth(df, signs)
    assert got.where("track_id = 'neg' and sign_warning").select("depth_m_positive_down", "elev_m").collect()[0][:] == (4.0, -4.0)
    assert got.where("was_clipped").select("depth_m_positive_down").collect()[0][0] is None
    assert got.where("track_id = 'mix' and depth_m_positive_down is null and sign_warning").count() == 2


def test_classifier_limits(spark):
    rows = [("a", 1_000_001, 1.0), ("b", 99_999, 1.0), ("c", 100_000, 4999.9), ("d", 1_000_000, 19_999.0), ("e", 101_907, 63028.979), ("f", 500_000, 0.0)]
    tracks = spark.createDataFrame(rows, "track_id string, n_points bigint, bbox_area_km2 double")
    got = {r["track_id"]: r for r in MF.review_reason(MF.classify_tracks(tracks)).collect()}
    assert {k: (r["instrument_class"], r["class_reason"]) for k, r in got.items()} == {
        "a": ("mb", "hard_mb_points"), "b": ("sb", "hard_sb_points"), "c": ("mb", "borderline_bbox_below_cutoff"),
        "d": ("mb", "borderline_density_above_cutoff"), "e": ("sb", "borderline_default_sb"), "f": ("mb", "borderline_bbox_below_cutoff")}
    assert math.isinf(got["f"]["point_density_ppkm2"]) and got["e"]["point_density_ppkm2"] == pytest.approx(1.616828, abs=1e-6)
    assert got["b"]["review_reason"] == "review_multibeam_candidate" and got["e"]["review_reason"] == "borderline_default_singlebeam"


FILES = {
    "ok3": "140.5 30.1 1200\n\n140.6 30.2 1300\n", "six": "20120614 101010 1 140.5 30.1 900\n20120614 101011 2 140.6 30.2 950\n",
    "header": "lon lat depth\n140.5 30.1 10\n", "only_header": "lon lat depth\n", "two": "1 2\n3 4\n", "neg": "140 30 -5\n141 31 -6\n",
    "lat": "140 95 5\n", "deep": "140 30 15000\n", "blank": "\n140 30 5\n", "text": "140 x 5\n"}


def test_file_audit_and_parse(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / "raw" / name).mkdir(parents=True)
        (tmp_path / "raw" / name / "a.dat").write_text(body)
    lines = TX.read_lines(spark, str(tmp_path / "raw"), r"raw/([^/]+)/")
    audit = {r["file_id"]: r for r in MF.audit_files(lines).collect()}
    assert {k: r["status"] for k, r in audit.items()} == {
        "ok3": "ok_xyz_3col", "six": "ok_xyz_6col_time_sonar_lonlatdepth", "header": "ok_xyz_3col", "only_header": "parse_error",
        "two": "non_xyz_column_count", "neg": "negative_depth_unexpected", "lat": "invalid_lonlat_range", "deep": "non_xyz_column_count",
        "blank": "zero_or_empty_file", "text": "zero_or_empty_file"}
    assert audit["six"]["lon_col"] == 3 and audit["six"]["date_col"] == 0 and audit["ok3"]["date_col"] is None
    assert audit["ok3"]["line_count"] == 2 and audit["ok3"]["depth_max"] == 1300.0
    manifest = MF.audit_files(lines)
    points = TX.parse_soundings(lines, spark.createDataFrame(manifest.collect(), manifest.schema).where("file_id in ('header', 'six')"))
    good, bad = TX.split_errors(points)
    assert bad.count() == 1 and good.count() == 3
    assert sorted(r["sonar_idx"] for r in good.where("file_id = 'six'").collect()) == [1, 2]
    assert {r["filename"] for r in TX.scan_files(spark, str(tmp_path / "raw")).collect()} == {"a.dat"}


def test_text_is_written_in_few_files_whose_names_keep_the_order(spark, tmp_path):
    rows = [(f"s{k % 40}" if k % 7 else None if k % 2 else "", 50_000 * k if k % 11 else None, f"line {k}") for k in range(4_000)]
    path = str(tmp_path / "text")
    X.write_text(spark.createDataFrame(rows, "source string, at bigint, line string").repartition(5), path, "source", ["at", "line"])
    files = list((tmp_path / "text").glob("src=*/*.txt"))
    assert len(files) <= 41 + 4                                          # a file for each source and one more for each border between tasks
    got = TX.read_lines(spark, path, X.SOURCE_PATTERN).collect()
    want = {}
    for source, at, line in rows:
        want.setdefault(source or X.NO_SOURCE, []).append((-1 if at is None else at, line))
    assert {(r.file_id, r.line_no, r.value) for r in got} == {(s, i, line) for s, some in want.items() for i, (_, line) in enumerate(sorted(some))}


def test_refreshed_files_are_written_and_read_alone(spark, tmp_path):
    points, target, state = (str(tmp_path / n) for n in ("points", "cells", "state"))
    rows = [(f, "c", "a", "k", "l", i, 140.0, 30.0 + i / 10, 100.0, None, None, None) for f in ("a+b::1 %3A", "c") for i in range(60)]
    spark.createDataFrame(rows, IN.POINT_SCHEMA).repartition("file_id").write.partitionBy("file_id").parquet(points)
    IN.refresh_file_cells(spark, points, target, state).awaitTermination()
    assert len(list((tmp_path / "cells").glob("file_id=*/part-*"))) <= 2 + 3
    assert {r.file_id: r["count"] for r in spark.read.parquet(target).groupBy("file_id").count().collect()} == {"a+b::1 %3A": 60, "c": 60}


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = [(f"s{k}", k, f"line {k}") for k in range(300)]
    path = str(tmp_path / "text")
    X.write_text(spark.createDataFrame(rows, "source string, at bigint, line string"), path, "source", ["at"])
    context = spark.sparkContext
    context.setJobGroup("listing", "listing")
    try:
        lines = TX.read_lines(spark, path, X.SOURCE_PATTERN)
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        context._jsc.clearJobGroup()
    most = max(32, 4 * context.defaultParallelism)
    assert stages and max(s.numTasks for s in stages) <= most < 300
    assert lines.count() == 300


def test_ingest_reads_each_file_once(spark, tmp_path):
    source, sink, errors, state = (str(tmp_path / n) for n in ("in", "out", "bad", "state"))

    def layouts(lines):
        six = F.col("file_id") == "2"
        return lines.select("file_id").distinct().withColumns({
            "data_layout": F.when(six, MF.LAYOUT_6COL).otherwise(MF.LAYOUT_3COL), "lon_col": F.when(six, 3).otherwise(0), "lat_col": F.when(six, 4).otherwise(1),
            "depth_col": F.when(six, 5).otherwise(2), "date_col": F.when(six, 0), "time_col": F.when(six, 1), "sonar_idx_col": F.when(six, 2)})

    (tmp_path / "in" / "src=1").mkdir(parents=True)
    (tmp_path / "in" / "src=1" / "a.txt").write_text("140 30 100\n140 30 -1\nbroken\n")
    run = lambda: IN.ingest_incremental(spark, source, sink, errors, state, r"src=([^/]+)/", layouts).awaitTermination()
    run()
    run()
    assert spark.read.parquet(sink).count() == 2
    assert [(r.file_id, r.point_index_in_file) for r in spark.read.parquet(errors).collect()] == [("1", 2)]
    (tmp_path / "in" / "src=2").mkdir()
    (tmp_path / "in" / "src=2" / "b.txt").write_text("20120614 120000 7 150 31 200\n20120614 x\n")
    run()
    got = spark.read.parquet(sink)
    assert got.count() == 3 and got.where("qc_pass_basic").count() == 2
    assert got.where("file_id = '2'").select("sonar_idx", "date_raw", "lon").collect() == [(7, "20120614", 150.0)]
    assert spark.read.parquet(errors).count() == 2


def test_refresh_touches_only_files_with_new_points(spark, tmp_path):
    points, target, state = (str(tmp_path / n) for n in ("points", "cells", "state"))
    columns = [c.split()[0] for c in IN.POINT_SCHEMA.split(", ")]

    def add(rows):
        full = [(f, "c", "a", "k", "l", i, 140.0, 30.0, float(d), None, None, None) for i, (f, d) in enumerate(rows)]
        df = spark.createDataFrame(full, IN.POINT_SCHEMA).select(*columns)
        df.repartition("file_id").write.mode("append").partitionBy("file_id").parquet(points)
        IN.refresh_file_cells(spark, points, target, state).awaitTermination()
        return {(r.file_id, r.n_points, r.median_depth_m_positive_down) for r in spark.read.parquet(target).collect()}

    files = lambda name: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "cells" / f"file_id={name}").glob("part-*")}
    assert add([("x", 100), ("y", 50)]) == {("x", 1, 100.0), ("y", 1, 50.0)}
    before = files("y")
    assert add([("x", 200), ("z", 10)]) == {("x", 2, 150.0), ("y", 1, 50.0), ("z", 1, 10.0)}
    assert files("y") == before and len(before) == 1


def test_refresh_follows_the_versions_that_the_ingest_logs(spark, tmp_path):
    source, sink, errors, log, seen, target = (str(tmp_path / n) for n in ("in", "out", "bad", "log", "seen", "cells"))
    pattern = r"/v=(\d+)/"

    def layouts(lines):
        return lines.select("file_id").distinct().withColumns({"data_layout": F.lit(MF.LAYOUT_3COL), "lon_col": F.lit(0), "lat_col": F.lit(1), "depth_col": F.lit(2),
                                                               **{c: F.lit(None).cast("int") for c in ("date_col", "time_col", "sonar_idx_col")}})

    def put(version, src, name, text):
        folder = tmp_path / "in" / f"v={version}" / f"src={src}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    def cells(state="done"):
        IN.ingest_incremental(spark, source, sink, errors, seen, r"src=([^/]+)/", layouts, log, pattern).awaitTermination()
        IN.refresh_ingested(spark, sink, log, target, str(tmp_path / state)).awaitTermination()
        kinds = ", ".join(f"{f.name} {'string' if f.name == 'file_id' else f.dataType.simpleString()}" for f in spark.read.parquet(target).schema)
        return {(r.file_id, r.version, r.n_points, r.median_depth_m_positive_down) for r in IN.current_file_cells(spark, target, log, kinds).collect()}

    put(1, "x", "a.txt", "140 30 100\n140 30 300\n")
    put(1, "y", "a.txt", "140 30 50\n")
    assert cells() == {("x", 1, 2, 200.0), ("y", 1, 1, 50.0)}
    put(1, "x", "b.txt", "140 30 500\n")                                                 # more of the same version
    assert cells() == {("x", 1, 3, 300.0), ("y", 1, 1, 50.0)}
    put(2, "x", "a.txt", "140 30 10\n")                                                  # new content, same file
    put(2, "y", "a.txt", "140 30 -5\n")                                                  # whose last version has no passing point
    put(1, "z", "a.txt", "140 30 7\n")
    want = {("x", 2, 1, 10.0), ("z", 1, 1, 7.0)}
    assert cells() == want
    assert cells("replayed") == want                                                     # the whole log once more


def test_missing_values_and_nan_are_the_same(spark):
    nan, inf = float("nan"), float("inf")
    raw = spark.createDataFrame([(1, 10.0, 5.0, nan), (2, 10.0, 5.0, None), (3, nan, 5.0, 7.0), (4, 10.0, 5.0, inf), (5, 10.0, 5.0, 7.0)],
                                "i int, lon_raw double, lat_raw double, depth_raw double")
    rows = {r["i"]: r for r in P.qc_survey_points(P.survey_points(raw)).collect()}
    assert rows[1]["qc_reason"] == rows[2]["qc_reason"] == rows[4]["qc_reason"] and "nan_value" in rows[1]["qc_reason"] and "non_positive_depth" in rows[1]["qc_reason"]
    assert not rows[3]["qc_pass_basic"] and rows[5]["qc_pass_basic"]
    direct = spark.createDataFrame([(1, 10.0, 5.0, nan, nan), (2, 10.0, 5.0, 7.0, -7.0)], "i int, lon double, lat double, depth_m_positive_down double, elev_m double")
    assert {r["i"]: (r["valid_depth_pos"], r["valid_core_fields"]) for r in P.check_track_points(direct).collect()} == {1: (False, False), 2: (True, True)}
    assert [r["qc_depth_positive"] for r in P.qc_survey_points(direct).orderBy("i").collect()] == [False, True]
    labels = {r["i"]: r["surface"] for r in P.split_land(raw).collect()}
    assert labels[1] == labels[2] == labels[4] == "missing"
    signs = spark.createDataFrame([("t", -5.0), ("t", nan)], "track_id string, depth_raw double")
    assert P.track_signs(signs).first()["depth_sign_raw"] == "mostly_negative"
    assert not P.clip_depth(raw, "depth_raw").where("i = 1").first()["was_clipped"]


def test_table_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        TB.require_columns(df, ["missing"])
    with pytest.raises(Exception, match="not unique"):
        TB.join_one_to_one(df, df.withColumnRenamed("v", "w"), ["k"]).collect()
    one = TB.join_one_to_one(df.limit(1), df.limit(1).withColumnRenamed("v", "w"), ["k"])
    assert one.count() == 1
    with pytest.raises(Exception, match="unexpected quality tier"):
        df.select(map_tier(F.col("v"))).collect()
    assert TB.flag_ids(df, df.where("v = 'a'"), "v", "hit").where("hit").count() == 1


def test_stable_sample_quota_and_backfill(spark):
    df = spark.createDataFrame([(f"c{i}", i < 5) for i in range(200)], "cell_id string, fill boolean")
    got = TB.stable_sample(df, "cell_id", 50, "role", "fill")
    assert got.count() == 50 and got.where("fill").count() == 5           # quota of 10, topped up with the others
    many = df.withColumn("fill", F.substring("cell_id", 2, 9).cast("int") < 100)
    assert TB.stable_sample(many, "cell_id", 50, "role", "fill").where("fill").count() == 10
    assert sorted(TB.stable_sample(many, "cell_id", 50, "role", "fill").collect()) == sorted(TB.stable_sample(many, "cell_id", 50, "role", "fill").collect())
