"""Group operators against brute force."""
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadline.operators import groups as G
from leadline.operators.overlap import TIE_PARTS, leave_out_medians
from leadline.operators.points import depth_jumps, mark_duplicates, with_point_index


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one value is repeated very often, one key is null."""
    rng = np.random.default_rng(7)
    keys = ["hot"] * 600 + ["b"] * 40 + ["c"] * 5 + [None] * 30 + ["one"]
    values = np.concatenate([np.full(200, 12.5), rng.normal(0, 900, 400).round(3), rng.normal(50, 5, 40).round(2),
                             [1.0, 2.0, 4.0, 10.0, -3.0], rng.random(30).round(4), [7.0]])
    rows = [(k, float(v)) for k, v in zip(keys, values)] + [("hot", None)] * 20
    return spark.createDataFrame(rows, "k string, v double"), pd.DataFrame(rows, columns=["k", "v"])


WANTED = {"p01": ("v", 0.01), "q25": ("v", 0.25), "med": ("v", 0.5), "p95": ("v", 0.95), "top": ("v", 1.0)}


@pytest.mark.parametrize("per_octave", [4096, 4, 1])
def test_quantiles_exact_whatever_the_slices(skewed, monkeypatch, per_octave):
    """Few slices force many values per slice, many slices one value each; ranks are the same."""
    monkeypatch.setattr(G, "SLICES_PER_OCTAVE", per_octave)
    df, pdf = skewed
    got = {r["k"]: r for r in G.quantile_agg(df, ["k"], [F.count("v").alias("n")], WANTED).collect()}
    for key, part in pdf.groupby("k", dropna=False):
        key = None if key is None or key != key else key
        v = part["v"].dropna()
        assert got[key]["n"] == len(v)
        for alias, (_, p) in WANTED.items():
            assert got[key][alias] == pytest.approx(v.quantile(p), abs=1e-9)
    assert len(got) == pdf["k"].nunique(dropna=False)


def test_quantiles_of_several_columns_and_empty_groups(spark):
    """A group of equal values with 90 % of the rows, a group without values, and two columns at once."""
    rows = [("flat", 3.25, float(k)) for k in range(900)] + [("none", None, None)] * 20 + [("few", float(k), None) for k in range(80)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    got = {r["k"]: r for r in G.quantile_agg(df, ["k"], [F.count(F.lit(1)).alias("n")], {"a1": ("a", 0.1), "a5": ("a", 0.5), "b5": ("b", 0.5)}).collect()}
    assert tuple(got["flat"]) == ("flat", 900, 3.25, 3.25, 449.5)
    assert tuple(got["none"]) == ("none", 20, None, None, None)
    assert tuple(got["few"]) == ("few", 80, pytest.approx(7.9), 39.5, None)
    assert G.quantile_agg(df.limit(0), ["k"], [], {"a5": ("a", 0.5)}).count() == 0


def test_no_job_runs_while_a_plan_is_built(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    base = G.quantile_agg(skewed[0], ["k"], [], {"med": ("v", 0.5)})
    G.with_mad(skewed[0], ["k"], base, {"mad": ("v", "med")})
    assert not tracker.getJobIdsForGroup("planning")


def test_mad_matches_pandas(skewed):
    df, pdf = skewed
    base = G.quantile_agg(df, ["k"], [], {"med": ("v", 0.5)})
    got = {r["k"]: r["mad"] for r in G.with_mad(df, ["k"], base, {"mad": ("v", "med")}).collect()}
    for key, part in pdf.groupby("k"):
        v = part["v"].dropna()
        assert got[key] == pytest.approx((v - v.median()).abs().median())


def test_point_index_is_dense_and_ordered(spark):
    rows = [("f%d" % (i % 3 == 0), i * 7 % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "f string, o int")
    got = with_point_index(df, "f", [F.col("o")], F.floor(F.col("o") / 10)).collect()
    for f in {r["f"] for r in got}:
        own = sorted((r["o"], r["point_index"]) for r in got if r["f"] == f)
        assert [i for _, i in own] == list(range(len(own)))


@pytest.mark.parametrize("stretch", [7, 1000])
def test_depth_jumps_across_stretches(spark, stretch):
    rng = random.Random(3)
    depths = [rng.choice([0.0, 900.0, 1001.0, 2500.0, None]) for _ in range(200)]
    rows = [("a", i, d) for i, d in enumerate(depths)] + [("b", 0, 5.0)]
    df = spark.createDataFrame(rows, "track_id string, point_index bigint, d double")
    want = sum(1 for x, y in zip(depths, depths[1:]) if x is not None and y is not None and abs(x - y) > 1000)
    got = dict(depth_jumps(df, depth="d", stretch=stretch).collect())
    assert got == {"a": want, "b": 0}


def test_first_of_many_copies(spark):
    rows = [("t", i, 1.0, None if i % 2 else 2.0) for i in range(50)]
    df = spark.createDataFrame(rows, "track_id string, i bigint, lon double, d double")
    got = mark_duplicates(df, ["track_id", "lon", "d"], ["track_id", "i"]).where("is_first").select("i").collect()
    assert sorted(r["i"] for r in got) == [0, 1]


@pytest.mark.parametrize("per_octave", [4096, 1])
def test_leave_out_median_against_brute_force(spark, monkeypatch, per_octave):
    monkeypatch.setattr(G, "SLICES_PER_OCTAVE", per_octave)
    rng = random.Random(11)
    rows = []
    for cell in range(4):
        for f in range([1, 2, 9, 40][cell]):
            rows.append((cell, 0, f"f{f}", f"c{rng.randrange(4)}" if cell else "c0", float(rng.choice([10, 10, 25, 99, 1000, -5]))))
    pdf = pd.DataFrame(rows, columns=["lat_bin", "lon_bin", "file_id", "cruise_id", "v"])
    df = spark.createDataFrame(rows, "lat_bin bigint, lon_bin bigint, file_id string, cruise_id string, v double")
    made = leave_out_medians(df, {"cruise_id": "m", "file_id": "m"}, "v")
    for group in ("cruise_id", "file_id"):
        want = {}
        for (cell, g), _ in pdf.groupby(["lat_bin", group]):
            others = pdf[(pdf.lat_bin == cell) & (pdf[group] != g)]["v"]
            if len(others):
                want[(cell, g)] = float(np.median(others))
        got = made[group].collect()
        assert {(r["lat_bin"], r[group]): r["m"] for r in got} == want


def test_head_per_group_with_salts(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(500)], "g int, v int")
    got = G.head_per_group(df, ["g"], [F.col("v").desc()], 3).collect()
    assert sorted(map(tuple, got)) == [(0, 494), (0, 496), (0, 498), (1, 495), (1, 497), (1, 499)]


def test_a_flat_cell_is_ranked_in_parts(spark):
    rows = [(0, 0, f"f{k}", f"c{k % 3}", 100.0) for k in range(3000)] + [(0, 0, "g", "c9", 7.0)]
    df = spark.createDataFrame(rows, "lat_bin bigint, lon_bin bigint, file_id string, cruise_id string, v double")
    parts = F.struct("v", F.pmod(F.xxhash64("file_id"), F.lit(TIE_PARTS)))
    sizes = [r["count"] for r in df.groupBy(parts).count().collect()]
    assert max(sizes) < 2 * 3000 / TIE_PARTS
    out = G.ranked(df, ["lat_bin", "lon_bin"], [parts, F.col("file_id")], G.value_slice(F.col("v")), "r", total="n", part_by=parts).collect()
    assert sorted(r["r"] for r in out) == list(range(3001)) and {r["n"] for r in out} == {3001}
    assert [r["file_id"] for r in out if r["r"] == 0] == ["g"]
    assert {r["m"] for r in leave_out_medians(df, {"file_id": "m"}, "v")["file_id"].collect()} == {100.0}


@pytest.mark.parametrize("run", [4096, 64, 4])
def test_quantiles_and_deviations_of_runs_and_slices(spark, monkeypatch, run):
    monkeypatch.setattr(G, "RUN", run)
    rng, rows = random.Random(2), []
    for key, n in {None: 7, "a": 1, "b": 2, "c": 400, "d": 50, "e": 900}.items():
        rows += [(key, None if key == "a" else rng.choice([rng.gauss(0, 100), float(rng.randint(-3, 3)), None, float("nan")])) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = G.digest_agg(df, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("v", 0.5), "p90": ("v", 0.9), "a95": ("av", 0.95)}, mads={"mad": "v"}, absolute={"av": "v"}).collect()
    assert len(got) == 6
    for r in got:
        x = np.array([v for k, v in rows if k == r["k"] and v is not None and v == v])
        want = (np.median(x), np.quantile(x, 0.9), np.quantile(abs(x), 0.95), np.median(abs(x - np.median(x)))) if len(x) else (None,) * 4
        assert r["n"] == sum(k == r["k"] for k, _ in rows) and (r["m"], r["p90"], r["a95"], r["mad"]) == (pytest.approx(want) if len(x) else want)


@pytest.mark.parametrize("run", [4096, 64, 4])
def test_large_groups_never_build_runs(spark, monkeypatch, run):
    monkeypatch.setattr(G, "RUN", run)
    built, plain = [], G.F.histogram_numeric
    stages, cut = {}, G.cut_lineage

    def kept(df, name):
        out = cut(df, name)
        stages.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(G, "cut_lineage", kept)
    monkeypatch.setattr(G.F, "histogram_numeric", lambda c, n: (built.append(n), plain(c, n))[1])
    rng, rows = random.Random(3), []
    for key, n in {None: 600, "a": 3, "b": 900, "c": 40, "d": 700}.items():
        rows += [(key, None if key == "d" else rng.choice([rng.gauss(0, 100), float(rng.randint(-3, 3)), None, float("nan")]), float(rng.randint(0, 5))) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    got = G.digest_agg(df, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("v", 0.5), "p90": ("v", 0.9), "a95": ("av", 0.95), "w9": ("w", 0.9)},
                       mads={"mad": "v", "wmad": "w"}, absolute={"av": "v"}, coarse=True).collect()
    assert len(got) == 5
    for r in got:
        x = np.array([v for k, v, _ in rows if k == r["k"] and v is not None and v == v])
        w = np.array([w for k, _, w in rows if k == r["k"]])
        want = (np.median(x), np.quantile(x, 0.9), np.quantile(abs(x), 0.95), np.median(abs(x - np.median(x)))) if len(x) else (None,) * 4
        assert r["n"] == len(w) and (r["w9"], r["wmad"]) == pytest.approx((np.quantile(w, 0.9), np.median(abs(w - np.median(w)))))
        assert (r["m"], r["p90"], r["a95"], r["mad"]) == (pytest.approx(want) if len(x) else want)
    # the run of a large group is never read or refused: only small groups reach it
    assert "rows-of-full-runs" not in stages and ("rows-of-large-groups" in stages) == (run < 900)
    if run < 900:
        assert {r["k"] for r in stages["rows-of-large-groups"][0].select("k").distinct().collect()} == ({None, "b", "d"} if run == 64 else {None, "b", "c", "d"})
    assert bool(built)


def test_quantiles_take_one_exchange(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(G, "cut_lineage", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df)[1])
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, v double")
    out = G.digest_agg(df, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("v", 0.5), "a9": ("av", 0.9)}, mads={"mad": "v"}, absolute={"av": "v"})
    assert {r["k"]: r["m"] for r in out.collect()} == {"a": 1.5, "b": 5.0}
    assert len(plans) == 1 and plans[0].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("run", [4096, 64, 4])
def test_sorted_groups_with_distinct_counts(spark, monkeypatch, run):
    """Quantiles and distinct counts of small and sliced groups, with missing keys, values and names."""
    monkeypatch.setattr(G, "ORDERED", run)
    monkeypatch.setattr(G, "BUCKETS", 2)
    rng, rows = random.Random(5), []
    for key, n in {None: 70, "a": 1, "b": 2, "c": 400, "d": 50}.items():
        rows += [(key, None if key == "a" else rng.choice([rng.gauss(0, 100), float(rng.randint(-3, 3)), None, float("nan")]), rng.choice(["x", "y", None]), f"f{rng.randint(0, 40)}")
                 for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double, s string, f string").repartition(5)
    got = G.sorted_agg(df, ["k"], [F.count(F.lit(1)).alias("n")], {"m": ("v", 0.5), "p9": ("v", 0.9)}, distinct={"ns": "s", "nf": "f"}).collect()
    assert len(got) == 5
    for r in got:
        own = [q for q in rows if q[0] == r["k"]]
        x = np.array([q[1] for q in own if q[1] is not None and q[1] == q[1]])
        want = (np.median(x), np.quantile(x, 0.9)) if len(x) else (None, None)
        assert (r["n"], r["ns"], r["nf"]) == (len(own), len({q[2] for q in own} - {None}), len({q[3] for q in own}))
        assert (r["m"], r["p9"]) == (pytest.approx(want) if len(x) else want)


def test_cells_are_merged_without_copies_of_rows(spark, monkeypatch):
    """Distinct counts of files, cruises and archives multiply no rows, and file-cells are exchanged once."""
    from leadline.operators import cells as C
    plans, cut = {}, G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), cut(df, name))[1])
    rows = [("f1", "c1", "z1", 10.0, 5, 7), ("f2", "c1", "z1", 30.0, 5, 7), ("f3", "c2", "z1", 20.0, 5, 7)]
    fc = spark.createDataFrame(rows, "file_id string, cruise_id string, archive_id string, median_depth_m_positive_down double, lat_bin long, lon_bin long").withColumns({
        "n_points": F.lit(4).cast("bigint"), "mean_depth_m_positive_down": F.lit(20.0),
        "min_depth_m": F.lit(1.0), "max_depth_m": F.lit(90.0), "data_layout": F.lit("lon_lat_depth_3col"), "track_kind": F.lit("transit")})
    r = C.merge_cells_a(fc).collect()[0]
    assert (r["n_files"], r["n_cruises_guess"], r["n_archives"], r["median_depth_file_balanced"], r["q25_depth_between_file_cells"]) == (3, 2, 1, 20.0, 15.0)
    assert "Expand" not in plans["groups"] and plans["groups"].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("copies", [64, 2])
def test_track_cells_with_many_copies(spark, monkeypatch, copies):
    from leadline.operators import cells as C
    monkeypatch.setattr(C, "COPIES", copies)
    rng = random.Random(4)
    rows = []
    for track in range(3):
        for k in range(30):
            point = (170.001 + 0.0001 * (k % 5), -20.001, float(rng.choice([100, 200, 250, 900])))
            rows += [("singlebeam", f"t{track}", *point, True)] * rng.choice([1, 1, 2, 7])
    columns = ["source_type", "source_completeness", "instrument_class_pred", "manual_review_flag"]
    df = spark.createDataFrame(rows, "branch string, track_id string, lon double, lat double, depth_m_positive_down double, point_check_pass_basic boolean")
    df = df.withColumns({c: F.lit(c) for c in columns}).repartition(3)
    got = {r["track_id"]: r for r in C.file_cells_b(df).collect()}
    for track in range(3):
        own = [r for r in rows if r[1] == f"t{track}"]
        d, u = [r[4] for r in own], [r[4] for r in set(own)]
        r = got[f"t{track}"]
        assert (r["n_points_pass"], r["n_unique_triples"]) == (len(d), len(u)) and r["mean_depth_m"] == pytest.approx(np.mean(d))
        assert r["std_depth_m"] == pytest.approx(np.std(d, ddof=1)) and r["median_depth_m"] == np.median(d) and r["median_depth_m_unique_triples"] == np.median(u)
        assert r["iqr_depth_m"] == pytest.approx(np.quantile(d, 0.75) - np.quantile(d, 0.25))
