"""Sounding-shaped views of the given tables, as select lists that Spark SQL and the oracle share."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import geo

# every column of lineitem: the full row orders the points of a file
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount",
              "l_tax", "l_returnflag", "l_linestatus"]

# the cells 20 degrees north belong to cruise C3 alone, those 30 degrees north to C3, which is 700 m off, and C4
SOUNDINGS = """
SELECT *, concat('S', l_suppkey % 10, '::', l_suppkey) AS file_id,
       concat('C', l_suppkey % 10) AS cruise_id, concat('Z', l_suppkey % 25) AS archive_id,
       CASE WHEN l_suppkey % 6 = 0 THEN 'transit' ELSE 'unknown_or_survey' END AS track_kind,
       CASE WHEN l_suppkey % 4 = 0 THEN 'date_time_sonar_lon_lat_depth_6col' ELSE 'lon_lat_depth_3col' END AS data_layout,
       CASE WHEN l_suppkey % 4 = 0 THEN l_linestatus END AS date_raw,
       CASE WHEN l_suppkey % 4 = 0 AND l_linenumber > 2 THEN l_returnflag END AS time_raw,
       CASE WHEN l_suppkey % 4 = 0 THEN CAST(l_linenumber AS BIGINT) END AS sonar_idx,
       140 + (l_partkey % 40) / 200e0 + CASE WHEN l_suppkey % 5 = 0 THEN 360 ELSE 0 END AS lon_raw,
       CASE WHEN l_orderkey % 113 = 0 THEN 95e0 WHEN l_orderkey % 131 = 0 THEN CAST('NaN' AS DOUBLE) ELSE 30 + floor(l_partkey / 40e0) / 200e0
         + CASE WHEN l_orderkey % 89 = 0 AND l_suppkey % 10 = 3 THEN 20 WHEN l_orderkey % 83 = 0 AND l_suppkey % 10 IN (3, 4) THEN 30 ELSE 0 END END AS lat_raw,
       CASE WHEN l_orderkey % 109 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN CAST('NaN' AS DOUBLE) END
            WHEN l_orderkey % 107 = 0 THEN 12000e0 + l_quantity
            WHEN l_orderkey % 103 = 0 THEN -l_extendedprice / 10e0
            WHEN l_orderkey % 101 = 0 THEN 0e0
            ELSE 1000e0 + 5 * (l_partkey % 40) + 1500 * (CAST(floor(l_partkey / 400e0) AS BIGINT) % 5)
                 + floor(l_extendedprice / 1000e0)
                 + CASE l_suppkey % 10 WHEN 3 THEN 700 WHEN 5 THEN 120 WHEN 7 THEN (l_linenumber - 4) * 150 ELSE 0 END
       END AS depth_raw
FROM {lineitem}
"""

TRACK_SOUNDINGS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, branch, trk,
       concat(CASE branch WHEN 'singlebeam' THEN 'sb' WHEN 'multibeam' THEN 'mb' ELSE 'rg' END, '_', trk) AS track_id,
       CASE branch WHEN 'regional' THEN 'regional' WHEN 'multibeam' THEN 'xyz'
            ELSE CASE WHEN trk % 2 = 0 THEN 'decoded' ELSE 'xyz' END END AS source_type,
       CASE WHEN branch = 'regional' THEN 'regional' WHEN branch = 'multibeam' THEN 'xyz_only'
            WHEN trk % 3 = 0 THEN 'nc_xyz_intersect' WHEN trk % 2 = 0 THEN 'nc_only' ELSE 'xyz_only' END AS source_completeness,
       CASE WHEN branch = 'singlebeam' THEN 'singlebeam' ELSE 'multibeam' END AS instrument_class_pred,
       trk % 9 = 0 AS manual_review_flag, l_shipdate AS time,
       -150 + (l_partkey % 40) / 400e0 + CASE WHEN l_suppkey % 5 = 0 THEN 360 ELSE 0 END AS lon_raw,
       CASE WHEN l_orderkey % 113 = 0 THEN 95e0
            ELSE CASE l_partkey % 3 WHEN 0 THEN -25 WHEN 1 THEN -60 ELSE 65 END + floor(l_partkey / 40e0) / 400e0 END AS lat_raw,
       CASE WHEN trk % 4 = 1 THEN -1 ELSE 1 END * CASE WHEN l_orderkey % 103 = 0 THEN -1 ELSE 1 END
         * CASE WHEN l_orderkey % 109 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN CAST('NaN' AS DOUBLE) END WHEN l_orderkey % 107 = 0 THEN 11600e0 + l_quantity
                WHEN l_orderkey % 101 = 0 THEN 0e0 ELSE
           CASE stage WHEN 0 THEN 120e0 WHEN 1 THEN 350 WHEN 2 THEN 1200 WHEN 3 THEN 3000 WHEN 4 THEN 5000 ELSE 8000 END
           + CASE WHEN branch = 'multibeam' AND trk = 4 THEN 0 ELSE floor(l_extendedprice / 4000e0) * 10 END
           + CASE branch WHEN 'regional' THEN 40 WHEN 'singlebeam' THEN 25 * (trk % 7) ELSE 0 END END AS depth_raw
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'singlebeam' WHEN 'N' THEN 'multibeam' ELSE 'regional' END AS branch,
             CAST(floor(l_partkey / 400e0) AS BIGINT) % 6 AS stage,
             CASE WHEN l_returnflag = 'N' AND CAST(floor(l_partkey / 400e0) AS BIGINT) % 6 = 2 THEN 99
                  WHEN l_returnflag = 'N' AND CAST(floor(l_partkey / 400e0) AS BIGINT) % 6 = 0 THEN 4
                  ELSE l_suppkey % 21 END AS trk
      FROM {lineitem}) AS l
"""

TRACKS = """
SELECT concat('t', user_id) AS track_id,
       CASE user_id % 3 WHEN 0 THEN 'decoded' WHEN 1 THEN 'xyz' ELSE 'regional' END AS source_type,
       event_id, user_id, ts AS time,
       170 + (user_id % 30) + (event_id % 100) / 1000e0 AS lon_raw,
       -20 + floor(user_id / 30e0) + (event_id % 77) / 1000e0 AS lat_raw,
       CASE WHEN user_id % 7 = 0 THEN -1 ELSE 1 END * floor(value * 25e0) AS depth_raw,
       CASE WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN value END AS gobs,
       CAST(NULL AS DOUBLE) AS faa
FROM {events}
"""

# two submissions of one track: every event belongs to the decoded side, two in three also to the xyz side
TRACK_PAIRS = """
SELECT track_id, source_type, lon_raw, lat_raw, depth_raw FROM (
  SELECT concat('p', user_id) AS track_id, 'decoded' AS source_type,
         170 + (user_id % 30) + (event_id % 100) / 1000e0 AS lon_raw,
         -20 + floor(user_id / 30e0) + (event_id % 77) / 1000e0 AS lat_raw, floor(value * 25e0) AS depth_raw
  FROM {events}
  UNION ALL
  SELECT concat('p', user_id), 'xyz',
         170 + (user_id % 30) + (event_id % 100) / 1000e0 + CASE WHEN user_id % 5 = 0 THEN 0.08e0 ELSE 0e0 END,
         -20 + floor(user_id / 30e0) + (event_id % 77) / 1000e0,
         floor(value * CASE WHEN user_id % 4 = 0 THEN 60e0 ELSE 24e0 END)
  FROM {events} WHERE event_id % 3 > 0 OR user_id % 6 = 0) AS u
"""

GRID_POINTS = """
SELECT concat('q', o_custkey % 4) AS track_id, o_orderkey, 179.9 + (o_orderkey % 50) / 250e0 AS lon_raw,
       -10 + (o_custkey % 100) / 100e0 AS lat_raw,
       CASE WHEN o_orderkey % 97 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST('NaN' AS DOUBLE) END WHEN o_orderkey % 41 = 0 THEN -99999e0
            ELSE 2000e0 - floor(o_totalprice / 25e0) END AS depth_raw
FROM {orders}
"""

# whitespace-delimited lines of survey files: three or six columns, some lines that do not parse
SOUNDING_LINES = """
SELECT *, CASE WHEN bad THEN CASE WHEN six THEN 'x y z u v w' ELSE 'x y z' END
  WHEN six THEN concat('20120614 ', 120000 + l_linenumber, ' ', l_linenumber, ' ', lon_d, ' ', lat_d, '  ', depth_d)
  ELSE concat(' ', lon_d, ' ', lat_d, '  ', depth_d) END AS line FROM (
  SELECT *, l_suppkey AS src, l_suppkey % 4 = 1 AS six, l_orderkey % 127 = 0 AS bad,
    CAST(140 + (l_partkey % 40) / 200e0 + CASE WHEN l_suppkey % 5 = 0 THEN 50 ELSE 0 END AS DECIMAL(12, 3)) AS lon_d,
    CAST(30 + floor(l_partkey / 40e0) / 200e0 + CASE WHEN l_suppkey % 13 = 0 THEN 70 ELSE 0 END AS DECIMAL(12, 3)) AS lat_d,
    CAST(floor(l_extendedprice / 10e0) * CASE WHEN l_suppkey % 8 = 0 THEN -1 ELSE 1 END
         + CASE WHEN l_suppkey % 17 = 0 THEN 9000 ELSE 0 END AS DECIMAL(12, 1)) AS depth_d
  FROM {lineitem}) AS l
"""

# comma-separated lines with header rows, text in place of numbers and missing positions
XYZ_LINES = """
SELECT concat('t', user_id % 20) AS src, event_id, floor(value * 25e0) AS depth_v, user_id,
  CASE WHEN event_id % 50 = 0 THEN 'LON,LAT,CORR_DEPTH'
       ELSE concat(CASE WHEN event_id % 37 = 0 THEN '' ELSE CAST(CAST(170 + user_id / 100e0 AS DECIMAL(12, 3)) AS {string}) END, ',',
                   CAST(CAST(-20 + event_id / 1000e0 AS DECIMAL(12, 3)) AS {string}), ', ',
                   CASE WHEN event_id % 31 = 0 THEN 'abc' ELSE CAST(CAST(floor(value * 25e0) AS DECIMAL(12, 1)) AS {string}) END) END AS line
FROM {events}
"""

FILES = """
SELECT concat('Z', l_suppkey % 25, '::f', l_suppkey) AS file_id, concat('Z', l_suppkey % 25) AS archive_id,
       concat('C', l_suppkey % 10) AS cruise_id,
       concat(CASE l_suppkey % 12 WHEN 0 THEN 'grid_' WHEN 1 THEN 'track_' WHEN 2 THEN 'T2012061' ELSE 'mb_' END,
              CASE WHEN l_suppkey % 12 = 2 THEN l_suppkey % 10 ELSE l_suppkey % 30 END,
              CASE l_suppkey % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' ELSE '.dat' END) AS filename,
       l_suppkey, 140 + (l_partkey % 40) / 200e0 + CASE WHEN l_suppkey % 5 = 0 THEN 50 ELSE 0 END AS lon,
       30 + floor(l_partkey / 40e0) / 200e0 + CASE WHEN l_suppkey % 13 = 0 THEN 70 ELSE 0 END AS lat,
       CASE WHEN l_suppkey % 8 = 0 THEN -1 ELSE 1 END * l_extendedprice / 10e0 AS depth
FROM {lineitem}
"""

# four regular grids: rising and falling axes, both longitude conventions, both depth signs, a fill value
PIXELS = """
SELECT product_name, row_idx, col_idx, lat, lon, z_raw FROM (
  SELECT 'grid_a' AS product_name, r AS row_idx, c AS col_idx, 30 + r / 200e0 AS lat, 140 + c / 200e0 AS lon,
         CASE WHEN k % 53 = 0 THEN -99999e0
              ELSE -(1010e0 + 5 * c + 1500 * (CAST(floor(r / 10e0) AS BIGINT) % 5) + floor(p_retailprice / 20e0)) END AS z_raw
  FROM {grid}
  UNION ALL
  SELECT 'grid_mid', r, c, -25 + r / 400e0, -150 + c / 400e0,
         CASE CAST(floor(r / 10e0) AS BIGINT) % 6 WHEN 0 THEN 120e0 WHEN 1 THEN 350 WHEN 2 THEN 1200 WHEN 3 THEN 3000
              WHEN 4 THEN 5000 ELSE 8000 END + floor(p_retailprice / 20e0)
  FROM {grid}
  UNION ALL
  SELECT 'grid_south', r, c, -60 + r / 400e0, 210 + c / 400e0,
         CASE WHEN k % 59 = 0 THEN -99999e0 ELSE -(500e0 + floor(p_retailprice)) END
  FROM {grid}
  UNION ALL
  SELECT 'grid_north', last_row - r, c, 65 + r / 400e0, -150 + c / 400e0, -(900e0 + floor(p_retailprice / 2))
  FROM {grid}) AS u
"""
# parts laid out in rows of 40
GRID = """(SELECT p_retailprice, p_partkey - 1 AS k, CAST(floor((p_partkey - 1) / 40e0) AS BIGINT) AS r, (p_partkey - 1) % 40 AS c,
   (SELECT CAST(floor((max(p_partkey) - 1) / 40e0) AS BIGINT) FROM {part}) AS last_row FROM {part}) AS g"""

GRID_CONFIG = [
    {"name": "grid_a", "sampling_method": "cell_median", "z_convention": "elevation_negative_ocean",
     "lon_convention": "-180_180", "fill_value": -99999.0,
     "footprint": {"lon_min": 139.9, "lon_max": 140.3, "lat_min": 29.9, "lat_max": 89.0}},
    {"name": "grid_mid", "sampling_method": "center_bilinear", "z_convention": "depth_positive_down",
     "lon_convention": "-180_180",
     "footprint": {"lon_min": -150.1, "lon_max": -149.8, "lat_min": -26.0, "lat_max": 29.0}},
    {"name": "grid_south", "sampling_method": "cell_mean", "z_convention": "elevation_negative_ocean",
     "lon_convention": "0_360", "fill_value": -99999.0,
     "footprint": {"lon_min": -150.1, "lon_max": -149.8, "lat_min": -61.0, "lat_max": -26.0}},
    {"name": "grid_north", "sampling_method": "center_nearest", "z_convention": "elevation_negative_ocean",
     "lon_convention": "-180_180",
     "footprint": {"lon_min": -150.1, "lon_max": -149.8, "lat_min": 64.0, "lat_max": 89.9}},
    {"name": "grid_missing", "sampling_method": "center_nearest", "z_convention": "elevation_negative_ocean",
     "lon_convention": "-180_180"},
    {"name": "grid_off", "sampling_method": "center_nearest", "z_convention": "elevation_negative_ocean",
     "lon_convention": "-180_180", "enabled": False},
]

# columns that hold NaN as well as missing values
WITH_NAN = {"soundings": ["lat_raw", "depth_raw"], "track_soundings": ["depth_raw"], "grid_points": ["depth_raw"]}
TABLES = ["lineitem", "events", "orders", "part", "supplier"]
VIEWS = {"soundings": SOUNDINGS, "track_soundings": TRACK_SOUNDINGS, "tracks": TRACKS, "track_pairs": TRACK_PAIRS,
         "grid_points": GRID_POINTS, "files_raw": FILES, "sounding_lines": SOUNDING_LINES, "xyz_lines": XYZ_LINES, "pixels": PIXELS}


def _with_tables(sql: str, tables: dict[str, str], string: str = "STRING") -> str:
    return sql.replace("{grid}", GRID).format(string=string, **tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter view over the Parquet tables, NaN read as missing; only the columns a query uses are read."""
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    rows = spark.sql(_with_tables(VIEWS[name], paths))
    return rows.withColumns({c: geo.nan_to_null(c) for c in WITH_NAN.get(name, ())})


def oracle_views() -> dict[str, str]:
    def cleaned(name: str, sql: str) -> str:
        columns = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in WITH_NAN.get(name, ()))
        return f"SELECT * REPLACE ({columns}) FROM ({sql}) AS raw" if columns else sql
    return {name: cleaned(name, _with_tables(sql, {t: t for t in TABLES}, "VARCHAR")) for name, sql in VIEWS.items()}

