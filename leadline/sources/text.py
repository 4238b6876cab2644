"""Text sources: file listing, sounding lines, comma XYZ, tab-separated grid points, id lists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.groups import ranked
from ..operators.manifests import LAYOUT_6COL
from ..session import list_in_few_tasks

# Part files of one source lie in <root>/<top folder>/...; the whole relative path names a file unless
# the caller passes a pattern whose first group does.
DEFAULT_FILE_ID = r"([^/]+/[^/]+)$"


def scan_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file below a folder with size, extension and top folder; contents are not read."""
    list_in_few_tasks(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", F.col("length").alias("size_bytes"))
    return with_path_parts(files, path)


def with_path_parts(files: DataFrame, root: str) -> DataFrame:
    marker = root.rstrip("/").rsplit("/", 1)[-1] + "/"
    relative = F.substring_index(F.col("path"), marker, -1)
    name = F.substring_index(relative, "/", -1)
    dot = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.withColumns({"relative_path": relative, "filename": name, "ext": F.lower(dot),
                              "top_folder": F.substring_index(relative, "/", 1)})


def read_lines(spark: SparkSession, path: str, file_pattern: str = DEFAULT_FILE_ID) -> DataFrame:
    """Lines of a folder of text files with a 0-based line number per file id.

    Inside a split the reader's order is kept by an increasing id, and splits are ordered by path and
    offset.  Lines are counted per split, so numbering a huge file never needs one task for all of it.
    """
    list_in_few_tasks(spark)
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumns({"file_id": F.regexp_extract(F.url_decode("path"), file_pattern, 1),
                           "seq": F.monotonically_increasing_id()})
    return number_lines(raw)


def number_lines(raw: DataFrame) -> DataFrame:
    """0-based line numbers per file_id from path, block (the split's offset) and seq (rising inside a split)."""
    return ranked(raw, ["file_id"], [F.col("path"), F.col("block"), F.col("seq")], F.struct("path", "block"), "line_no").drop("seq")


def parse_soundings(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Whitespace-delimited sounding lines by the layout of their file.

    A line that does not parse keeps its place: its values are missing and `parse_ok` is false.
    """
    t = F.split(F.trim(F.col("value")), r"\s+")

    def token(i: str) -> Column:
        return F.try_element_at(t, F.col(i) + 1)

    def number(i: str) -> Column:
        return geo.nan_to_null(token(i).try_cast("double"))

    rows = lines.where(F.trim("value") != "").join(
        layouts.select("file_id", "data_layout", "lon_col", "lat_col", "depth_col", "date_col", "time_col", "sonar_idx_col"),
        "file_id")
    six = F.col("data_layout") == LAYOUT_6COL
    out = rows.withColumns({
        "lon_raw": number("lon_col"), "lat_raw": number("lat_col"), "depth_raw": number("depth_col"),
        "date_raw": F.when(six, token("date_col")), "time_raw": F.when(six, token("time_col")),
        "sonar_idx": F.when(six, number("sonar_idx_col").cast("bigint"))})
    ok = F.col("lon_raw").isNotNull() & F.col("lat_raw").isNotNull() & F.col("depth_raw").isNotNull()
    columns = ["lon_raw", "lat_raw", "depth_raw", "date_raw", "time_raw", "sonar_idx"]
    out = out.withColumn("parse_ok", ok).withColumns({c: F.when(F.col("parse_ok"), F.col(c)) for c in columns})
    return out.select("file_id", F.col("line_no").alias("point_index_in_file"), "data_layout", *columns, "parse_ok")


def read_soundings(spark: SparkSession, path: str, layouts: DataFrame, file_pattern: str = DEFAULT_FILE_ID) -> DataFrame:
    return parse_soundings(read_lines(spark, path, file_pattern), layouts)


def split_errors(rows: DataFrame, ok: str = "parse_ok") -> tuple[DataFrame, DataFrame]:
    """Good rows and the error table; bad input never stops a run."""
    return rows.where(F.col(ok)).drop(ok), rows.where(~F.col(ok)).drop(ok)


def read_xyz(spark: SparkSession, path: str, file_pattern: str = DEFAULT_FILE_ID) -> DataFrame:
    """`LON,LAT,CORR_DEPTH` lines, header optional.

    Text that is no number becomes missing, and rows without a finite position are dropped, which also
    drops a header row.
    """
    rows = spark.read.option("recursiveFileLookup", "true").schema("a string, b string, c string").csv(path, mode="PERMISSIVE")
    rows = rows.select("a", "b", "c", F.col("_metadata.file_path").alias("path"))

    def number(c: str) -> Column:
        return geo.nan_to_null(F.trim(F.col(c)).try_cast("double"))

    out = rows.select(F.regexp_extract(F.url_decode("path"), file_pattern, 1).alias("track_id"), number("a").alias("lon_raw"),
                      number("b").alias("lat_raw"), number("c").alias("depth_raw"))
    return out.where("lon_raw is not null and lat_raw is not null")


def read_tsv_points(spark: SparkSession, path: str, file_pattern: str = DEFAULT_FILE_ID) -> DataFrame:
    """Headerless tab-separated grid points: lon, lat, depth."""
    rows = spark.read.option("recursiveFileLookup", "true").option("sep", "\t").schema(
        "lon_raw double, lat_raw double, depth_raw double").csv(path, mode="PERMISSIVE")
    return rows.select(F.regexp_extract(F.url_decode("_metadata.file_path"), file_pattern, 1).alias("track_id"),
                       *[geo.nan_to_null(c).alias(c) for c in ("lon_raw", "lat_raw", "depth_raw")])


def load_id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id per line; blank lines and comments are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias(name))
    return lines.where((F.col(name) != "") & ~F.col(name).startswith("#")).distinct()
