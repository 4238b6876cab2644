"""The stages of both sources composed into jobs, from the adapter views to flags and products.

A stage that several later stages read is written to the shared folder once per run (the `_t` tables): it is
computed once, the plans behind it stay short, joins see its real size, and a lost executor repeats one stage.
A stage with a single reader stays part of that reader's plan.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cells as C
from ..operators import flags as FL
from ..operators import metrics as M
from ..operators import overlap as O
from ..operators import points as P
from ..operators import policy as Q
from ..operators import products as PR
from ..operators import raster as R
from ..operators.tables import union_all
from ..session import cut_lineage, file_versions, together
from .fixtures import GRID_CONFIG, TABLES, view
from .oracle_shared import ALWAYS_JUDGED, BY_OTHER_FILE

LISTED_EXCLUSIONS = [{"cruise": "C3", "reason": "extreme_cruise_bias"},
                     {"cruise_contains": "C5", "file_contains": "S5::15", "reason": "extreme_file_bias"}]


_RUNS: dict[tuple, "_Stages"] = {}


def forget_runs() -> None:
    """Drop the stage tables known so far, so that the next query computes everything again."""
    _RUNS.clear()


class _Stages:
    table = "lineitem"

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str):
        """The run of this application over one state of an input folder; its stage tables are written once.

        Files that are added, removed or rewritten make another state, so results never come from old stages.
        """
        key = (cls.__name__, spark.sparkContext.applicationId, sf_dir, file_versions(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]))
        if key not in _RUNS:
            _RUNS[key] = cls(spark, sf_dir)
        return _RUNS[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return cut_lineage(df, name)


class Survey(_Stages):
    """Source A: survey files."""

    @cached_property
    def points(self) -> DataFrame:
        return P.qc_survey_points(P.survey_points(view(self.spark, self.sf_dir, "soundings")))

    @cached_property
    def file_cells(self) -> DataFrame:
        return C.file_cells_a(self.points)

    @cached_property
    def file_cells_t(self) -> DataFrame:
        return self.file_cells                              # a stage by itself, as all grouped quantiles are

    @cached_property
    def cells(self) -> DataFrame:
        return C.merge_cells_a(self.file_cells_t)

    @cached_property
    def cells_t(self) -> DataFrame:
        return self.cells

    @cached_property
    def residuals(self) -> DataFrame:
        return O.residuals_a(self.file_cells_t, self.cells_t)

    def bias(self, key: str) -> DataFrame:
        return O.bias_by(self.residuals, key)

    @cached_property
    def three(self) -> DataFrame:
        return self.cut(O.residuals_three(self.file_cells_t, self.cells_t), "residuals_three")

    def audit(self, key: str) -> DataFrame:
        return O.audit_by(self.three, key)

    @cached_property
    def actions(self) -> DataFrame:
        columns = ["candidate_type", "candidate_id", "recommended_action", "action_reason"]
        parts = [O.recommend(self.audit(k), k, kind, BY_OTHER_FILE, ALWAYS_JUDGED).select(*columns) for k, kind in (("file_id", "file"), ("cruise_id", "cruise"))]
        return self.cut(union_all(parts), "actions")

    @cached_property
    def files(self) -> DataFrame:
        return self.file_cells_t.groupBy("file_id").agg(
            F.any_value("cruise_id").alias("cruise_id"), F.any_value("archive_id").alias("archive_id"),
            F.count(F.lit(1)).alias("n_file_cells"), F.sum("n_points").alias("n_points_total"))

    @cached_property
    def flags(self) -> DataFrame:
        return FL.file_flags(self.files, self.actions, LISTED_EXCLUSIONS)

    @cached_property
    def listed_flags(self) -> DataFrame:
        """Flags from the listed exclusions alone, for stages that only need the excluded files."""
        none = self.spark.createDataFrame([], "candidate_type string, candidate_id string, recommended_action string, action_reason string")
        return FL.file_flags(self.files, none, LISTED_EXCLUSIONS)

    @cached_property
    def filtered(self) -> DataFrame:
        return C.rebuild_without(self.file_cells_t, self.listed_flags)

    @cached_property
    def primary(self) -> DataFrame:
        return C.primary_validation_cells(self.filtered)

    @cached_property
    def primary_t(self) -> DataFrame:
        return self.cut(self.primary, "primary")

    @cached_property
    def sensitivity(self) -> DataFrame:
        return C.sensitivity_table(self.cells)

    @cached_property
    def comparison(self) -> DataFrame:
        return O.compare_cells(self.cells_t, self.filtered)


class Tracks(_Stages):
    """Source B: track soundings in three branches."""

    @cached_property
    def raw(self) -> DataFrame:
        return view(self.spark, self.sf_dir, "track_soundings")

    @cached_property
    def points(self) -> DataFrame:
        placed = self.raw.withColumns({"lon": geo.shift_lon("lon_raw"), "lat": geo.clean_lat("lat_raw")})
        return P.check_track_points(P.normalize_depth(placed, P.track_signs(self.raw)))

    @cached_property
    def file_cells(self) -> DataFrame:
        return C.file_cells_b(self.points)

    @cached_property
    def file_cells_t(self) -> DataFrame:
        return self.file_cells

    @cached_property
    def cells(self) -> DataFrame:
        return C.merge_cells_b(self.file_cells_t)

    @cached_property
    def cells_t(self) -> DataFrame:
        return self.cells

    @cached_property
    def residuals(self) -> DataFrame:
        return O.residuals_b(self.file_cells_t, self.cells_t)

    @cached_property
    def cross(self) -> DataFrame:
        return O.all_pairs(self.cells_t)

    @cached_property
    def cross_t(self) -> DataFrame:
        return self.cut(self.cross, "cross")

    @cached_property
    def branch_residuals(self) -> DataFrame:
        return O.branch_residuals(self.residuals, self.cells_t)

    @cached_property
    def pair_residuals(self) -> DataFrame:
        return O.pair_residuals(self.cross_t, self.cells_t)

    @cached_property
    def lat_depth(self) -> DataFrame:
        return Q.calib_lat_depth(self.cells_t, self.residuals, self.cross_t)

    @cached_property
    def source_pair(self) -> DataFrame:
        return Q.calib_source_pair(self.cross_t)

    @cached_property
    def sliced(self) -> DataFrame:
        cross = self.cross_t
        together(self.spark, lambda: self.lat_depth, lambda: self.source_pair)
        return Q.with_slices(Q.annotate_cross(self.cells_t, cross), self.lat_depth, self.source_pair)

    @cached_property
    def flagged(self) -> DataFrame:
        return Q.policy_sidecars(Q.apply_rules(self.sliced))

    @cached_property
    def flagged_t(self) -> DataFrame:
        return self.cut(self.flagged, "policy_flags")


class Products(_Stages):
    """Validation products of both sources, and their comparison with the grids."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.survey, self.tracks = Survey.of(spark, sf_dir), Tracks.of(spark, sf_dir)

    @cached_property
    def sources(self) -> list[DataFrame]:
        """The cells of both sources, which do not need each other."""
        return together(self.spark, lambda: self.survey.primary_t, lambda: self.tracks.flagged_t)

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return PR.build_products(*self.sources)

    @cached_property
    def tables_t(self) -> dict[str, DataFrame]:
        built = PR.build_products(*self.sources)
        return dict(zip(built, together(self.spark, *[lambda k=k, v=v: self.cut(v, f"product_{k}") for k, v in built.items()]), strict=True))

    @cached_property
    def catalog(self) -> DataFrame:
        return PR.build_catalog(self.tables)

    @cached_property
    def pixels(self) -> DataFrame:
        return view(self.spark, self.sf_dir, "pixels")

    @cached_property
    def grids(self) -> list[R.Product]:
        return R.load_products(GRID_CONFIG)

    def grid(self, name: str) -> R.Product:
        return R.load_products(GRID_CONFIG, name)[0]

    @cached_property
    def stores(self) -> dict[str, R.Store]:
        """Tiled products, written by the first stage that needs them."""
        return {}

    def store(self, name: str) -> R.Store:
        if name not in self.stores:
            self.stores[name] = R.stored(R.decode_pixels(self.pixels, self.grid(name)))
        return self.stores[name]

    @cached_property
    def survey_by_cell(self) -> DataFrame:
        """All configured grids at the survey cells, with the requested and total counts that coverage refers to."""
        together(self.spark, lambda: self.survey.primary_t, lambda: self.store("grid_a"))
        rows = R.whole(R.validate_products(self.survey.primary_t, self.pixels, self.grids, stores=self.stores))
        per_run = rows.groupBy("product_name", "sampling_method").agg(F.count(F.lit(1)).alias("requested_ship_cells"))
        return rows.join(per_run, ["product_name", "sampling_method"]).withColumn("total_primary_cells", F.col("requested_ship_cells"))

    @cached_property
    def survey_by_cell_t(self) -> DataFrame:
        return self.cut(self.survey_by_cell, "survey_by_cell")

    def validation_cells(self, product: str) -> DataFrame:
        return self.tables_t[product].withColumns({
            "ship_depth_m": F.col("representative_depth_m"), "ship_elev_m": -F.col("representative_depth_m"),
            "product_role": F.lit({"strict": "strict_primary_multibeam", "expanded": "expanded_primary_ship"}[product])})

    @cached_property
    def strict_run(self) -> tuple[DataFrame, DataFrame]:
        return R.validate_products(self.validation_cells("strict"), self.pixels, self.grids, sensitivity=False, stores=self.stores)

    @cached_property
    def expanded_run(self) -> tuple[DataFrame, DataFrame]:
        return R.validate_products(self.validation_cells("expanded"), self.pixels, self.grids, sensitivity=False, stores=self.stores)

    def whole(self, run: str) -> DataFrame:
        """The rows of a run in which no product failed; a failed run is forgotten, so that the next query tries it again."""
        try:
            return R.whole(getattr(self, run))
        except RuntimeError:
            self.__dict__.pop(run, None)
            raise

    @cached_property
    def strict_by_cell(self) -> DataFrame:
        return self.whole("strict_run")

    @cached_property
    def expanded_by_cell(self) -> DataFrame:
        return self.whole("expanded_run")

    @cached_property
    def strict_by_cell_t(self) -> DataFrame:
        return self.cut(self.strict_by_cell, "by_cell_strict")

    @cached_property
    def expanded_by_cell_t(self) -> DataFrame:
        return self.cut(self.expanded_by_cell, "by_cell_expanded")

    @cached_property
    def expanded_marked(self) -> DataFrame:
        return PR.with_membership(self.expanded_by_cell_t, self.tables_t["strict"])

    @cached_property
    def metrics(self) -> DataFrame:
        """Track strata of both primary products."""
        both = union_all([self.strict_by_cell_t, self.expanded_by_cell_t])
        return M.metrics_all_b(both)

    def keyed(self, *names: str) -> DataFrame:
        return union_all([self.tables_t[k].withColumn("product_key", F.lit(k)) for k in names])
