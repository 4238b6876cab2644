"""File quality flags: only upgrades, keep < high_variance_review < review < exclude."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import missing_ids, union_all

# Priority of each flag.
FLAG_PRIORITY = {"keep": 0, "high_variance_review": 1, "review": 2, "exclude": 3}
ACTION_FLAGS = {"review_candidate": ("review", "review_candidate_overlap_bias"),
                "high_variance_review": ("high_variance_review", "high_variance_overlap_scatter")}


def file_flags(files: DataFrame, actions: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """One flag per file: the highest priority wins, and the first listed wins among equals.

    rules: dicts with `reason` and either `cruise` or `cruise_contains` + `file_contains`; each excludes.
    """
    proposals = []
    if rules:
        found = []
        for seq, r in enumerate(rules):
            if "cruise" in r:
                cond, source = F.col("cruise_id") == r["cruise"], f"listed_cruise:{r['cruise']}"
            else:
                cond = F.col("cruise_id").contains(r["cruise_contains"]) & F.col("file_id").contains(r["file_contains"])
                source = f"listed_file:{r['reason']}"
            found.append(F.when(cond, _proposal("exclude", r["reason"], F.lit(source), seq)))
        proposals.append(files.select("file_id", F.explode(F.array_compact(F.array(*found))).alias("p")))
    for kind, key, seq in (("file", "file_id", 0), ("cruise", "cruise_id", 1)):
        acts = actions.where(F.col("candidate_type") == kind).select(F.col("candidate_id").alias(key), "recommended_action")
        hit = files.select("file_id", *([] if key == "file_id" else [key])).join(acts, key)
        source = F.concat(F.lit(f"overlap_{kind}:"), F.col(key))
        for action, (flag, reason) in ACTION_FLAGS.items():
            proposals.append(hit.where(F.col("recommended_action") == action)
                             .select("file_id", _proposal(flag, reason, source, seq).alias("p")))
    best = union_all(proposals).groupBy("file_id").agg(
        F.min_by("p", F.struct(-F.col("p.priority"), F.col("p.seq"))).alias("p"))

    def own(kind: str, key: str, suffix: str) -> DataFrame:
        return actions.where(F.col("candidate_type") == kind).select(
            F.col("candidate_id").alias(key), F.col("recommended_action").alias(f"__a{suffix}"),
            F.col("action_reason").alias(f"__r{suffix}"))

    out = (files.join(best, "file_id", "left").join(own("file", "file_id", "1"), "file_id", "left")
           .join(own("cruise", "cruise_id", "2"), "cruise_id", "left"))
    return out.withColumns({
        "quality_flag": F.coalesce("p.flag", F.lit("keep")),
        "exclude_from_primary_cells": F.coalesce(F.col("p.flag") == "exclude", F.lit(False)),
        "flag_reason": F.coalesce("p.reason", F.lit("")), "flag_source": F.coalesce("p.source", F.lit("")),
        "recommended_action": F.coalesce("__a1", "__a2"),
        "action_reason": F.when(F.col("__a1").isNotNull(), F.col("__r1")).otherwise(F.col("__r2"))}).drop(
            "p", "__a1", "__r1", "__a2", "__r2")


def _proposal(flag: str, reason: str, source, seq: int):
    return F.struct(F.lit(flag).alias("flag"), F.lit(reason).alias("reason"), source.alias("source"),
                    F.lit(FLAG_PRIORITY[flag]).alias("priority"), F.lit(seq).alias("seq"))


def action_errors(flags: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions that match no file, unknown candidate types, repeated files and missing flags."""
    def row(df: DataFrame, error: str, kind, ident) -> DataFrame:
        return df.select(F.lit(error).alias("error_type"), kind.alias("candidate_type"), ident.alias("candidate_id"))

    parts = []
    for kind, key in (("file", "file_id"), ("cruise", "cruise_id")):
        ids = actions.where(F.col("candidate_type") == kind).select(F.col("candidate_id").alias(key))
        parts.append(row(missing_ids(ids, flags, key), f"unmatched_{kind}", F.lit(kind), F.col(key)))
    unknown = actions.where(~F.col("candidate_type").isin("file", "cruise"))
    parts.append(row(unknown, "unknown_candidate_type", F.col("candidate_type"), F.col("candidate_id")))
    repeated = flags.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts.append(row(repeated, "duplicate_file_id", F.lit("N/A"), F.col("file_id")))
    parts.append(row(flags.where(F.col("quality_flag").isNull()), "missing_quality_flag", F.lit("N/A"), F.col("file_id")))
    return union_all(parts)
