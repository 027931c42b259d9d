"""Table health and the run report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def side_by_side(*frames: DataFrame) -> DataFrame:
    """One-row frames as one row. A union and an aggregate over so many rows, no join."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns])


def health_score(judgments: DataFrame, scanned: int | DataFrame, count_non_errors: bool = False) -> DataFrame:
    """1 - (HIGH + half of MEDIUM and LOW) / rows scanned, clamped to [0, 1].

    Confirmed errors count; ``count_non_errors`` also counts dismissed ones, by confidence alone.
    """
    counted = F.lit(True) if count_non_errors else F.col("is_error")
    high = F.col("confidence") == "HIGH"
    counts = judgments.agg(F.count_if("is_error").alias("violation_count"),
                           F.count_if(counted & high).alias("critical_violation_count"),
                           F.count_if(counted & ~high).alias("warning_violation_count"))
    total = scanned.agg(F.count("*").alias("total_scanned")) if isinstance(scanned, DataFrame) \
        else judgments.sparkSession.range(1).select(F.lit(scanned).cast("long").alias("total_scanned"))
    weighted = F.col("critical_violation_count") * 1.0 + F.col("warning_violation_count") * 0.5
    score = F.when(F.col("total_scanned") > 0, F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), 1.0 - weighted / F.col("total_scanned")))).otherwise(1.0)
    return (side_by_side(counts, total).withColumn("score", score)
            .withColumn("status", F.when(F.col("score") >= 0.8, "healthy").when(F.col("score") >= 0.5, "warning")
                        .otherwise("critical"))
            .withColumn("health_score", F.round("score", 4)).drop("score"))


def report_summary(scanned: DataFrame, suspects: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row: rows scanned, suspects, errors, proposals, share of rows that needed judging, types."""
    rows = scanned.agg(F.count("*").alias("total_scanned"))
    types = suspects.groupBy("error_type").agg(F.count("*").alias("n"))  # four rows at most
    found = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_suspects"),
                      F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_type", "n"))))
                      .alias("error_type_distribution"))
    high = F.count_if(F.col("is_error") & (F.col("confidence") == "HIGH"))
    judged = judgments.agg(F.count_if("is_error").alias("total_errors"), high.alias("high_confidence_errors"),
                           high.alias("correction_proposals"))
    return (side_by_side(rows, found, judged)
            .withColumn("filtering_ratio", F.when(F.col("total_scanned") > 0, F.round(
                F.col("total_suspects") / F.col("total_scanned"), 6)).otherwise(0.0)))


def approval_queue(judgments: DataFrame) -> DataFrame:
    """Confirmed errors of HIGH confidence, waiting for a reviewer."""
    return judgments.filter(F.col("is_error") & (F.col("confidence") == "HIGH"))
