"""Lineage: how far a violation reaches, and where it may come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise

# Weight of a severity; a missing one counts as warning, an unknown one as 1.
SEVERITY_WEIGHTS = {"critical": 10.0, "warning": 5.0, "info": 1.0}


def lookup(df: DataFrame, lineage: DataFrame) -> DataFrame:
    """Left join on table_name with defaults for tables that have no lineage.

    Lineage has one row per table of the catalog. It is written and read back, so that Spark knows its size and broadcasts it while it
    is small: a shuffle would lay all rows of a table in one task.
    """
    known = materialise(lineage.withColumn("_known", F.lit(True)), "lineage")
    return (df.join(known, "table_name", "left")
            .withColumns({
                "lineage_status": F.when(F.col("_known"), "success").otherwise("not_found"),
                "upstream_tables": F.coalesce("upstream_tables", F.array().cast("array<string>")),
                "downstream_tables": F.coalesce("downstream_tables", F.array().cast("array<string>")),
                "query_volume_7d": F.coalesce("query_volume_7d", F.lit(0)),
                "certification_status": F.coalesce("certification_status", F.lit("uncertified")),
                "column_lineage": F.coalesce("column_lineage", F.create_map().cast("map<string,string>")),
            }).drop("_known"))


def volume_weight(volume: Column) -> Column:
    scaled = F.log10(volume + 1) / 5.0
    return F.when(volume > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.1), scaled))).otherwise(0.1)


def severity_weight(severity: Column) -> Column:
    weight = F.lit(1.0)
    for name, value in SEVERITY_WEIGHTS.items():
        weight = F.when(F.coalesce(severity, F.lit("warning")) == name, value).otherwise(weight)
    return weight


def rounded_impact(severity: Column, reach: Column, volume: Column, half_even: bool = False) -> Column:
    return (F.bround if half_even else F.round)(severity * F.greatest(reach, F.lit(1)) * volume, 2)


def impact_scores(suspects: DataFrame, lineage: DataFrame, half_even: bool = False) -> DataFrame:
    """severity weight x downstream tables x query volume weight, per suspect. Halves are rounded up, or to the even digit."""
    found = lookup(suspects, lineage)
    reach = F.size("downstream_tables")
    weight = volume_weight(F.col("query_volume_7d"))
    return (found.withColumn("severity_weight", severity_weight(F.col("severity")))
            .withColumn("downstream_table_count", reach)
            .withColumn("impact_score", rounded_impact(F.col("severity_weight"), reach, weight, half_even))
            .withColumn("query_volume_weight", (F.bround if half_even else F.round)(weight, 4))
            .select(*suspects.columns, "severity_weight", "downstream_table_count", "query_volume_weight",
                    "impact_score"))


def impact_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("total_count"),
                      F.coalesce(F.max("impact_score"), F.lit(0.0)).alias("max_impact_score"),
                      F.coalesce(F.round(F.avg("impact_score"), 2), F.lit(0.0)).alias("avg_impact_score"))


def traced_lineage(lineage: DataFrame, changes: DataFrame) -> DataFrame:
    """Lineage with, per table, a map from column to its upstream column and whether that drifted.

    Works on catalog rows only: one per table column, then one per table again.
    """
    links = (lineage.select("table_name", F.explode("column_lineage").alias("column_name", "source"))
             .filter(F.instr("source", ".") > 0)
             .select("table_name", "column_name", F.substring_index("source", ".", 1).alias("source_table"),
                     F.substr("source", F.instr("source", ".") + 1).alias("source_column")))
    drift = changes.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"),
                           "change", "changed")
    found = links.join(drift, ["source_table", "source_column"], "left").select(
        "table_name", F.struct("column_name", F.struct(
            F.col("column_name").alias("column"), "source_table", "source_column",
            F.coalesce("changed", F.lit(False)).alias("changed"), "change").alias("to")).alias("link"))
    maps = found.groupBy("table_name").agg(F.map_from_entries(F.collect_list("link")).alias("traces"))
    return lineage.join(maps, "table_name", "left")


def root_causes(suspects: DataFrame, lineage: DataFrame, changes: DataFrame) -> DataFrame:
    """The upstream column behind each violation.

    Of the columns a violation names, those with column lineage are traced to ``table.column``;
    one whose profile changed lately beats one that did not, the first named wins ties.

    The answer depends on the table and the columns alone. It is found once per such pair, of which there are
    at most tables times checks, and written, so that Spark knows its size and need not move the suspects.
    They are read twice: pass them written and read back.
    """
    keys = ["table_name", "target_columns"]
    found = lookup(suspects.select(*keys).distinct(), traced_lineage(lineage, changes))
    sources = F.filter(F.transform("target_columns", lambda c: F.try_element_at(F.col("traces"), c)),
                       lambda s: s.isNotNull())
    best = F.coalesce(F.try_element_at(F.filter("_sources", lambda s: s["changed"]), F.lit(1)),
                      F.try_element_at("_sources", F.lit(1)))
    out = found.withColumn("_sources", sources).withColumn("_best", best)
    traced, changed = F.col("_best").isNotNull(), F.coalesce("_best.changed", F.lit(False))
    up = F.size("upstream_tables") > 0
    where = F.concat(F.lit("Upstream "), F.col("_best.source_table"), F.lit("."), F.col("_best.source_column"))
    causes = materialise(out.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.when(traced, "success").when(up, "partial").otherwise("no_lineage").alias("root_cause_status"),
        F.coalesce("_best.source_table", F.try_element_at("upstream_tables", F.lit(1)), F.lit(""))
        .alias("root_cause_table"),
        F.coalesce("_best.source_column", F.lit("")).alias("root_cause_column"),
        F.when(changed, "HIGH").when(traced, "MEDIUM").otherwise("LOW").alias("root_cause_confidence"),
        changed.alias("profile_change_detected"),
        F.when(changed, F.concat(where, F.lit(" profile change detected: "), F.col("_best.change"), F.lit(" changed")))
        .when(traced, F.concat(where, F.lit(" is source for violated column "), F.col("_best.column")))
        .when(up, F.concat(F.lit("No column lineage available. Upstream tables: "),
                           F.array_join("upstream_tables", ", ")))
        .otherwise("No upstream lineage information available.").alias("root_cause_description")), "causes")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return suspects.join(causes, same, "left").drop(*[f"_{k}" for k in keys])
