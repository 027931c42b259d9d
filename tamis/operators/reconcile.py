"""Judgments: cached verdicts, first and second opinions, ranking and counts.

Judgments are keyed by (record_id, rule_id): a record that breaks several rules has several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import pattern_key
from ..plans.checks import compile_rules

KEYS = ["record_id", "rule_id"]
MISMATCH = "Primary/Reflection mismatch"  # fixed value: note text


# --- cache -----------------------------------------------------------------

def rule_pattern_keys(rules, schema) -> list[str]:
    """Every pattern key the rules can produce: a bound on what a cache lookup can need."""
    return sorted({":".join((c.rule.error_type, c.rule.rule_id, ",".join(c.columns)))
                   for g in compile_rules(rules, schema) for c in g})


def live_cache(cache: DataFrame, as_of) -> DataFrame:
    """Newest entry of each pattern that has not expired (no expiry = never)."""
    newest = cache.groupBy("pattern_key").agg(F.max_by(F.struct("judgment", "confidence", "expires_at", "cached_at"),
                                                       "cached_at").alias("e")).select("pattern_key", "e.*")
    return newest.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(as_of).cast("timestamp")))


def cache_lookup(suspects: DataFrame, cache: DataFrame, as_of, pattern_keys: list[str] | None = None):
    """(hits, misses): suspects with their cached verdict, and those without.

    A verdict covers every row of a rule, so one pattern may hold a third of all suspects. When
    the rules are known, their pattern keys bound the cache side, which is then broadcast and
    the suspects never move. Without that bound Spark joins by size, and its skew join splits
    the hot pattern.
    """
    keyed = suspects.withColumn("pattern_key", pattern_key())
    live = live_cache(cache if pattern_keys is None else cache.filter(F.col("pattern_key").isin(pattern_keys)), as_of)
    live = live.select("pattern_key", F.col("judgment").alias("cached_judgment"), "cached_at")
    if pattern_keys is not None:
        live = F.broadcast(live)  # at most len(pattern_keys) rows
    return (keyed.join(live, "pattern_key"),
            keyed.join(live.select("pattern_key"), "pattern_key", "left_anti"))


def hit_rate(hits: DataFrame, misses: DataFrame) -> DataFrame:
    both = hits.select(F.lit(1).alias("hit")).unionByName(misses.select(F.lit(0).alias("hit")))
    return both.agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hit_count"),
                    (F.count("*") - F.coalesce(F.sum("hit"), F.lit(0))).alias("miss_count"),
                    F.coalesce(F.round(F.avg("hit"), 6), F.lit(0.0)).alias("hit_rate"))


JUDGMENT_JSON = "is_error boolean, error_type string, confidence string, reasoning string, " \
                "suggested_correction map<string,string>"


def cached_judgments(hits: DataFrame) -> DataFrame:
    """Cached verdicts as judgments of the record at hand (not of the record they came from)."""
    return (hits.withColumn("j", F.from_json("cached_judgment", JUDGMENT_JSON))
            .select("record_id", "rule_id", F.coalesce("j.is_error", F.lit(False)).alias("is_error"),
                    F.coalesce("j.error_type", "error_type").alias("error_type"), "j.confidence", "j.reasoning",
                    "j.suggested_correction", F.lit(True).alias("from_cache")))


def cache_entries(judgments: DataFrame, suspects: DataFrame, written_at, ttl_days: int = 30) -> DataFrame:
    """New cache rows: HIGH confidence only, one verdict per pattern.

    A pattern may cover a third of all judgments; ``max_by`` reduces it map-side.
    """
    high = judgments.filter(F.upper("confidence") == "HIGH")
    verdict = F.to_json(F.struct("is_error", "error_type", "confidence", "reasoning", "suggested_correction"))
    patterns = suspects.groupBy(*KEYS).agg(F.min(pattern_key()).alias("pattern_key"))
    keyed = high.join(per_key(patterns), KEYS)
    written = F.lit(written_at).cast("timestamp")
    return (keyed.groupBy("pattern_key")
            .agg(F.max_by(verdict, F.struct(*KEYS)).alias("judgment"))
            .select("pattern_key", "judgment", F.lit("HIGH").alias("confidence"), written.alias("cached_at"),
                    (written + F.make_interval(days=F.lit(ttl_days))).alias("expires_at")))


# --- opinions --------------------------------------------------------------

def per_key(df: DataFrame) -> DataFrame:
    """The side of a join that has a row per (record, rule): it meets the other in shuffles. Such rows take little room in files and much in
    memory, so by the size of files Spark would send millions of them to the driver and on to all tasks."""
    return df.hint("merge")


def _dealt(df: DataFrame) -> DataFrame:
    """Dealt by the keys over all shuffle partitions before a grouping: nearly every key occurs once, so a map over a large split would hold all
    its keys and combine nothing."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEYS)


def last_answer(judgments: DataFrame) -> DataFrame:
    """One judgment per (record, rule): the last one given (by batch and position, if known).

    Grouping by the keys of the join that follows costs no extra shuffle, and keeps repeated
    answers about one record from multiplying in it.
    """
    order = [c for c in ("batch_id", "pos") if c in judgments.columns]
    rest = [c for c in judgments.columns if c not in (*KEYS, *order)]
    if not order and [judgments.schema[c].dataType.typeName() for c in rest] == ["boolean"]:  # in order as its JSON is, and needs no sort
        return _dealt(judgments).groupBy(*KEYS).agg(F.max(rest[0]).alias(rest[0]))
    by = F.struct(*order) if order else F.to_json(F.struct(*rest))
    return (judgments.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), by).alias("j"))
            .select(*KEYS, "j.*"))


def reconcile(primary: DataFrame, reflection: DataFrame) -> DataFrame:
    """Second opinion against the first: where they differ the verdict stays and drops to LOW."""
    second = last_answer(reflection).select(*KEYS, F.col("is_error").alias("_second"))
    differs = F.coalesce(F.col("_second") != F.col("is_error"), F.lit(False))
    return (primary.join(per_key(second), KEYS, "left")
            .withColumn("reflection_match", ~differs)
            .withColumn("confidence", F.when(differs, "LOW").otherwise(F.col("confidence")))
            .withColumn("reflection_note", F.when(differs, MISMATCH).otherwise(""))
            .drop("_second"))


def mismatches(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter(~F.col("reflection_match"))


def apply_deep(reconciled: DataFrame, deep: DataFrame) -> DataFrame:
    """A third, deeper opinion on the mismatches replaces verdict and confidence."""
    third = last_answer(deep).select(*KEYS, F.struct("is_error", "confidence", "reasoning").alias("_deep"))
    found = F.col("_deep").isNotNull()
    return (reconciled.join(per_key(third), KEYS, "left")
            .withColumn("confidence", F.coalesce("_deep.confidence", "confidence"))
            .withColumn("is_error", F.coalesce("_deep.is_error", "is_error"))
            .withColumn("reflection_note", F.when(found, F.concat(
                F.lit("DEEP_ANALYSIS: "), F.coalesce("_deep.reasoning", F.lit("")))).otherwise(F.col("reflection_note")))
            .drop("_deep"))


def combine(cached: DataFrame, judged: DataFrame) -> DataFrame:
    """Cached and new judgments together."""
    return cached.unionByName(judged.withColumn("from_cache", F.lit(False)), allowMissingColumns=True)


# --- counts and order --------------------------------------------------------

def confidence_counts(judgments: DataFrame) -> DataFrame:
    level = F.col("confidence")
    return judgments.agg(
        F.count("*").alias("total_analyzed"), F.count_if("is_error").alias("error_count"),
        F.count_if(level == "HIGH").alias("high_count"), F.count_if(level == "MEDIUM").alias("medium_count"),
        F.count_if(level == "LOW").alias("low_count"))


def confidence_rank(col: Column | None = None) -> Column:
    col = F.col("confidence") if col is None else col
    return F.when(col == "HIGH", 0).when(col == "MEDIUM", 1).otherwise(2)


def ranked(judgments: DataFrame) -> DataFrame:
    """HIGH first, then MEDIUM, then the rest; ids break ties so range partitions stay even."""
    return judgments.withColumn("confidence_rank", confidence_rank()).orderBy("confidence_rank", *KEYS)


def with_impact(judgments: DataFrame, scored: DataFrame) -> DataFrame:
    """Carry the impact score of the suspect over to its judgment."""
    scores = _dealt(scored.select(*KEYS, "impact_score")).groupBy(*KEYS).agg(F.max("impact_score").alias("impact_score"))
    return (judgments.join(scores, KEYS, "left")
            .withColumn("impact_score", F.coalesce("impact_score", F.lit(0.0))))


def ranked_by_impact(judgments: DataFrame) -> DataFrame:
    return judgments.orderBy(F.desc("impact_score"), *KEYS)
