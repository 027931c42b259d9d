"""The usual order of the operators, for one table and one run.

    found   = check(df, rules)                      one scan; suspects written once
    judged  = judge(found, ask, cache=..., ...)     cached verdicts, then two opinions
    summary = report(df, found, judged.judgments)   one row
    changed = correct(df, judged.judgments, decisions, run_id)

Suspects, judgments and approved items are each read by several later steps. They are far
smaller than the table, so they are written to the shared folder and read back: the table is
scanned once, Spark knows their true size when it plans joins, and a lost executor costs a task
and not the lineage.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from .operators import correct as fixing
from .operators import health, reconcile
from .operators import judge as judging
from .operators.suspects import find_first_suspects
from .session import materialise


def check(df: DataFrame, rules, key: str = "record_id", unique_key: bool = True, carry=()) -> DataFrame:
    """Suspects of a table, at most one per (record, rule)."""
    return materialise(find_first_suspects(df, rules, key, unique_key, carry), "suspects")


@dataclass
class Judged:
    judgments: DataFrame        # cached and new, reconciled
    failures: DataFrame         # items without a usable answer, with the reason
    calls: DataFrame            # one row per call of the judge: response, tokens
    new_cache_entries: DataFrame


def judge(suspects: DataFrame, ask: Callable, as_of, cache: DataFrame | None = None, pattern_keys=None,
          reflect: Callable | None = None, deep: Callable | None = None, batch_size: int = 50,
          deep_batch_size: int = 20, parallel_calls: int | None = None) -> Judged:
    """Verdicts on suspects.

    Patterns with a live cache entry are not asked again. ``reflect`` gives the second opinion
    and is shown the first; ``deep`` looks again at suspects on which the two differ. ``parallel_calls``
    tasks call at the same time.
    """
    if deep is not None and reflect is None:
        raise ValueError("deep looks at what two opinions differ on: give reflect as well")
    hits, open_items = None, suspects
    if cache is not None:
        hits, misses = reconcile.cache_lookup(suspects, cache, as_of, pattern_keys)
        open_items = materialise(misses.drop("pattern_key"), "misses")
    keys = reconcile.KEYS

    def opinion(items, function, kind, size):
        calls = judging.call_judge(items, function, kind, size, parallel_calls=parallel_calls)
        good, bad = judging.parse_responses(calls)
        return calls, reconcile.last_answer(good), bad

    calls, first, failures = opinion(open_items, ask, "PRIMARY", batch_size)
    first = first.withColumn("reflection_match", F.lit(True)).withColumn("reflection_note", F.lit(""))
    if reflect is not None:
        first = materialise(first, "first-opinions")  # read twice: answers are parsed once
        shown = first.select(*keys, F.struct("is_error", "confidence", "reasoning").alias("first_opinion"))
        seen = judging.dealt(open_items, parallel_calls).join(reconcile.per_key(shown), keys)
        more_calls, second, more_failures = opinion(seen, reflect, "REFLECTION", batch_size)
        first = materialise(reconcile.reconcile(first.drop("reflection_match", "reflection_note"), second), "opinions")
        calls, failures = calls.unionByName(more_calls), failures.unionByName(more_failures)
        if deep is not None:
            doubtful = reconcile.per_key(reconcile.mismatches(first).select(*keys))  # a row per key; Spark would move a semi join below the dealing
            differ = judging.dealt(open_items, parallel_calls).join(doubtful, keys).select(*[F.col(f"`{c}`") for c in open_items.columns])
            more_calls, third, more_failures = opinion(differ, deep, "DEEP_ANALYSIS", deep_batch_size)
            first = reconcile.apply_deep(first, third)
            calls, failures = calls.unionByName(more_calls), failures.unionByName(more_failures)
    judged = materialise(first, "judgments")
    entries = reconcile.cache_entries(judged, open_items, as_of)
    both = judged.withColumn("from_cache", F.lit(False)) if hits is None else reconcile.combine(
        reconcile.cached_judgments(hits), judged)
    return Judged(both, failures, calls, entries)


def report(df: DataFrame, suspects: DataFrame, judgments: DataFrame) -> DataFrame:
    """Counts of the run and the health of the table, one row."""
    score = health.health_score(judgments, df).select("health_score", "status")
    return health.side_by_side(health.report_summary(df, suspects, judgments), score)


@dataclass
class Corrected:
    table: DataFrame            # with approved cells replaced
    log: DataFrame              # one audit row per cell
    snapshot: DataFrame         # the rows as they were
    quarantine: DataFrame       # approved HIGH errors, whole rows as JSON
    feedback: DataFrame         # rejected errors


def correct(df: DataFrame, judgments: DataFrame, decisions: DataFrame, run_id: str, at,
            key: str = "record_id") -> Corrected:
    """Corrections for approved errors of HIGH confidence; nothing without an approval row."""
    items = materialise(fixing.approved(health.approval_queue(judgments), decisions), "approved")
    cells = materialise(fixing.correction_cells(items), "cells")
    return Corrected(
        fixing.apply_corrections(df, cells, key), fixing.correction_log(df, cells, run_id, key),
        fixing.snapshot(df, items, key), fixing.quarantine(df, items, run_id, "HIGH confidence errors", at, key),
        fixing.feedback(judgments, decisions))
