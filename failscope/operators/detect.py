"""Detection: events -> one verdict a trace, by a noisy-OR over the kinds of evidence."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.functions.text import two_places
from failscope.operators.model import KEY, ordered_lines

THRESHOLD = 0.5
#: Weights of kinds that say little about failure; all others weigh 1.
WEIGHTS = {"no_progress": 0.35, "budget_anomaly": 0.35, "stall": 0.4, "repeated_call": 0.5, "truncated_run": 0.6, "signal_error": 0.0}


def strongest(events: DataFrame) -> DataFrame:
    """(traj_key, kind, severity): the greatest severity of each kind, unweighted."""
    return events.groupBy(KEY, "kind").agg(F.max("severity").alias("severity"))


def kinds(events: DataFrame) -> DataFrame:
    """(traj_key, kinds): the greatest severity by kind as a map."""
    entries = F.sort_array(F.collect_list(F.struct("kind", "severity")))
    return strongest(events).groupBy(KEY).agg(F.map_from_entries(entries).alias("kinds"))


def confidences(events: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(traj_key, confidence) of traces with events: 1 - product of (1 - weighted severity of a kind)."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((WEIGHTS | (weights or {})).items())])
    weighted = events.select(KEY, "kind", (F.col("severity") * F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(1.0))).alias("w"))
    # the greatest of a kind first: repeats of one kind don't corroborate each other
    held = weighted.groupBy(KEY, "kind").agg(F.greatest(F.max("w"), F.lit(0.0)).alias("w"))
    # multiplied in the order of the kinds, so that the last bit, and with it a half, doesn't depend on how rows are dealt
    factors = F.sort_array(F.collect_list(F.struct("kind", (F.lit(1.0) - F.least(F.col("w"), F.lit(1.0))).alias("rest"))))
    return held.groupBy(KEY).agg((F.lit(1.0) - F.aggregate(factors, F.lit(1.0), lambda product, x: product * x["rest"])).alias("confidence"))


def verdicts(traces: DataFrame, events: DataFrame, threshold: float = THRESHOLD, weights: dict[str, float] | None = None) -> DataFrame:
    """(traj_key, confidence, failed, threshold) for every trace of ``traces`` (column traj_key).

    Traces without events have confidence 0.
    """
    scored = traces.select(KEY).distinct().join(confidences(events, weights), KEY, "left")
    confidence = F.coalesce("confidence", F.lit(0.0))
    return scored.select(KEY, confidence.alias("confidence"), (confidence >= threshold).alias("failed"), F.lit(float(threshold)).alias("threshold"))


def top_events(events: DataFrame, limit: int = 5) -> DataFrame:
    """The strongest events of each trace with their ``rank``; ties in the order of the events."""
    order = Window.partitionBy(KEY).orderBy(F.desc("severity"), "step_index", "kind", "signal_ord", "emit_ord")
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def explain(verdicts_: DataFrame, events: DataFrame, limit: int = 5) -> DataFrame:
    """(traj_key, text): the verdict and its strongest evidence."""
    line = F.concat(F.lit("  step "), F.col("step_index").cast("string"), F.lit(": ["), F.col("kind"), F.lit("] "), F.col("evidence"))
    lines = top_events(events, limit).withColumn("__l", line).groupBy(KEY).agg(ordered_lines("__l", "rank").alias("__lines"))
    head = F.concat(F.when(F.col("failed"), F.lit("FAILED")).otherwise(F.lit("ok")), F.lit(" (confidence "), two_places("confidence"), F.lit(")\n"))
    return verdicts_.join(lines, KEY, "left").select(KEY, F.coalesce(F.concat(head, F.col("__lines")), F.lit("no signals fired")).alias("text"))
