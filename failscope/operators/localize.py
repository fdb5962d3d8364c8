"""Localization: events and steps -> suspicion of each step, evidence windows, the critical step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.functions.text import two_places
from failscope.operators.model import KEY, is_thought, ordered_lines, summary, with_step_count


@dataclass(frozen=True)
class EvidenceFilter:
    """Reach of a window, number of windows, and weights. ``radius`` sets both reaches."""

    radius: int | None = None
    max_windows: int = 5
    decay: float = 0.5
    earliness: float = 0.15
    thought: float = 0.5
    look_back: int = 8
    look_forward: int = 2

    @property
    def back(self) -> int:
        return self.look_back if self.radius is None else self.radius

    @property
    def forward(self) -> int:
        return self.look_forward if self.radius is None else self.radius

    @property
    def reach(self) -> int:
        return max(self.back, self.forward)


DEFAULT = EvidenceFilter()


def own_mass(steps: DataFrame, events: DataFrame) -> DataFrame:
    """(traj_key, step_index, n_steps, agent, own_mass): severities that fired at each step."""
    at = events.groupBy(KEY, "step_index").agg(F.sum("severity").alias("own_mass"))
    base = with_step_count(steps).select(KEY, "step_index", "n_steps", "agent")
    return base.join(at, [KEY, "step_index"], "left").withColumn("own_mass", F.coalesce("own_mass", F.lit(0.0)))


def score_steps(steps: DataFrame, events: DataFrame, filter_: EvidenceFilter = DEFAULT) -> DataFrame:
    """(traj_key, step_index, n_steps, own_mass, score).

    Neighbours spill, halved (``decay``) with each step of distance; deliberation counts less; of
    comparable steps the earlier weighs more. The spill is one window over dense indices.
    """
    trace = Window.partitionBy(KEY).orderBy("step_index")
    spill = F.col("own_mass")
    for k in range(1, filter_.reach + 1):
        near = F.lag("own_mass", k, 0.0).over(trace) + F.lead("own_mass", k, 0.0).over(trace)
        spill = spill + near * F.lit(filter_.decay**k)
    scored = own_mass(steps, events).withColumn("__spill", spill)
    weighted = F.col("__spill") * F.when(is_thought(F.col("agent")), F.lit(filter_.thought)).otherwise(F.lit(1.0))
    place = (F.col("step_index") - 1) / (F.col("n_steps") - 1)
    early = F.when((weighted > 0) & (F.col("n_steps") > 1), weighted * (F.lit(1.0) + F.lit(filter_.earliness) * (F.lit(1.0) - place))).otherwise(weighted)
    return scored.select(KEY, "step_index", "n_steps", "own_mass", early.alias("score"))


def prior(scores: DataFrame) -> DataFrame:
    """(traj_key, step, confidence): the step of the greatest score, the earlier in a tie; without any
    evidence the last step, confidence 0."""
    best = F.max_by(F.struct("step_index", "score"), F.struct("score", (-F.col("step_index")).alias("e")))
    held = scores.groupBy(KEY).agg(best.alias("b"), F.sum("score").alias("s"), F.max("n_steps").alias("n"))
    some = F.col("b.score") > 0
    return held.select(KEY, F.when(some, F.col("b.step_index")).otherwise(F.col("n")).cast("int").alias("step"), F.when(some, F.col("b.score") / F.col("s")).otherwise(F.lit(0.0)).alias("confidence"))


def ranked_steps(scores: DataFrame, limit: int = 5) -> DataFrame:
    """The steps of the greatest scores with their ``rank``."""
    order = Window.partitionBy(KEY).orderBy(F.desc("score"), "step_index")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select(KEY, "rank", "step_index", "score")


WINDOW = "struct<start: int, end: int, peak: int, score: double>"


def grow_windows(ranked: Column, n: Column, filter_: EvidenceFilter = DEFAULT) -> Column:
    """Windows grown from ``ranked``, the suspicious steps (score, peak) from the strongest on.

    A step inside a window grows none; a window ends where a neighbour begins. A fold over the array
    that holds the windows taken so far.
    """

    def add(taken: Column, step: Column) -> Column:
        peak = step["peak"]
        inside = F.exists(taken, lambda w: peak.between(w["start"], w["end"]))
        left = F.array_max(F.transform(F.filter(taken, lambda w: w["end"] < peak), lambda w: w["end"]))
        right = F.array_min(F.transform(F.filter(taken, lambda w: w["start"] > peak), lambda w: w["start"]))
        start = F.greatest(F.lit(1), peak - filter_.back, left + 1)
        end = F.least(n, peak + filter_.forward, right - 1)
        window = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), peak.cast("int").alias("peak"), step["score"].alias("score"))
        return F.when((F.size(taken) >= filter_.max_windows) | inside, taken).otherwise(F.concat(taken, F.array(window)))

    return F.aggregate(ranked, F.array().cast(f"array<{WINDOW}>"), add)


def window_arrays(scores: DataFrame, filter_: EvidenceFilter = DEFAULT) -> DataFrame:
    """(traj_key, n_steps, windows): each trace's windows by start; without evidence its tail."""
    rows = F.sort_array(F.collect_list(F.when(F.col("score") > 0, F.struct((-F.col("score")).alias("m"), F.col("step_index").alias("peak"), "score"))))
    held = scores.groupBy(KEY).agg(F.max("n_steps").cast("int").alias("n_steps"), rows.alias("ranked"))
    tail = F.array(F.struct(F.greatest(F.lit(1), F.col("n_steps") - (filter_.back + filter_.forward)).cast("int").alias("start"), F.col("n_steps").alias("end"), F.col("n_steps").alias("peak"), F.lit(0.0).alias("score")))
    grown = F.sort_array(grow_windows(F.col("ranked"), F.col("n_steps"), filter_))
    return held.select(KEY, "n_steps", F.when(F.size("ranked") > 0, grown).otherwise(tail).alias("windows"))


def windows(scores: DataFrame, filter_: EvidenceFilter = DEFAULT) -> DataFrame:
    """(traj_key, window_no, start, end, peak, score), one row a window."""
    found = window_arrays(scores, filter_).select(KEY, F.posexplode("windows").alias("p", "w"))
    return found.select(KEY, (F.col("p") + 1).alias("window_no"), "w.start", "w.end", "w.peak", "w.score")


def window_events(windows_: DataFrame, events: DataFrame) -> DataFrame:
    """The events within each window; windows without evidence have none."""
    inside = (F.col("w.traj_key") == F.col("e.traj_key")) & F.col("step_index").between(F.col("start"), F.col("end")) & (F.col("w.score") > 0)
    return windows_.alias("w").join(events.alias("e"), inside).select(f"w.{KEY}", "window_no", "start", "end", "step_index", "kind", "severity", "evidence", "signal_ord", "emit_ord")


def render_windows(steps: DataFrame, events: DataFrame, windows_: DataFrame, width: int = 200) -> DataFrame:
    """(traj_key, text): the windows as prompt text, with their signals and what is left out between."""
    sized = with_step_count(steps).withColumn("__line", summary(width)).select(KEY, "step_index", "n_steps", "__line")
    inside = (F.col("w.traj_key") == F.col("s.traj_key")) & F.col("step_index").between(F.col("start"), F.col("end"))
    body = windows_.alias("w").join(sized.alias("s"), inside).groupBy(f"w.{KEY}", "window_no").agg(ordered_lines("__line", "step_index").alias("body"), F.max("n_steps").alias("n_steps"))
    told = F.concat(F.lit("  ! step "), F.col("step_index").cast("string"), F.lit(" ["), F.col("kind"), F.lit("] "), F.col("evidence"))
    found = window_events(windows_, events).withColumn("__line", told).groupBy(KEY, "window_no").agg(ordered_lines("__line", "step_index", "kind", "signal_ord", "emit_ord").alias("findings"))
    whole = windows_.join(body, [KEY, "window_no"]).join(found, [KEY, "window_no"], "left")
    trace = Window.partitionBy(KEY).orderBy("window_no")
    skipped = F.col("start") - F.lag("end", 1, 0).over(trace) - 1
    left = F.when(F.lead("start").over(trace).isNull(), F.col("n_steps") - F.col("end")).otherwise(F.lit(0))
    whole = whole.withColumn("__skipped", skipped).withColumn("__left", left)
    note = lambda c: F.when(F.col(c) > 0, F.concat(F.lit("… "), F.col(c).cast("string"), F.lit(" step(s) omitted …")))
    head = F.concat(F.lit("--- steps "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(" (suspicion "), two_places("score"), F.lit(") ---"))
    text = F.concat_ws("\n", note("__skipped"), head, "body", F.when(F.col("findings").isNotNull(), F.concat(F.lit("signals:\n"), F.col("findings"))), note("__left"))
    return whole.withColumn("__text", text).groupBy(KEY).agg(ordered_lines("__text", "window_no").alias("text"))
