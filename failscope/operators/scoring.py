"""Scoring of predictions against ground truth, repeats, pooling and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.functions.taxonomy import category_case
from failscope.operators.calibrate import rates

TOLERANCES = (0, 1, 2, 3, 4, 5)


def ground_truth(failures: DataFrame, roots: DataFrame) -> DataFrame:
    """One row a trace: trajectory_id, critical_step, root_cause_case, earliest_case, terminal_case, all_cases.

    ``failures``: trajectory_id, pos, failure_id, step_number, category. ``roots``: trajectory_id,
    root_failure_id. Ids are trimmed texts. The first failure of the root's id is the root cause;
    failures of equal steps rank in the order of the file. Traces without failures have nulls.
    """
    id_ = lambda c: F.trim(F.col(c).cast("string"))
    marked = failures.select(id_("trajectory_id").alias("trajectory_id"), "pos", id_("failure_id").alias("failure_id"), "step_number", category_case(F.col("category")).alias("case"))
    wanted = roots.select(id_("trajectory_id").alias("trajectory_id"), id_("root_failure_id").alias("root_failure_id"))
    joined = wanted.join(marked, "trajectory_id", "left")
    order = F.struct("step_number", "pos")
    is_root = F.col("failure_id") == F.col("root_failure_id")
    first = F.min_by(F.when(is_root, F.struct("step_number", "case")), F.when(is_root, F.col("pos")))
    held = joined.groupBy("trajectory_id").agg(
        first.alias("root"), F.min_by("case", F.when(F.col("pos").isNotNull(), order)).alias("earliest_case"), F.max_by("case", F.when(F.col("pos").isNotNull(), order)).alias("terminal_case"), F.sort_array(F.collect_set("case")).alias("all_cases")
    )
    return held.select("trajectory_id", F.col("root.step_number").alias("critical_step"), F.col("root.case").alias("root_cause_case"), "earliest_case", "terminal_case", "all_cases")


def prediction_case(category: Column) -> Column:
    """A predicted category as text: a number (10 if out of range) or a name; null stays null."""
    number = F.when(category.rlike(r"^-?[0-9]{1,9}$"), category.try_cast("int"))
    return F.when(category.isNull(), F.lit(None)).when(number.isNotNull(), F.when(number.between(1, 10), number).otherwise(F.lit(10))).otherwise(category_case(category))


def records(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions paired with their targets. ``predictions``: trajectory_id, step, category (text),
    windows (array of start, end), error, and the counters of :func:`score`. Traces without ground
    truth are left out."""
    paired = predictions.withColumn("pred_case", prediction_case(F.col("category"))).join(truth, "trajectory_id")
    return paired.withColumn("distance", F.abs(F.col("step") - F.col("critical_step"))).withColumn(
        "in_window", F.when(F.size("windows") > 0, F.exists("windows", lambda w: F.col("critical_step").between(w["start"], w["end"])))
    )


def score(paired: DataFrame, *by: str) -> DataFrame:
    """Metrics of :func:`records`, by the columns ``by`` (domain, system, repeat).

    Traces without a root cause count in ``n_missing_root_cause`` only; shares are of the others.
    """
    rooted = F.col("critical_step").isNotNull()
    n = F.greatest(F.count_if(rooted), F.lit(1))
    share = lambda hit: F.count_if(rooted & hit) / n
    grouped = paired.groupBy(*by) if by else paired.groupBy()
    return grouped.agg(
        F.count_if(rooted).alias("n_scored"), F.count_if(~rooted).alias("n_missing_root_cause"), F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("n_errors"),
        *[share(F.col("distance") <= t).alias(f"within_{t}") for t in TOLERANCES],
        share(F.col("pred_case") == F.col("root_cause_case")).alias("attr_root_cause"), share(F.array_contains("all_cases", F.col("pred_case"))).alias("attr_any"),
        share(F.col("pred_case") == F.col("earliest_case")).alias("attr_earliest"), share(F.col("pred_case") == F.col("terminal_case")).alias("attr_terminal"),
        F.avg(F.when(rooted, F.col("distance"))).alias("mean_step_distance"), F.avg(F.when(rooted, F.col("in_window").cast("double"))).alias("window_recall"),
        F.sum("cost_usd").alias("cost_usd"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.coalesce(F.avg("latency_s"), F.lit(0.0)).alias("mean_latency_s"),
    )


def score_row(scores: DataFrame, *by: str) -> DataFrame:
    """The columns of a comparison table, per diagnosis and rounded half to even."""
    per = lambda c: F.when(F.col("n_scored") > 0, F.bround(c / F.col("n_scored"), 0).cast("long"))
    return scores.select(
        *by, F.col("n_scored").alias("n"), F.col("n_errors").alias("err"), per(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tok"),
        F.col("within_0").alias("exact"), F.col("within_1").alias("pm1"), F.col("within_3").alias("pm3"), F.col("within_5").alias("pm5"), F.col("attr_root_cause").alias("root_cause_cat"), F.col("attr_any").alias("any_cat"),
        F.col("window_recall").alias("win_rec"), per(F.col("prompt_tokens")).alias("in_tok"), per(F.col("completion_tokens")).alias("out_tok"), F.bround("cost_usd", 4).alias("cost_usd"), F.bround("mean_latency_s", 2).alias("latency_s"),
    )


def score_detection(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rates of ``predictions`` (trajectory_id, predicted_failed) on ``outcomes`` (trajectory_id, failed);
    predictions without a verdict and traces without an outcome don't count."""
    known = predictions.where(F.col("predicted_failed").isNotNull()).join(outcomes, "trajectory_id")
    said, truth = F.col("predicted_failed"), F.col("failed")
    counted = known.agg(F.count_if(truth & said).alias("tp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & said).alias("fp"), F.count_if(~truth & ~said).alias("tn"))
    return counted.select(*rates())


MEANS = ("exact", "pm1", "pm3", "pm5", "root_cause_cat", "any_cat", "win_rec", "in_tok", "out_tok", "tok", "cost_usd", "latency_s")


def aggregate_repeats(rows: DataFrame, *by: str) -> DataFrame:
    """Repeats of a configuration as one row: means without nulls, errors summed, the spread of exact
    hits, and both by repeat. ``rows``: :func:`score_row` with a column ``repeat``."""
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("repeat", F.col(c).alias("v")))), lambda r: r["v"])
    return rows.groupBy(*by).agg(
        F.min_by("n", "repeat").alias("n"), *[F.avg(c).alias(c) for c in MEANS], F.sum("err").alias("err"), F.count(F.lit(1)).alias("repeats"), F.coalesce(F.stddev_pop("exact"), F.lit(0.0)).alias("exact_std"),
        F.array_compact(in_order("exact")).alias("exact_per_repeat"), in_order("err").alias("err_per_repeat"),
    )


def pool(rows: DataFrame, metrics: tuple[str, ...] = ("exact", "pm5", "root_cause_cat")) -> DataFrame:
    """(system, n, <metric>..., pooled_std): means over domains weighed by traces.

    Rows with failed diagnoses are no results; only systems with a result in every domain are pooled.
    """
    n_domains = rows.agg(F.count_distinct("domain").alias("n_domains"))
    clean = rows.where(F.coalesce(F.col("err"), F.lit(0)) == 0)
    usable = lambda m: F.when(F.col(m).isNotNull(), F.col("n"))
    held = clean.groupBy("system").agg(
        F.count_distinct("domain").alias("__mine"), F.sum("n").alias("n"), *[F.try_divide(F.sum(F.col(m) * F.col("n")), F.sum(usable(m))).alias(m) for m in metrics],
        (F.sqrt(F.sum(F.pow(F.col("n") * F.coalesce("exact_std", F.lit(0.0)), F.lit(2.0)))) / F.greatest(F.sum("n"), F.lit(1))).alias("pooled_std"),
    )
    return held.crossJoin(F.broadcast(n_domains)).where("__mine = n_domains").drop("__mine", "n_domains")


def compare_runs(a: DataFrame, b: DataFrame, metric: str = "exact") -> DataFrame:
    """Systems valid in both runs: domain, system, the metric in both, and the difference."""
    valid = lambda r, name: r.where((F.coalesce(F.col("err"), F.lit(0)) == 0) & F.col(metric).isNotNull()).select("domain", "system", F.col(metric).alias(name))
    return valid(a, "a").join(valid(b, "b"), ["domain", "system"]).withColumn("delta", F.col("b") - F.col("a"))


def rankings(rows: DataFrame, metric: str = "exact") -> DataFrame:
    """(domain, ranking): systems by falling metric, ties by name, joined by `` > ``."""
    valid = rows.where((F.coalesce(F.col("err"), F.lit(0)) == 0) & F.col(metric).isNotNull())
    order = F.sort_array(F.collect_list(F.struct((-F.col(metric)).alias("m"), "system")))
    return valid.groupBy("domain").agg(F.array_join(F.transform(order, lambda r: r["system"]), " > ").alias("ranking"))


def semi(trajectories: DataFrame, ids: DataFrame) -> DataFrame:
    """The traces whose id is listed."""
    return trajectories.join(ids.select("trajectory_id"), "trajectory_id", "left_semi")


def successes(trajectories: DataFrame, failed_ids: DataFrame) -> DataFrame:
    """The traces whose id isn't among the failed."""
    return trajectories.join(failed_ids.select("trajectory_id"), "trajectory_id", "left_anti")


def first_wins(*sources: DataFrame) -> DataFrame:
    """Union of sources in which an id that an earlier source has is taken from there alone."""
    out = sources[0]
    for later in sources[1:]:
        out = out.unionByName(successes(later, out), allowMissingColumns=True)
    return out
