"""Benchmark runs: systems against annotated traces, resumable row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.operators import detect, judge, scoring
from failscope.operators.model import KEY

#: Metrics of a row beside its counters.
SHOWN = ("n", "err", "tok", "exact", "pm1", "pm3", "pm5", "root_cause_cat", "any_cat", "win_rec", "in_tok", "out_tok", "cost_usd", "latency_s")


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def detection_rates(trajectories: DataFrame, events: DataFrame, truth: DataFrame, threshold: float = detect.THRESHOLD) -> DataFrame:
    """Rates of the verdicts; traces with an annotation are the failures."""
    said = detect.verdicts(trajectories, events, threshold).join(trajectories.select(KEY, "trajectory_id"), KEY).select("trajectory_id", F.col("failed").alias("predicted_failed"))
    annotated = truth.select(F.col("trajectory_id").alias("of_id")).distinct()
    outcomes = trajectories.select("trajectory_id").distinct().join(annotated, F.col("trajectory_id") == F.col("of_id"), "left").select("trajectory_id", F.col("of_id").isNotNull().alias("failed"))
    return scoring.score_detection(said, outcomes)


def result_rows(trajectories: DataFrame, steps: DataFrame, events: DataFrame, truth: DataFrame, system: judge.System, client_factory: Callable | None, tier: str) -> DataFrame:
    """One row a domain: the metrics of a system's reports of the annotated traces."""
    found = judge.diagnose(trajectories, steps, events, system, client_factory, tier).join(trajectories.select(KEY, "trajectory_id", "domain"), KEY)
    predicted = found.select(
        "trajectory_id", "domain", F.col("critical_step").alias("step"), "category", "windows", F.lit(None).cast("string").alias("error"), "cost_usd", "prompt_tokens", "completion_tokens", "latency_s",
    )
    paired = scoring.records(predicted, truth.drop("domain"))
    return scoring.score_row(scoring.score(paired, "domain"), "domain").withColumn("system", F.lit(system.name))


def run_bench(
    trajectories: DataFrame, steps: DataFrame, events: DataFrame, truth: DataFrame, out: str, systems: Iterable[str] = judge.DEFAULT_SYSTEMS, client_factory: Callable | None = None, tier: str = "", repeats: int = 1
) -> DataFrame:
    """Rows of all systems and repeats, averaged over the repeats.

    Each system's rows of a repeat are a folder of their own below ``out``, written before the next
    begins; a run that is started again leaves finished folders as they are and goes on behind them.
    """
    spark = trajectories.sparkSession
    annotated = trajectories.join(truth.select("trajectory_id").distinct(), "trajectory_id", "left_semi").persist()
    own = annotated.select(KEY)
    read = [(steps.join(own, KEY, "left_semi")), events.join(own, KEY, "left_semi")]
    folders = [(name, repeat, f"{out}/system={name}/repeat={repeat}") for name in systems for repeat in range(repeats)]
    for name, _, at in folders:
        if not finished(spark, at):
            result_rows(annotated, *read, truth, judge.SYSTEMS[name], client_factory, tier).drop("system").write.mode("overwrite").option("ignoreNullFields", False).json(at)
    annotated.unpersist()
    kinds = "domain string, " + ", ".join(f"{c} {'long' if c in ('n', 'err', 'tok', 'in_tok', 'out_tok') else 'double'}" for c in SHOWN)
    rows = None
    for name, repeat, at in folders:
        part = spark.read.schema(kinds).json(at).withColumn("system", F.lit(name)).withColumn("repeat", F.lit(repeat))
        rows = part if rows is None else rows.unionByName(part)
    for c in scoring.MEANS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    return scoring.aggregate_repeats(rows, "domain", "system")
