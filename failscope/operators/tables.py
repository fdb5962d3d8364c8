"""Results as text: fixed-width tables and the summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.operators import detect, scoring
from failscope.operators.model import KEY, ordered_lines


def format_table(rows: DataFrame, columns: list[str] | None = None, places: int = 3, limit: int = 1000) -> str:
    """A small table (``limit`` rows at most; it is meant for a terminal) with aligned columns; nulls are ``-``."""
    columns = columns or rows.columns
    say = lambda v: "-" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    body = [[say(r[c]) for c in columns] for r in rows.limit(limit).collect()]
    widths = [max(len(c), *(len(r[i]) for r in body), 0) for i, c in enumerate(columns)]
    line = lambda cells: "  ".join(x.ljust(w) for x, w in zip(cells, widths, strict=True)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in widths]), *map(line, body)])


def detection_table(traces: DataFrame, verdicts: DataFrame, events: DataFrame) -> DataFrame:
    """(traj_key, trajectory_id, verdict, confidence, evidence): the three strongest events in words."""
    told = F.concat(F.col("kind"), F.lit("@"), F.col("step_index").cast("string"))
    strongest = detect.top_events(events, 3).withColumn("__t", told).groupBy(KEY).agg(F.replace(ordered_lines("__t", "rank"), F.lit("\n"), F.lit(", ")).alias("evidence"))
    named = traces.select(KEY, "trajectory_id").distinct().join(verdicts, KEY).join(strongest, KEY, "left")
    return named.select(KEY, "trajectory_id", F.when(F.col("failed"), F.lit("FAILED")).otherwise(F.lit("ok")).alias("verdict"), F.bround("confidence", 3).alias("confidence"), F.coalesce("evidence", F.lit("")).alias("evidence"))


def detection_summary(verdicts: DataFrame) -> DataFrame:
    """(failed, total) of all verdicts."""
    return verdicts.agg(F.count_if("failed").alias("failed"), F.count(F.lit(1)).alias("total"))


def failed_only(trajectories: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The traces to diagnose: those whose verdict is failure, so that the judge reads no others."""
    return trajectories.join(verdicts.where("failed").select(KEY), KEY, "left_semi")


def limit_by_domain(trajectories: DataFrame, truth: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` annotated traces of each domain, in the order of the annotations (``pos``)."""
    listed = trajectories.join(truth.select("trajectory_id", "pos"), "trajectory_id")
    order = Window.partitionBy("domain").orderBy("pos")
    return listed.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= limit).drop("__n", "pos")


def run_report(rows: DataFrame) -> str:
    """Rows with failed diagnoses, the others by domain, and what is pooled over all domains."""
    bad = rows.where(F.coalesce(F.col("err"), F.lit(0)) > 0).select("domain", "system", "err").orderBy("domain", "system")
    clean = rows.where(F.coalesce(F.col("err"), F.lit(0)) == 0).orderBy("domain", F.desc_nulls_last("exact"), "system")
    shown = [c for c in ("domain", "system", "n", "exact", "exact_std", "pm5", "root_cause_cat", "tok") if c in rows.columns]
    n_domains = rows.agg(F.count_distinct("domain").alias("n")).first().n
    pooled = scoring.pool(rows).orderBy("system")
    missing = clean.groupBy("system").agg(F.count_distinct("domain").alias("valid_domains")).where(F.col("valid_domains") < n_domains).orderBy("system")
    parts = ["Not results, because diagnoses failed:\n" + format_table(bad)] if bad.limit(1).count() else []
    parts += ["By domain:\n" + format_table(clean, shown), "Pooled over domains:\n" + format_table(pooled)]
    if missing.limit(1).count():
        parts.append("Not pooled, for want of a valid row in each domain:\n" + format_table(missing))
    return "\n\n".join(parts)


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines; the committer puts the whole folder in place at once."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
