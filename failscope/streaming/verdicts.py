"""A stream of canonical JSON lines -> verdicts, one micro-batch at a time.

A line holds a whole trace, so no state is kept between batches: each batch runs the battery as a
batch query and appends its verdicts. A batch that runs again overwrites its own folder. Lines that are
no trace are listed in a folder beside the verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from failscope.operators import detect, signals
from failscope.sources.canonical import LINE, steps_table


def stream_verdicts(spark: SparkSession, path: str, out: str, checkpoint: str, threshold: float = detect.THRESHOLD, **trigger) -> StreamingQuery:
    """Starts the query; ``trigger`` as for ``DataStreamWriter.trigger`` (once what is there by default)."""

    def each(batch: DataFrame, number: int) -> None:
        # ids may repeat in a batch; a line's place tells traces apart, and is kept with the batch
        batch = batch.withColumn("traj_key", F.concat_ws("#", F.lit(str(number)), F.monotonically_increasing_id().cast("string"))).persist()
        readable = F.col("trajectory_id").isNotNull()
        batch.where(~readable).select(F.coalesce("_corrupt", F.lit("")).alias("value")).write.mode("overwrite").text(f"{out}-unreadable/batch={number}")
        keyed = batch.where(readable)
        steps = steps_table(keyed.select("traj_key", "trajectory_id", F.explode("steps").alias("s")))
        steps = steps.join(keyed.select("traj_key", F.coalesce("task.tool_schemas", F.array().cast("array<string>")).alias("tool_schemas")), "traj_key")
        found = detect.verdicts(keyed, signals.run_signals(steps), threshold)
        found.join(keyed.select("traj_key", "trajectory_id"), "traj_key").write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.unpersist()

    lines = spark.readStream.schema(LINE + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
