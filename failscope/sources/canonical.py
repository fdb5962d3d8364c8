"""Canonical JSON lines: one trace a line, its steps nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.functions.json_tools import args_keys
from failscope.schema import CALL, RESULT, ROLES

_CALL_IN = "struct<id: string, name: string, arguments: string, raw_arguments: string, parse_error: string>"
_STEP_IN = f"struct<index: int, role: string, agent: string, content: string, tool_calls: array<{_CALL_IN}>, tool_result: {RESULT}, metadata: string>"
_TASK_IN = "struct<instruction: string, user_id: string, policy: string, tool_schemas: array<string>, expected_actions: array<string>>"
LINE = f"trajectory_id string, domain string, reward double, metadata string, task {_TASK_IN}, steps array<{_STEP_IN}>"


def traj_key() -> Column:
    """Surrogate key of a row: its file and its place; ids are not unique."""
    return F.concat_ws("#", F.col("__file"), F.col("__at").cast("string"))


def _nested(raw: DataFrame) -> DataFrame:
    """Rows of LINE with ``traj_key`` -> the same, steps as struct of the model, fields with defaults."""
    empty = F.array().cast("array<string>")
    return raw.select(
        "traj_key", "trajectory_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.coalesce("task.instruction", F.lit("")).alias("instruction"), F.col("task.user_id").alias("user_id"), F.col("task.policy").alias("policy"),
        F.coalesce("task.tool_schemas", empty).alias("tool_schemas"), F.coalesce("task.expected_actions", empty).alias("expected_actions"), "reward", "metadata", F.coalesce("steps", F.array().cast(f"array<{_STEP_IN}>")).alias("steps"),
    )


def read_traces(spark: SparkSession, path: str, strict: bool = True, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(trajectories, steps) of a JSON lines file, a folder of them, or (``multi_line``) whole files.

    Blank lines are skipped. Strict reading fails at the first line that is no trace, whose step
    indices aren't 1, 2, ... in order, or whose roles are unknown; otherwise such lines are left out
    (see :func:`corrupt_lines`).
    """
    raw = spark.read.schema(LINE + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", multi_line).json(path)
    raw = raw.withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.monotonically_increasing_id())
    in_order = F.forall(F.transform("steps", lambda s, i: s["index"] == i + 1), lambda x: F.coalesce(x, F.lit(False)))
    known = F.forall("steps", lambda s: s["role"].isin(*ROLES))
    named = F.forall(F.flatten(F.transform("steps", lambda s: F.coalesce(s["tool_calls"], F.array().cast(f"array<{_CALL_IN}>")))), lambda c: c["name"].isNotNull())
    good = F.col("_corrupt").isNull() & F.col("trajectory_id").isNotNull() & F.coalesce(in_order & known & named, F.lit(True))
    if strict:
        where = F.concat(F.col("__file"), F.lit(": could not parse trajectory "), F.coalesce(F.col("_corrupt"), F.col("trajectory_id"), F.lit("?")))
        raw = raw.where(F.when(good, F.lit(True)).otherwise(F.raise_error(where).cast("boolean")))
    else:
        raw = raw.where(good)
    nested = _nested(raw.withColumn("traj_key", traj_key()))
    trajectories = nested.withColumn("n_steps", F.size("steps")).drop("steps")
    exploded = nested.select("traj_key", "trajectory_id", F.explode("steps").alias("s"))
    return trajectories, steps_table(exploded)


def steps_table(exploded: DataFrame) -> DataFrame:
    """(traj_key, trajectory_id, s) -> the table of steps, calls with canonical argument keys."""
    # the arguments of a step travel as one JSON array of texts, so that the vectorised function keeps the rows
    texts = F.to_json(F.transform(F.coalesce("s.tool_calls", F.array().cast(f"array<{_CALL_IN}>")), lambda c: F.coalesce(c["arguments"], F.lit("{}"))))
    with_keys = exploded.withColumn("__keys", F.from_json(args_keys(texts), "array<string>"))
    calls = F.zip_with(
        F.coalesce("s.tool_calls", F.array().cast(f"array<{_CALL_IN}>")), "__keys",
        lambda c, k: F.struct(c["id"].alias("id"), c["name"].alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments"), k.alias("args_key"), c["raw_arguments"].alias("raw_arguments"), c["parse_error"].alias("parse_error")),
    )
    result = F.when(F.col("s.tool_result").isNotNull(), F.struct(F.col("s.tool_result.call_id").alias("call_id"), F.col("s.tool_result.name").alias("name"), F.coalesce("s.tool_result.content", F.lit("")).alias("content"), F.coalesce("s.tool_result.is_error", F.lit(False)).alias("is_error")))
    return with_keys.select(
        "traj_key", "trajectory_id", F.col("s.index").alias("step_index"), F.col("s.role").alias("role"), F.col("s.agent").alias("agent"), F.coalesce("s.content", F.lit("")).alias("content"), calls.cast(f"array<{CALL}>").alias("calls"), result.cast(RESULT).alias("result"),
    )


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the lines that are no JSON."""
    raw = spark.read.schema(LINE + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # a line that is no JSON has no other field either; naming one keeps the reader parsing whole lines
    return raw.where(F.col("_corrupt").isNotNull() & F.col("trajectory_id").isNull()).select(F.col("_metadata.file_path").alias("file"), F.col("_corrupt").alias("line"))


def to_nested(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """One row a trace in the canonical form."""
    as_json = lambda c: F.when(c.isNotNull(), F.try_parse_json(c))
    call = lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name"), as_json(c["arguments"]).alias("arguments"), c["raw_arguments"].alias("raw_arguments"), c["parse_error"].alias("parse_error"))
    step = F.struct(F.col("step_index").alias("index"), "role", "agent", "content", F.transform("calls", call).alias("tool_calls"), F.col("result").alias("tool_result"))
    # variants have no order, so steps are sorted by index alone
    nested = steps.groupBy("traj_key").agg(F.collect_list(step).alias("steps"))
    nested = nested.withColumn("steps", F.array_sort("steps", lambda a, b: a["index"] - b["index"]))
    task = F.struct("instruction", "user_id", "policy", F.transform("tool_schemas", as_json).alias("tool_schemas"), F.transform("expected_actions", as_json).alias("expected_actions"))
    whole = trajectories.join(nested, "traj_key", "left")
    return whole.select("trajectory_id", "domain", task.alias("task"), F.coalesce("steps", F.array().cast(nested.schema["steps"].dataType)).alias("steps"), "reward", as_json(F.col("metadata")).alias("metadata"))


def write_traces(trajectories: DataFrame, steps: DataFrame, path: str) -> int:
    """Writes canonical JSON lines without null fields and returns how many traces were written."""
    to_nested(trajectories, steps).write.mode("overwrite").option("ignoreNullFields", True).json(path)
    return trajectories.sparkSession.read.text(path).count()
