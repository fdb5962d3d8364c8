"""Traces from the ``events`` and ``conversations`` tables.

``events`` holds no agent traces; a fixed rule projects them. A trace is a user's week of the month
(``weekly``) or a user (``user``); its steps are the events in order of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.operators.model import number_steps
from failscope.schema import CALL, RESULT


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def steps_from_events(spark: SparkSession, sf_dir: str, key: str = "weekly", modulus: int = 100) -> DataFrame:
    """Steps of the projected traces. ``modulus`` coarsens the calls' argument ``k``."""
    trace = F.col("user_id") if key == "user" else F.col("user_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 7)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    rows = events_table(spark, sf_dir).select(trace.cast("long").alias("traj_key"), "event_id", "ts", kind, "value", k.alias("k"))
    said = (
        F.when((kind == "error") & (F.col("k") % 4 == 0), F.lit("Error: item not found"))
        .when((kind == "error") & (F.col("k") % 4 == 1), F.lit("request timed out"))
        .when(kind == "error", F.lit("ok"))
        .when((kind == "view") & (F.col("k") % 5 == 0), F.lit("I am unable to complete this request."))
        .when((kind == "view") & (F.col("k") % 5 == 1), F.lit("Unfortunately no results were found."))
        .when((kind == "view") & (F.col("k") % 5 == 2), F.lit("ValueError: bad input"))
        .when((kind == "view") & (F.col("k") % 5 == 3), F.lit("upstream said HTTP 503"))
        .when(kind == "view", F.lit("Done! Your order is placed."))
        .when(kind == "signup", F.lit("thinking"))
        .otherwise(F.lit(""))
    )
    coarse = (F.col("k") % modulus).cast("string")
    call = F.struct(
        F.lit(None).cast("string").alias("id"), kind.alias("name"), F.to_json(F.struct(F.col("value").alias("amount"), (F.col("k") % modulus).alias("k"))).alias("arguments"),
        F.concat(F.lit('{"k": '), coarse, F.lit("}")).alias("args_key"), F.lit(None).cast("string").alias("raw_arguments"), F.lit(None).cast("string").alias("parse_error"),
    ).cast(CALL)
    result = F.struct(F.lit(None).cast("string").alias("call_id"), F.lit("error").alias("name"), said.alias("content"), F.lit(False).alias("is_error")).cast(RESULT)
    steps = rows.select(
        "traj_key", "ts", "event_id", "value", "k", kind,
        F.col("traj_key").cast("string").alias("trajectory_id"),
        F.when(kind == "signup", F.lit("agent")).when(kind == "error", F.lit("tool")).otherwise(F.lit("assistant")).alias("role"),
        F.when(kind == "signup", F.lit("Orchestrator (thought)")).alias("agent"),
        said.alias("content"),
        F.when(kind.isin("click", "purchase"), F.array(call)).otherwise(F.array().cast(f"array<{CALL}>")).alias("calls"),
        F.when(kind == "error", result).alias("result"),
    )
    return number_steps(steps, "ts", "event_id")


def steps_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces: a turn is a step."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(
        F.col("conv_id").alias("traj_key"), F.col("conv_id").cast("string").alias("trajectory_id"), (F.col("turn") + 1).cast("int").alias("step_index"), "role", F.lit(None).cast("string").alias("agent"), F.col("text").alias("content"),
        F.array().cast(f"array<{CALL}>").alias("calls"), F.lit(None).cast(RESULT).alias("result"),
    )


#: The projection in SQL, as the beginning of each statement: tables ``steps`` (weekly), ``user_steps``.
STEPS_SQL = """
WITH base AS (
    SELECT user_id * 10 + CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS weekly, user_id, event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
           CASE event_type WHEN 'signup' THEN 'agent' WHEN 'error' THEN 'tool' ELSE 'assistant' END AS role,
           CASE WHEN event_type = 'signup' THEN 'Orchestrator (thought)' END AS agent, event_type = 'signup' AS thought,
           event_type IN ('click', 'purchase') AS called, event_type = 'error' AS observed
    FROM events),
said AS (
    SELECT *, CASE WHEN event_type = 'error' THEN CASE k % 4 WHEN 0 THEN 'Error: item not found' WHEN 1 THEN 'request timed out' ELSE 'ok' END
        WHEN event_type = 'view' THEN CASE k % 5 WHEN 0 THEN 'I am unable to complete this request.' WHEN 1 THEN 'Unfortunately no results were found.'
            WHEN 2 THEN 'ValueError: bad input' WHEN 3 THEN 'upstream said HTTP 503' ELSE 'Done! Your order is placed.' END
        WHEN event_type = 'signup' THEN 'thinking' ELSE '' END AS content, called OR observed AS acts
    FROM base),
steps AS (
    SELECT *, weekly AS tid, CAST(row_number() OVER (PARTITION BY weekly ORDER BY ts, event_id) AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY weekly) AS INTEGER) AS n FROM said),
user_steps AS (
    SELECT *, user_id AS tid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS i, CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n FROM said)
"""
