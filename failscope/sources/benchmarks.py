"""Chat logs and annotations of benchmarks: retail runs, multi-agent runs, ground truth."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.functions.json_tools import canonical
from failscope.schema import CALL, RESULT, TRAJECTORIES

STEP_ROW = f"traj_key string, trajectory_id string, step_index int, role string, agent string, content string, calls array<{CALL}>, result {RESULT}"
RUN = f"{TRAJECTORIES.replace(', n_steps int', '')}, steps array<struct<step_index: int, role: string, agent: string, content: string, calls: array<{CALL}>, result: {RESULT}>>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _runs(spark: SparkSession, path: str, parse) -> tuple[DataFrame, DataFrame]:
    columns = [f.split(" ")[0].rstrip(":") for f in ("traj_key", "trajectory_id", "domain", "instruction", "user_id", "policy", "tool_schemas", "expected_actions", "reward", "metadata", "steps")]

    def over(frames):
        for frame in frames:
            rows = [r for file, text in zip(frame["file"], frame["value"], strict=True) for r in parse(json.loads(text), file)]
            yield pd.DataFrame(rows, columns=columns)

    runs = _files(spark, path).mapInPandas(over, RUN)
    steps = runs.select("traj_key", "trajectory_id", F.inline("steps"))
    return runs.withColumn("n_steps", F.size("steps")).drop("steps"), steps


def parsed_arguments(raw) -> tuple[dict, str | None, str | None]:
    """(arguments, raw text, error): what is no JSON keeps its text and the parser's message; JSON
    that is no object becomes the field ``value`` and keeps its text."""
    if isinstance(raw, dict):
        return raw, None, None
    if raw in (None, ""):
        return {}, None, None
    text = raw if isinstance(raw, str) else str(raw)
    try:
        value = json.loads(text)
    except ValueError as wrong:
        return {}, text, str(wrong)
    return (value, None, None) if isinstance(value, dict) else ({"value": value}, text, None)


def reads_like_error(content: str) -> bool:
    head = content.strip()[:200].lower()
    return head.startswith("error") or any(x in head for x in ("error:", "not found"))


def retail_step(index: int, message: dict) -> dict:
    role, content = message.get("role", "assistant"), message.get("content") or ""
    calls = []
    for call in message.get("tool_calls") or []:
        body = call.get("function", {})
        arguments, raw, error = parsed_arguments(body.get("arguments"))
        calls.append({"id": call.get("id"), "name": body.get("name", "<unknown>"), "arguments": json.dumps(arguments), "args_key": canonical(arguments), "raw_arguments": raw, "parse_error": error})
    agents = {"assistant": "Assistant", "tool": message.get("name") or "Tool"}
    result = {"call_id": message.get("tool_call_id"), "name": message.get("name"), "content": content, "is_error": reads_like_error(content)} if role == "tool" else None
    return {"step_index": index, "role": role, "agent": agents.get(role), "content": content, "calls": calls, "result": result}


def retail_runs(payload, file: str) -> Iterator[dict]:
    for place, record in enumerate(payload.values() if isinstance(payload, dict) else payload):
        messages = record.get("traj", [])
        for number, message in enumerate(messages, 1):
            if message.get("index") is not None and int(message["index"]) != number:
                raise ValueError(f"run {record.get('task_id')!r}: index {message['index']} of message {number} disagrees with its position")
        info = record.get("info", {})
        task = info.get("task", {})
        leads = bool(messages) and messages[0].get("role") == "system"
        yield {
            "traj_key": f"{file}#{place}", "trajectory_id": str(record.get("task_id")), "domain": "tau_retail", "instruction": task.get("instruction", ""), "user_id": task.get("user_id"), "policy": messages[0].get("content", "") if leads else None,
            "tool_schemas": [], "expected_actions": [json.dumps(a) for a in task.get("actions", [])], "reward": None if record.get("reward") is None else float(record["reward"]),
            "metadata": json.dumps({"trial": record.get("trial"), "source": info.get("source")}), "steps": [retail_step(i, m) for i, m in enumerate(messages, 1)],
        }


def team_runs(payload, file: str) -> Iterator[dict]:
    """One run a file, named by it; files that hold no list are skipped."""
    if not isinstance(payload, list):
        return
    steps = []
    for number, message in enumerate(payload, 1):
        actor = (message.get("role") or "").strip()
        steps.append({"step_index": number, "role": "user" if actor.lower() in ("human", "user") else "agent", "agent": actor or None, "content": message.get("content") or "", "calls": [], "result": None})
    asked = next((s["content"] for s in steps if s["role"] == "user"), "")
    name = PurePosixPath(file).stem
    yield {"traj_key": file, "trajectory_id": name, "domain": "magentic_one", "instruction": asked, "user_id": None, "policy": None, "tool_schemas": [], "expected_actions": [], "reward": None, "metadata": None, "steps": steps}


def read_retail(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trajectories, steps) of a list or dict of runs."""
    return _runs(spark, path, retail_runs)


def read_team(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(trajectories, steps) of a folder with one run a file."""
    return _runs(spark, path, team_runs)


def read_ground_truth(spark: SparkSession, path: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """(failures, roots): annotated failures by trace in order, and the id of the root cause.

    Ids are trimmed texts, whatever they were.
    """
    failure = "struct<failure_id: string, step_number: int, step_reason: string, failure_category: string, category_reason: string, failed_agent: string>"
    schema = f"array<struct<trajectory_id: string, failures: array<{failure}>, root_cause: struct<failure_id: string, reason_for_root_cause: string>, failure_summary: string>>"
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.col("value"), schema)
    values = F.map_values(F.from_json(F.col("value"), f"map<string, {schema[len('array<'):-1]}>"))
    rows = text.select(F.explode(F.when(F.col("value").rlike(r"^\s*\["), listed).otherwise(values)).alias("r")).select(F.trim("r.trajectory_id").alias("trajectory_id"), "r.failures", "r.root_cause", "r.failure_summary")
    failures = rows.select("trajectory_id", F.posexplode("failures").alias("pos", "f")).select(
        "trajectory_id", "pos", F.trim("f.failure_id").alias("failure_id"), F.coalesce("f.step_number", F.lit(0)).alias("step_number"), F.coalesce("f.failure_category", F.lit("")).alias("category"),
        F.coalesce("f.step_reason", F.lit("")).alias("step_reason"), F.coalesce("f.category_reason", F.lit("")).alias("category_reason"), F.coalesce("f.failed_agent", F.lit("")).alias("failed_agent"),
    )
    roots = rows.select("trajectory_id", F.lit(domain).alias("domain"), F.trim("root_cause.failure_id").alias("root_failure_id"), F.coalesce("root_cause.reason_for_root_cause", F.lit("")).alias("reason"), F.coalesce("failure_summary", F.lit("")).alias("summary"))
    return failures, roots
