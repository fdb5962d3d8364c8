"""Queries of the readers: traces of ``events`` are written out in each vendor's form and read back.

Every step becomes a record of the form, so that what is read can be told in SQL over the projection.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.plans.projection import STEPS_SQL, steps_from_events
from failscope.plans.trace_queries import _ground_truth_tables
from failscope.sources import langsmith
from failscope.sources.benchmarks import read_ground_truth
from failscope.sources.canonical import read_traces, write_traces
from failscope.sources.registry import load


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; on one machine a temporary one if none is named."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.gettempdir()
    return f"{at.rstrip('/')}/exports-{uuid.uuid4().hex}"


def _exported(lines: DataFrame) -> str:
    at = _folder(lines.sparkSession)
    lines.write.text(at)
    return at


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return steps_from_events(spark, sf, modulus=10)


def _arguments() -> Column:
    return F.get("calls", F.lit(0))["arguments"]


def _read(steps: DataFrame) -> DataFrame:
    call, tid = F.get("calls", F.lit(0)), F.col("trajectory_id").cast("long").alias("tid")
    return steps.select(
        tid, "step_index", "role", "agent", "content", F.size("calls").alias("n_calls"), call["name"].alias("call_name"), call["args_key"].alias("args_key"),
        F.col("result.name").alias("result_name"), F.col("result.content").alias("result_content"), F.col("result.is_error").alias("is_error"),
    )


def _when(value, otherwise=None) -> Column:
    return F.when(F.size("calls") > 0, value).otherwise(F.lit(otherwise))


# ---------------------------------------------------------------- canonical traces


def src_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Written as canonical JSON lines and read again."""
    steps = _steps(spark, sf)
    none = lambda kind: F.lit(None).cast(kind)
    traces = steps.where("step_index = 1").select(
        "traj_key", "trajectory_id", F.lit("events").alias("domain"), F.lit("Buy.").alias("instruction"), none("string").alias("user_id"), none("string").alias("policy"), F.array(F.lit('{"name":"click"}')).alias("tool_schemas"),
        none("array<string>").alias("expected_actions"), none("double").alias("reward"), none("string").alias("metadata"),
    )
    at = _folder(spark)
    write_traces(traces, steps, at)
    return _read(read_traces(spark, at)[1])


def src_canonical_traces(spark: SparkSession, sf: str) -> DataFrame:
    """The traces of a canonical file, listed by the adapter's name."""
    at = _exported(_steps(spark, sf).groupBy("trajectory_id").agg(F.sort_array(F.collect_list(F.struct(F.col("step_index").alias("index"), F.col("role"), F.col("content")))).alias("steps")).select(F.to_json(F.struct("trajectory_id", F.lit("shop").alias("domain"), F.struct(F.lit("Buy.").alias("instruction"), F.lit("u").alias("user_id")).alias("task"), F.lit(1.0).alias("reward"), "steps")).alias("value")))
    traces = load(spark, at, "canonical")[0]
    return traces.select(F.col("trajectory_id").cast("long").alias("tid"), "domain", "instruction", "user_id", "reward", F.col("n_steps").cast("int").alias("n_steps"))


# ---------------------------------------------------------------- span exports


def _typed(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value")))


def _otel_lines(steps: DataFrame) -> DataFrame:
    """A span a step: tools as tool spans, others as model spans with one message."""
    called = F.array(F.struct(F.lit("1").alias("id"), F.struct(F.get("calls", F.lit(0))["name"].alias("name"), _arguments().alias("arguments")).alias("function")))
    role = F.when(F.col("role") == "agent", F.lit("critic")).otherwise(F.col("role"))
    message = F.to_json(F.array(F.struct(role.alias("role"), F.col("content").alias("content"), _when(called).alias("tool_calls"))))
    tool = F.col("result").isNotNull()
    attributes = F.array_compact(F.array(
        _typed("gen_ai.operation.name", F.when(tool, F.lit("execute_tool")).otherwise(F.lit("chat"))), _typed("gen_ai.tool.name", F.when(tool, F.col("result.name"))), _typed("output.value", F.when(tool, F.col("content"))),
        _typed("gen_ai.agent.name", F.when(~tool, F.col("agent"))), _typed("gen_ai.output.messages", F.when(~tool, message)),
    ))
    code = F.when(tool & (F.col("content") != "ok"), F.lit("STATUS_CODE_ERROR")).otherwise(F.lit("STATUS_CODE_OK"))
    span = F.struct(F.col("trajectory_id").alias("traceId"), F.lit("step").alias("name"), (F.col("step_index") * 1000).cast("string").alias("startTimeUnixNano"), attributes.alias("attributes"), F.struct(code.alias("code")).alias("status"))
    return steps.select(F.to_json(span).alias("value"))


def src_otel(spark: SparkSession, sf: str) -> DataFrame:
    """Spans by lines."""
    return _read(load(spark, _exported(_otel_lines(_steps(spark, sf))), "otel")[1])


def src_otel_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The same spans, nested in an envelope a trace: traces and their numbers of steps."""
    lines = _otel_lines(_steps(spark, sf)).withColumn("trace", F.get_json_object("value", "$.traceId"))
    envelope = lines.groupBy("trace").agg(F.concat(F.lit('{"resourceSpans": [{"scopeSpans": [{"spans": ['), F.array_join(F.collect_list("value"), ", "), F.lit("]}]}]}")).alias("value"))
    traces = load(spark, _exported(envelope.select("value")), "otel")[0]
    return traces.select(F.col("trajectory_id").cast("long").alias("tid"), "domain", "instruction", F.col("n_steps").cast("int").alias("n_steps"))


# ---------------------------------------------------------------- observation exports


def src_langfuse(spark: SparkSession, sf: str) -> DataFrame:
    """Observations by lines: tools, generations, and thoughts as messages of an unknown role."""
    steps = _steps(spark, sf)
    tool, thought = F.col("result").isNotNull(), F.col("role") == "agent"
    called = F.array(F.struct(F.lit("1").alias("id"), F.struct(F.get("calls", F.lit(0))["name"].alias("name"), _arguments().alias("arguments")).alias("function")))
    said = F.to_json(F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content"), _when(called).alias("tool_calls")))
    head = F.struct(F.col("trajectory_id").alias("traceId"), F.when(tool, F.lit("TOOL")).otherwise(F.lit("GENERATION")).alias("type"), F.when(tool, F.col("result.name")).otherwise(F.lit("model")).alias("name"), F.format_string("%06d", "step_index").alias("startTime"))
    body = F.when(tool, F.to_json(F.struct(F.struct(F.col("content").alias("result")).alias("output"))))
    body = body.when(thought, F.to_json(F.struct(F.array(F.struct(F.lit("boss").alias("role"), F.col("content").alias("content"))).alias("input")))).otherwise(F.concat(F.lit('{"output": '), said, F.lit("}")))
    line = F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(", "), F.expr("substring(b, 2)"))
    at = _exported(steps.select(F.to_json(head).alias("h"), body.alias("b")).select(line.alias("value")))
    return _read(load(spark, at, "langfuse")[1])


# ---------------------------------------------------------------- run trees


def src_langsmith(spark: SparkSession, sf: str) -> DataFrame:
    """Run trees: a root a trace, its steps as child runs."""
    steps = _steps(spark, sf)
    tool = F.col("result").isNotNull()
    called = F.array(F.struct(F.get("calls", F.lit(0))["name"].alias("name"), F.from_json(_arguments(), "amount double, k int").alias("args")))
    message = F.struct(F.lit("ai").alias("role"), F.col("content").alias("content"), _when(called).alias("tool_calls"))
    run = F.struct(
        F.col("trajectory_id").alias("trace_id"), F.when(tool, F.lit("tool")).otherwise(F.lit("llm")).alias("run_type"), F.when(tool, F.lit("error")).otherwise(F.lit("model")).alias("name"), F.format_string("%06d", "step_index").alias("start_time"),
        F.struct(F.when(tool, F.col("content")).alias("output"), F.when(~tool, F.array(F.array(F.struct(message.alias("message"))))).alias("generations")).alias("outputs"),
    )
    root = F.struct(F.col("trajectory_id").alias("trace_id"), F.lit("chain").alias("run_type"), F.lit("000000").alias("start_time"), F.col("runs").alias("child_runs"))
    lines = steps.groupBy("trajectory_id").agg(F.collect_list(run).alias("runs")).select(F.to_json(root).alias("value"))
    return _read(load(spark, _exported(lines), "langsmith")[1])


def src_langsmith_quarantined(spark: SparkSession, sf: str) -> DataFrame:
    """Traces with a message of an unknown role: here those of an even id that have an error."""
    steps = _steps(spark, sf)
    role = F.when((F.col("role") == "tool") & (F.col("traj_key") % 2 == 0), F.lit("wizard")).otherwise(F.lit("user"))
    run = F.struct(F.col("trajectory_id").alias("trace_id"), F.lit("llm").alias("run_type"), F.lit("0").alias("start_time"), F.array(F.struct(role.alias("role"), F.lit("x").alias("content"))).alias("inputs"))
    found = langsmith.quarantined(spark, _exported(steps.select(F.to_json(run).alias("value"))))
    return found.select(F.col("trace").cast("long").alias("tid"), "role")


# ---------------------------------------------------------------- ground truth


def src_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated failures, written as one array a file, with their root causes."""
    failures, root = _ground_truth_tables(steps_from_events(spark, sf))
    failure = F.struct("pos", F.concat(F.lit(" "), F.col("failure_id").cast("string")).alias("failure_id"), "step_number", F.col("category").alias("failure_category"))
    records = failures.groupBy("trajectory_id").agg(F.sort_array(F.collect_list(failure)).alias("failures")).join(root, "trajectory_id")
    record = F.struct("trajectory_id", "failures", F.struct(F.col("root_failure_id").alias("failure_id")).alias("root_cause"))
    files = records.withColumn("file", F.pmod(F.hash("trajectory_id"), F.lit(4))).groupBy("file").agg(F.to_json(F.collect_list(record)).alias("value"))
    at = _folder(spark)
    files.write.partitionBy("file").text(at)
    read, roots = read_ground_truth(spark, at, "events")
    return read.join(roots, "trajectory_id").select(F.col("trajectory_id").cast("long").alias("tid"), "step_number", "category", F.col("failure_id").cast("long").alias("failure_id"), (F.col("failure_id") == F.col("root_failure_id")).alias("is_root"), "domain")


QUERIES = {f.__name__: f for f in (src_canonical, src_canonical_traces, src_otel, src_otel_envelope, src_langfuse, src_langsmith, src_langsmith_quarantined, src_ground_truth)}

_KEY = "CASE WHEN called THEN '{\"amount\": ' || CAST(value AS VARCHAR) || ', \"k\": ' || k % 10 || '}' END AS args_key"


def _as_read(role: str, agent: str, error: str, result_name: str = "'error'", content: str = "content") -> str:
    return (
        STEPS_SQL + f"SELECT tid, i AS step_index, {role} AS role, {agent} AS agent, {content} AS content, CASE WHEN called THEN 1 ELSE 0 END AS n_calls, CASE WHEN called THEN event_type END AS call_name, {_KEY}, "
        f"CASE WHEN observed THEN {result_name} END AS result_name, CASE WHEN observed THEN content END AS result_content, CASE WHEN observed THEN {error} END AS is_error FROM steps"
    )


_MODEL = "CASE WHEN observed THEN 'tool' ELSE 'assistant' END"
ORACLES = {
    # a variant keeps no trailing zeros of a number
    "src_canonical": _as_read("role", "agent", "false").replace("CAST(value AS VARCHAR)", "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"),
    "src_canonical_traces": STEPS_SQL + "SELECT tid, 'shop' AS domain, 'Buy.' AS instruction, 'u' AS user_id, 1.0::DOUBLE AS reward, n AS n_steps FROM steps WHERE i = 1",
    "src_otel": _as_read("role", "CASE WHEN observed THEN 'error' ELSE agent END", "content <> 'ok'"),
    "src_otel_envelope": STEPS_SQL + "SELECT tid, 'otel' AS domain, '' AS instruction, n AS n_steps FROM steps WHERE i = 1",
    "src_langfuse": _as_read("role", "CASE WHEN observed THEN 'error' WHEN thought THEN NULL ELSE 'model' END", "false"),
    "src_langsmith": _as_read(_MODEL, "CASE WHEN observed THEN 'error' ELSE 'model' END", "false"),
    "src_langsmith_quarantined": STEPS_SQL + "SELECT DISTINCT tid, 'wizard' AS role FROM steps WHERE observed AND tid % 2 = 0",
    "src_ground_truth": STEPS_SQL + """
, roots AS (SELECT tid, arg_max(event_id, (value, -i)) AS root FROM steps GROUP BY tid)
SELECT s.tid, i AS step_number, CASE event_type WHEN 'view' THEN 'Invention of New Information' WHEN 'click' THEN 'Invalid Invocation' WHEN 'purchase' THEN 'Intent Not Supported' WHEN 'signup' THEN 'Guardrails Triggered' ELSE 'System Failure' END AS category,
       event_id AS failure_id, event_id = root AS is_root, 'events' AS domain
FROM steps s JOIN roots r ON s.tid = r.tid WHERE k % 7 = 0 OR event_id = root""",
}
