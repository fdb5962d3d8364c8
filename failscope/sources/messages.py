"""What the vendors' exports have in common.

Each reader turns a record (span, observation, run, message list) into a flat list of messages by a
vectorised function, because their JSON has no fixed shape. Everything that needs the whole trace is
relational: order, the one system prompt that is kept, numbering, instruction and policy.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from failscope.functions.json_tools import canonical
from failscope.schema import CALL, RESULT

#: One message of one record. ``sort_ns`` or ``sort_text`` is its record's start.
MESSAGE = f"trace string, sort_ns decimal(38, 0), sort_text string, record_no long, message_no int, role string, agent string, content string, calls array<{CALL}>, result {RESULT}, tool_schemas array<string>, fallback string, title string, kind string"
UNSET = {"sort_ns": None, "sort_text": None, "agent": None, "content": "", "calls": [], "result": None, "tool_schemas": None, "fallback": None, "title": None, "kind": "message"}


def maybe_json(value, only_nested: bool = False):
    """Parsed JSON where a text is some, else the value. ``only_nested``: objects and arrays alone."""
    if not isinstance(value, str):
        return value
    body = value.strip()
    if only_nested and body[:1] not in ("{", "["):
        return value
    try:
        return json.loads(body)
    except ValueError:
        return value


def first_of(record: dict, *names, default=None):
    """The first of the fields that is there and isn't null."""
    return next((record[n] for n in names if record.get(n) is not None), default)


def flat_text(value, keys: tuple[str, ...], keep_empty: bool) -> str:
    """Text of a payload: of an object its first field among ``keys``, of a list its items by lines."""
    value = maybe_json(value, only_nested=True)
    if isinstance(value, dict):
        field = next((k for k in keys if k in value), None)
        return json.dumps(value, default=str) if field is None else flat_text(value[field], keys, keep_empty)
    if isinstance(value, list):
        parts = [flat_text(v, keys, keep_empty) for v in value if v is not None or not keep_empty]
        return "\n".join(p for p in parts if keep_empty or p)
    return "" if value is None else str(value)


def calls_of(raw, argument_fields: tuple[str, ...], parse: Callable, default_name: str = "<unknown>") -> list[dict]:
    """Tool calls of a message, in any of the shapes in use.

    Arguments that are no JSON object leave no arguments, their text, and a note; absent ones nothing.
    """
    raw = parse(raw) or []
    entries = raw if isinstance(raw, list) else [raw]
    out = []
    for entry in entries:
        if not isinstance(entry, dict):
            continue
        body = entry["function"] if isinstance(entry.get("function"), dict) else entry
        given = body["arguments"] if "arguments" in body else first_of(entry, *argument_fields)
        parsed = parse(given)
        fine = isinstance(parsed, dict)
        arguments = parsed if fine else {}
        out.append({
            "id": None if entry.get("id") is None else str(entry["id"]), "name": str(body.get("name") or entry.get("name") or default_name), "arguments": json.dumps(arguments, default=str), "args_key": canonical(arguments),
            "raw_arguments": None if fine or parsed is None else str(parsed), "parse_error": None if fine or parsed is None else "arguments are not a JSON object",
        })
    return out


#: Names of files that hold a JSON document a line; of others the first line tells if they have more bytes than this.
LINE_FILES = r"\.(jsonl|ndjson)(\.[A-Za-z0-9]+)?$"
WHOLE_BYTES = 1 << 20
#: Messages that a task hands on at once.
ROWS_AT_ONCE = 4096


def _line_files(raw: DataFrame) -> Column:
    """Whether a file of lines is read by lines: by its name, or because its first line that isn't blank is a
    document, since a file that goes on behind a whole document is none."""
    by_name = F.col("_metadata.file_name").rlike(LINE_FILES)
    begun = raw.where(~by_name & (F.col("_metadata.file_size") > WHOLE_BYTES) & (F.col("_metadata.file_block_start") == 0) & F.col("value").rlike(r"\S"))
    # the flag is the last bit of a line's place: a minimum of numbers sorts no lines
    flagged = begun.select(F.col("_metadata.file_path").alias("file"), (F.monotonically_increasing_id() * 2 + F.try_parse_json("value").isNotNull().cast("long")).alias("at"))
    found = [r.file for r in flagged.groupBy("file").agg(F.min("at").alias("at")).where("at % 2 = 1").select("file").collect()]
    return by_name | F.col("_metadata.file_path").isin(found) if found else by_name


def _only_names_trace(row: dict) -> bool:
    """Whether a row says no more than that its trace exists."""
    return row.get("kind") == "context" and all(row.get(f) is None for f in ("tool_schemas", "fallback", "title"))


def read_payloads(spark: SparkSession, path: str, parse: Callable[[str], Iterator[dict]]) -> DataFrame:
    """Messages of files. Files of lines (see :func:`_line_files`) are read by lines, so that they may have any
    length and are split over tasks; other files are one document, or small ones of lines, each read by one task.

    Records are numbered in the order of their file: from the byte at which a task's part of it begins.
    """
    schema = to_arrow_schema(spark.createDataFrame([], MESSAGE).schema)

    def over(batches):
        upto: dict[tuple[str, int], int] = {}
        for batch in batches:
            rows, told = [], set()
            for file, start, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True):
                first = last = upto.get((file, start), start)
                for r in parse(text, file):
                    number = first + r["record_no"]
                    last = max(last, number + 1)
                    if r["trace"] in told and _only_names_trace(r):
                        continue
                    told.add(r["trace"])
                    rows.append({**UNSET, **r, "record_no": number})
                    if len(rows) >= ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, told = [], set()
                upto[file, start] = last
            yield pa.RecordBatch.from_pylist(rows, schema)

    lines, part = spark.read.text(path), ("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    by_line = _line_files(lines)
    whole = spark.read.text(path, wholetext=True).where(~by_line).select(*part)
    return whole.mapInArrow(over, MESSAGE).unionByName(lines.where(by_line).select(*part).mapInArrow(over, MESSAGE))


def documents(text: str, file: str) -> list:
    """The JSON document of a file, or those of its lines; nothing for an empty file."""
    body = text.strip()
    if not body:
        return []
    try:
        return [json.loads(body)]
    except ValueError:
        pass
    out = []
    for line in filter(None, (x.strip() for x in body.splitlines())):
        try:
            out.append(json.loads(line))
        except ValueError as wrong:
            raise ValueError(f"{file}: could not parse payload: {wrong}") from wrong
    return out


def assemble(messages: DataFrame, domain: str, roles: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(trajectories, steps) of messages.

    Records are ordered by start, then as they came. Of the system messages of a trace the first
    stays and is the policy; the first user message with a text is the instruction, else the
    record's fallback. Rows of kind ``context`` only bring tool schemas, fallback or title.
    ``roles``: traces with a message of any other role are left out.

    Either table reads the messages once and exchanges them once, by trace: files are parsed by Python.
    """
    keyed = messages.withColumn("traj_key", F.col("trace"))
    order = [F.col("sort_ns").asc_nulls_first(), F.col("sort_text").asc_nulls_first(), F.col("record_no"), F.col("message_no")]
    place = F.struct(F.coalesce("sort_ns", F.lit(0).cast("decimal(38, 0)")), F.coalesce("sort_text", F.lit("")), "record_no", "message_no")
    spoken, system = F.col("kind") == "message", F.col("role") == "system"
    strange = F.lit(False) if roles is None else spoken & ~F.col("role").isin(*roles)
    trace = Window.partitionBy("traj_key").orderBy(*order)
    known = keyed.where(spoken)
    if roles is not None:
        known = known.withColumn("__strange", F.bool_or(strange).over(trace.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("not __strange")
    upto = trace.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = known.withColumn("__systems", F.count(F.when(system, 1)).over(upto)).where(~system | (F.col("__systems") == 1))
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when, place))
    context = keyed.groupBy("traj_key").agg(
        first(F.col("content"), spoken & (F.col("role") == "user") & (F.col("content") != "")).alias("said"),
        first(F.col("content"), spoken & system).alias("policy"),
        first(F.col("tool_schemas"), F.size("tool_schemas") > 0).alias("tool_schemas"), F.max("fallback").alias("fallback"), F.max("title").alias("title"),
        (F.count(F.when(spoken & ~F.col("role").isin("system", "hidden"), 1)) + F.least(F.count(F.when(spoken & system, 1)), F.lit(1))).cast("int").alias("n_steps"), F.bool_or(strange).alias("strange"),
    )
    listed = kept.where("role <> 'hidden'").withColumn("step_index", F.row_number().over(trace))
    steps = listed.select("traj_key", F.col("trace").alias("trajectory_id"), "step_index", "role", "agent", "content", "calls", "result")
    empty = F.array().cast("array<string>")
    trajectories = context.where("not strange").select(
        "traj_key", F.col("traj_key").alias("trajectory_id"), F.lit(domain).alias("domain"), F.coalesce("said", "fallback", F.lit("")).alias("instruction"), F.lit(None).cast("string").alias("user_id"), "policy",
        F.coalesce("tool_schemas", empty).alias("tool_schemas"), empty.alias("expected_actions"), F.lit(None).cast("double").alias("reward"), F.to_json(F.struct(F.col("title").alias("name"))).alias("metadata"), "n_steps",
    )
    return trajectories, steps
