"""Readers of exports: messages, order, numbering, defaults and broken input."""

import json

import pytest

from failscope.operators.model import contiguity, require_contiguous, step_at
from failscope.sources import langsmith, otel
from failscope.sources.benchmarks import read_ground_truth
from failscope.sources.canonical import corrupt_lines, read_traces, write_traces
from failscope.sources.messages import read_payloads
from failscope.sources.registry import load

TRACE = {
    "trajectory_id": "t1", "domain": "shop", "reward": 0.5, "task": {"instruction": "buy", "tool_schemas": [{"name": "find"}]},
    "steps": [
        {"index": 1, "role": "user", "content": "hi"},
        {"index": 2, "role": "assistant", "tool_calls": [{"id": "c", "name": "find", "arguments": {"b": 1, "a": 1.0}}, {"name": "bad", "raw_arguments": "{", "parse_error": "no"}]},
        {"index": 3, "role": "tool", "content": "x", "tool_result": {"call_id": "c", "name": "find", "content": "Error: none", "is_error": True}},
    ],
}


def write(path, *items, lines=False):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in items) if lines else json.dumps(items[0]))
    return str(path)


def steps_of(steps, trace=None):
    rows = [r for r in steps.collect() if trace is None or r.trajectory_id == trace]
    return [(r.step_index, r.role, r.agent, r.content) for r in sorted(rows, key=lambda r: (r.trajectory_id, r.step_index))]


def test_canonical_round_trip(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", TRACE, "", {"trajectory_id": "t1"}, "   ", lines=True)
    trajectories, steps = read_traces(spark, path)
    rows = {r.n_steps: r for r in trajectories.collect()}
    assert set(rows) == {0, 3} and rows[3].domain == "shop" and rows[0].domain == "unknown" and rows[3].traj_key != rows[0].traj_key
    calls = steps.where("step_index = 2").first().calls
    assert [(c.name, c.args_key, c.parse_error) for c in calls] == [("find", '{"a": 1.0, "b": 1}', None), ("bad", "{}", "no")]
    assert write_traces(trajectories, steps, str(tmp_path / "out")) == 2
    again = read_traces(spark, str(tmp_path / "out"))
    assert sorted(map(repr, steps_of(again[1]))) == sorted(map(repr, steps_of(steps)))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert "null" not in text
    single = write(tmp_path / "one.json", TRACE)
    assert read_traces(spark, single, multi_line=True)[1].count() == 3


@pytest.mark.parametrize("bad", ["{not json", json.dumps(TRACE | {"steps": [TRACE["steps"][1]]}), json.dumps(TRACE | {"steps": [{"index": 1, "role": "wizard"}]})])
def test_canonical_strict_and_permissive(spark, tmp_path, bad):
    path = write(tmp_path / "a.jsonl", TRACE, bad, lines=True)
    with pytest.raises(Exception, match="could not parse trajectory"):
        read_traces(spark, path)[1].collect()
    assert read_traces(spark, path, strict=False)[0].count() == 1
    assert corrupt_lines(spark, path).count() == (bad == "{not json")


def test_contiguity_and_access(spark):
    rows = spark.createDataFrame([("a", "a", 1), ("a", "a", 2), ("b", "b", 2), ("b", "b", 3), ("c", "c", 1), ("c", "c", 1)], "traj_key string, trajectory_id string, step_index int")
    assert {r.traj_key: r.contiguous for r in contiguity(rows).collect()} == {"a": True, "b": False, "c": False}
    assert require_contiguous(rows.where("traj_key = 'a'")).count() == 2
    with pytest.raises(Exception, match="not contiguous"):
        require_contiguous(rows).collect()
    with pytest.raises(Exception, match="out of range"):
        step_at(rows.where("traj_key = 'a'"), 3).collect()


def value(x):
    return {"stringValue": x} if isinstance(x, str) else {"boolValue": x} if isinstance(x, bool) else {"intValue": str(x)}


def span(trace, start, name, status=None, events=None, **attributes):
    out = {"traceId": trace, "name": name, "startTimeUnixNano": str(start), "attributes": [{"key": k.replace("__", "."), "value": value(v)} for k, v in attributes.items()]}
    return out | ({"status": status} if status else {}) | ({"events": events} if events else {})


CALL = [{"id": "1", "function": {"name": "find", "arguments": '{"q": 1}'}}, {"id": "2", "name": "odd", "arguments": "[1]"}, {"function": {"name": "none"}}]


def otel_spans():
    asked = [{"role": "system", "content": "be kind"}, {"role": "user", "content": "buy"}]
    said = [{"role": "assistant", "content": [{"text": "a"}, {"content": "b"}, "c"], "tool_calls": CALL}, {"role": "critic", "content": "hm"}, {"role": "assistant", "content": ""}]
    return [
        span("t", 30, "tool.find", {"code": "STATUS_CODE_ERROR"}, tool__name="find", output__value="not there"),
        span("t", 10, "chat", gen_ai__operation__name="chat", gen_ai__input__messages=json.dumps(asked), gen_ai__output__messages=json.dumps(said), llm__tools=json.dumps([{"name": "find"}])),
        span("t", 40, "x", openinference__span__kind="LLM", **{"llm__input_messages__1__message__role": "user", "llm__input_messages__1__message__content": "second", "llm__input_messages__0__message__role": "system", "llm__input_messages__0__message__content": "again"}),
        span("t", 50, "y", gen_ai__request__model="m", events=[{"name": "gen_ai.user.message", "attributes": {"content": "third"}}, {"name": "gen_ai.choice", "attributes": {"content": '{"content": "done"}'}}, {"name": "other"}]),
        span("t", 60, "http get"),
        span("u", "2024-01-01T00:00:00Z", "execute_tool x", {"code": 2}),
    ]


OTEL = [
    (1, "system", None, "be kind"), (2, "user", None, "buy"), (3, "assistant", None, "a\nb\nc"), (4, "agent", None, "hm"), (5, "tool", "find", "not there"), (6, "user", None, "second"), (7, "user", None, "third"), (8, "assistant", None, "done"),
]


@pytest.mark.parametrize("shape", ["list", "envelope", "lines", "data"])
def test_otel(spark, tmp_path, shape):
    spans = otel_spans()
    if shape == "lines":
        path = write(tmp_path / "a.json", *spans, "", lines=True)
    else:
        path = write(tmp_path / "a.json", {"list": spans, "envelope": {"resourceSpans": [{"scopeSpans": [{"spans": spans[:2]}, {"spans": spans[2:]}]}]}, "data": {"data": spans}}[shape])
    trajectories, steps = load(spark, path, "otel")
    assert steps_of(steps, "t") == OTEL
    trace = trajectories.where("trajectory_id = 't'").first()
    assert (trace.instruction, trace.policy, trace.tool_schemas, trace.n_steps) == ("buy", "be kind", ['{"name": "find"}'], 8)
    tool = steps.where("role = 'tool'").collect()
    assert {(r.trajectory_id, r.result.name, r.result.is_error) for r in tool} == {("t", "find", True), ("u", "execute_tool x", False)}
    calls = steps.where("size(calls) > 0").first().calls
    assert [(c.id, c.name, c.arguments, c.parse_error) for c in calls] == [("1", "find", '{"q": 1}', None), ("2", "odd", "{}", "arguments are not a JSON object"), (None, "none", "{}", None)]


def test_line_files_are_split_and_keep_their_order(spark, tmp_path):
    """Equal starts: records stay in the order of the file, whichever task reads them."""
    spans = [span("t", 5, "chat", gen_ai__operation__name="chat", gen_ai__output__messages=json.dumps([{"role": "assistant", "content": f"line {i} {'x' * 200}"}])) for i in range(400)]
    path = write(tmp_path / "a.jsonl", *spans, lines=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        trajectories, steps = load(spark, path, "otel")
        got = steps_of(steps, "t")
        assert spark.read.text(path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x[3].split(" ")[1] for x in got] == [str(i) for i in range(400)] and trajectories.first().n_steps == 400


@pytest.mark.parametrize("adapter", ["otel", "langfuse", "langsmith"])
def test_large_files_of_lines_are_split_whatever_their_name(spark, tmp_path, adapter):
    """A file is read by lines if its first line is a document; one that is a single document stays whole."""

    def record(i):
        said = {"role": "assistant", "content": f"line {i} {'x' * 2000}"}
        return {
            "otel": span("t", 5, "chat", gen_ai__operation__name="chat", gen_ai__output__messages=json.dumps([said])),
            "langfuse": {"traceId": "t", "type": "GENERATION", "startTime": "5", "output": said},
            "langsmith": {"trace_id": "t", "run_type": "llm", "start_time": "5", "outputs": [said]},
        }[adapter]

    lines = [json.dumps(record(i)) for i in range(600)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "part-0.txt").write_text("\n \n" + "\n".join(lines))
    (tmp_path / "pretty.json").write_text("[\n" + ",\n".join(lines) + "\n]")
    (tmp_path / "one.json").write_text("\n[" + ", ".join(lines) + "]\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        wanted = [str(i) for i in range(600)]
        for name, by_lines in (("lines", True), ("pretty.json", False), ("one.json", False)):
            steps = load(spark, str(tmp_path / name), adapter)[1]
            got = [x[3].split(" ")[1] for x in steps_of(steps)]
            assert got == (wanted[::-1] if adapter == "langsmith" and not by_lines else wanted), name
        raw = read_payloads(spark, str(tmp_path / "lines"), lambda text, file: iter([{"trace": str(len(text)), "record_no": 0, "message_no": 0, "role": "user"}]))
        assert max(int(r.trace) for r in raw.collect()) < 5000  # no task was given the whole file
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("adapter", ["langsmith", "otel", "langfuse"])
def test_exports_are_parsed_and_exchanged_once(spark, tmp_path, adapter):
    """Neither table parses files twice (there is a way to read lines and one for whole files) or meets its trace twice."""
    path = write(tmp_path / "a.jsonl", {"trace_id": "t", "id": "t"}, lines=True)
    for table in load(spark, path, adapter):
        plan = plan_of(table)
        assert plan.count("MapInArrow") == 2 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_langsmith_leaves_out_whole_traces_of_unknown_roles(spark, tmp_path):
    """Whichever of a trace's messages has the role; its other runs and those without messages go too."""
    run = lambda trace, at, *roles: {"trace_id": trace, "run_type": "llm", "start_time": str(at), "inputs": [{"role": r, "content": f"{r} {at}"} for r in roles]}
    runs = [run("a", 2, "system", "user"), run("a", 1, "system", "human"), run("b", 1, "user"), run("b", 2, "wizard", "user"), run("b", 3), run("c", 1), run("d", 1, "wizard"), run("a", 3, "ai", "system")]
    trajectories, steps = load(spark, write(tmp_path / "a.jsonl", *runs, lines=True), "langsmith")
    assert {(r.trajectory_id, r.policy, r.instruction, r.n_steps) for r in trajectories.collect()} == {("a", "system 1", "human 1", 4), ("c", None, "", 0)}
    assert [x[:2] + x[3:] for x in steps_of(steps)] == [(1, "system", "system 1"), (2, "user", "human 1"), (3, "user", "user 2"), (4, "assistant", "ai 3")]


def test_otel_rows_that_only_name_a_trace_come_once(spark, tmp_path):
    """Spans without tools, and those without messages: a trace stays known, by a row for each batch at most."""
    spans = [span(f"t{i // 300}", i, "chat", gen_ai__operation__name="chat", gen_ai__output__messages=json.dumps([{"role": "assistant", "content": f"line {i}"}])) for i in range(600)]
    spans += [span("silent", 1, "other"), span("silent", 2, "other"), span("t0", 9, "other", llm__tools=json.dumps([{"name": "find"}]))]
    path = write(tmp_path / "a.jsonl", *spans, lines=True)
    rows = read_payloads(spark, path, otel.rows_of).where("kind = 'context'").collect()
    assert sorted((r.trace, r.tool_schemas) for r in rows if r.tool_schemas is None) == [("silent", None), ("t0", None), ("t1", None)]
    assert [(r.trace, r.tool_schemas, r.record_no) for r in rows if r.tool_schemas] == [("t0", ['{"name": "find"}'], max(r.record_no for r in rows))]
    trajectories, steps = load(spark, path, "otel")
    assert {(r.trajectory_id, r.n_steps, tuple(r.tool_schemas)) for r in trajectories.collect()} == {("t0", 300, ('{"name": "find"}',)), ("t1", 300, ()), ("silent", 0, ())}
    assert [x[3] for x in steps_of(steps)] == [f"line {i}" for i in range(600)]


def test_numbers_of_steps_need_no_steps(spark, tmp_path):
    """The traces of envelopes are counted without numbering their steps; of several system messages one counts."""
    said = lambda *roles: json.dumps([{"role": r, "content": r} for r in roles])
    traces = {"a": [("system", "user"), ("system", "assistant"), ("critic", "system")], "b": [("user", "user")], "c": [("system",)], "d": [()]}
    envelopes = [{"resourceSpans": [{"scopeSpans": [{"spans": [span(t, n, "chat", gen_ai__operation__name="chat", gen_ai__output__messages=said(*roles)) for n, roles in enumerate(spans)]}]}]} for t, spans in traces.items()]
    trajectories, steps = load(spark, write(tmp_path / "a.jsonl", *envelopes, lines=True), "otel")
    counted = {r.trajectory_id: r["count"] for r in steps.groupBy("trajectory_id").count().collect()}
    assert {r.trajectory_id: r.n_steps for r in trajectories.collect()} == counted | {"d": 0} == {"a": 4, "b": 2, "c": 1, "d": 0}
    assert "Window" not in plan_of(trajectories)


def test_otel_empty_and_broken(spark, tmp_path):
    assert load(spark, write(tmp_path / "e.json", "", lines=True), "otel")[1].count() == 0
    with pytest.raises(Exception, match="could not parse"):
        load(spark, write(tmp_path / "b.json", "{", "x", lines=True), "otel")[1].collect()


def test_langfuse(spark, tmp_path):
    observations = [
        {"type": "GENERATION", "name": "gpt", "startTime": "2024-01-02", "input": {"messages": [{"role": "system", "content": "policy"}, {"role": "user", "content": [{"text": "buy"}, None, {"text": ""}]}]}, "output": {"role": "assistant", "content": "ok", "tool_calls": CALL[:2]}},
        {"type": "SPAN", "name": "search_api", "start_time": "2024-01-03", "output": {"result": "rows"}, "level": "WARNING"},
        {"type": "SPAN", "name": "step", "startTime": "2024-01-01", "input": "plain"},
        {"type": "generation", "name": "late", "startTime": "2024-01-04", "input": [{"role": "system", "content": "twice"}, {"role": "boss", "content": "go"}], "output": "fine"},
        {"type": "SPAN", "name": "Tool X", "startTime": "2024-01-05", "output": "y", "statusMessage": "broke"},
    ]
    bare = {"traceId": "b", "type": "TOOL", "name": "z", "output": None}
    trace = {"id": "a", "name": "run", "input": "unused", "observations": observations}
    only = {"id": "c", "input": {"text": "fallback"}, "observations": []}
    trajectories, steps = load(spark, write(tmp_path / "l.json", {"data": [trace, [bare, only]]}), "langfuse")
    assert steps_of(steps, "a") == [
        (1, "system", None, "policy"), (2, "user", None, "buy\n"), (3, "assistant", "gpt", "ok"), (4, "tool", "search_api", "rows"), (5, "agent", None, "go"), (6, "assistant", "late", "fine"), (7, "tool", "Tool X", "y"),
    ]
    assert steps_of(steps, "b") == [(1, "tool", "z", "")]
    told = {r.trajectory_id: (r.instruction, r.policy, r.n_steps) for r in trajectories.collect()}
    assert told == {"a": ("buy\n", "policy", 7), "b": ("", None, 1), "c": ("fallback", None, 0)}
    assert [r.result.is_error for r in steps.where("trajectory_id = 'a' and role = 'tool'").orderBy("step_index").collect()] == [True, True]


def test_langsmith(spark, tmp_path):
    model = {
        "id": "r", "trace_id": "a", "run_type": "llm", "name": "m", "start_time": "1", "error": "boom",
        "inputs": {"messages": [[{"type": "human", "data": {"content": "buy"}}, {"id": ["x", "SystemMessage"], "kwargs": {"content": "policy"}}]]},
        "outputs": {"generations": [[{"message": {"role": "ai", "content": "ok", "tool_calls": [{"name": "f", "args": {"a": 1}}]}}, {"text": "more"}]]},
    }
    root = {"id": "root", "trace_id": "a", "run_type": "chain", "start_time": "0", "child_runs": [model, {"trace_id": "a", "run_type": "retriever", "name": "", "start_time": "2", "outputs": {"answer": "doc"}, "error": None}]}
    strange = {"trace_id": "s", "run_type": "llm", "start_time": "0", "inputs": [{"role": "wizard", "content": "x"}]}
    path = write(tmp_path / "s.json", {"runs": [root, strange]})
    trajectories, steps = load(spark, path, "langsmith")
    assert steps_of(steps) == [(1, "user", None, "buy"), (2, "system", None, "policy"), (3, "assistant", "m", "ok"), (4, "assistant", "m", "more"), (5, "tool", "m", "boom"), (6, "tool", "tool", "doc")]
    assert {(r.trajectory_id, r.instruction, r.policy) for r in trajectories.collect()} == {("a", "buy", "policy")}
    assert [tuple(r) for r in langsmith.quarantined(spark, path).collect()] == [("s", "wizard")]
    assert [x["id"] for x in langsmith.flatten([{"id": 1, "child_runs": [{"id": 2}, {"id": 3}]}, {"id": 4}])] == [4, 1, 3, 2]


def test_retail(spark, tmp_path):
    run = {
        "task_id": 7, "reward": 1, "trial": 0, "info": {"task": {"instruction": "buy", "user_id": "u", "actions": [{"name": "x"}]}},
        "traj": [
            {"role": "system", "content": "policy"}, {"role": "user", "content": "hi", "index": 2},
            {"role": "assistant", "content": None, "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": a}} for a in ('{"b": 2}', "", "{", "[1]")]},
            {"role": "tool", "name": "f", "tool_call_id": "1", "content": "  Error: nope"}, {"role": "tool", "content": "fine"},
        ],
    }
    trajectories, steps = load(spark, write(tmp_path / "t.json", [run]), "retail")
    assert steps_of(steps) == [(1, "system", None, "policy"), (2, "user", None, "hi"), (3, "assistant", "Assistant", ""), (4, "tool", "f", "  Error: nope"), (5, "tool", "Tool", "fine")]
    calls = steps.where("step_index = 3").first().calls
    assert [(c.arguments, c.raw_arguments, c.parse_error is not None) for c in calls] == [('{"b": 2}', None, False), ("{}", None, False), ("{}", "{", True), ('{"value": [1]}', "[1]", False)]
    assert [r.result.is_error for r in steps.where("role = 'tool'").orderBy("step_index").collect()] == [True, False]
    row = trajectories.first()
    assert (row.trajectory_id, row.policy, row.reward, row.user_id, row.n_steps) == ("7", "policy", 1.0, "u", 5)
    run["traj"][1]["index"] = 5
    with pytest.raises(Exception, match="disagrees with its position"):
        load(spark, write(tmp_path / "bad.json", {"k": run}), "retail")[1].collect()


def test_team(spark, tmp_path):
    write(tmp_path / "run-1.json", [{"role": "human", "content": "ask"}, {"role": "Orchestrator (thought)", "content": "plan"}, {"role": "", "content": None}])
    write(tmp_path / "note.json", {"not": "a list"})
    trajectories, steps = load(spark, str(tmp_path), "team")
    assert steps_of(steps, "run-1") == [(1, "user", "human", "ask"), (2, "agent", "Orchestrator (thought)", "plan"), (3, "agent", None, "")]
    assert [(r.trajectory_id, r.instruction) for r in trajectories.collect()] == [("run-1", "ask")]


def test_ground_truth_ids(spark, tmp_path):
    record = {"trajectory_id": 5, "failures": [{"failure_id": 1, "step_number": 3, "failure_category": "System Failure"}, {"failure_id": "2 ", "step_number": 9}], "root_cause": {"failure_id": " 1"}}
    for payload in ([record], {"x": record}):
        failures, roots = read_ground_truth(spark, write(tmp_path / "g.json", payload), "d")
        assert [(r.trajectory_id, r.pos, r.failure_id, r.step_number, r.category) for r in failures.orderBy("pos").collect()] == [("5", 0, "1", 3, "System Failure"), ("5", 1, "2", 9, "")]
        assert [(r.trajectory_id, r.root_failure_id) for r in roots.collect()] == [("5", "1")]


def test_unknown_adapter(spark):
    with pytest.raises(ValueError, match="unknown adapter"):
        load(spark, "x", "nope")
