"""Clients, tables, the command line and the stream."""

import json

import pytest

from failscope import cli
from failscope.operators import clients, tables
from failscope.streaming.verdicts import stream_verdicts

BROKEN = {"trajectory_id": "bad", "steps": [{"index": 1, "role": "user", "content": "x"}, {"index": 2, "role": "tool", "content": "", "tool_result": {"name": "f", "content": "Error: none"}}]}
FINE = {"trajectory_id": "good", "steps": [{"index": 1, "role": "user", "content": "x"}, {"index": 2, "role": "assistant", "content": "done"}]}


def test_retries():
    answers, pauses = [clients.TransportError("down"), (503, {}), (429, {}), (200, {"ok": 1})], []

    def send():
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert clients.with_retries(send, pause=pauses.append) == {"ok": 1} and pauses == [1.0, 2.0, 4.0]
    with pytest.raises(RuntimeError, match="status 400"):
        clients.with_retries(lambda: (400, {}), pause=pauses.append)
    pauses.clear()
    with pytest.raises(RuntimeError, match="after 14 attempts: status 500"):
        clients.with_retries(lambda: (500, {}), pause=pauses.append)
    assert pauses == [1.0, 2.0, 4.0, 8.0, 16.0] + [30.0] * 8


def test_chat_client():
    sent = []

    def post(url, payload, headers, timeout):
        sent.append((url, payload))
        return 200, {"choices": [{"message": {"content": "<think>x</think>{}"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}

    answer = clients.ChatClient("small", "http://h/v1/", post=post).complete("p", system="s", schema={"type": "object"})
    assert (answer.text, answer.prompt_tokens, answer.completion_tokens, answer.cost_usd) == ("{}", 5, 2, 0.0)
    assert sent[0][0] == "http://h/v1/chat/completions" and "response_format" in sent[0][1] and [m["role"] for m in sent[0][1]["messages"]] == ["system", "user"]
    clients.ChatClient("a-thinking-model", "http://h", post=post).complete("p", schema={})
    assert "response_format" not in sent[1][1]


def test_messages_client_and_tiers():
    sent = []

    def post(url, payload, headers, timeout):
        sent.append((url, payload, headers))
        stop = "refusal" if "harm" in payload["messages"][0]["content"] else "end_turn"
        return 200, {"model": payload["model"], "stop_reason": stop, "content": [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": "{"}, {"type": "text", "text": "}"}], "usage": {"input_tokens": 7, "output_tokens": 3}}

    client = clients.build_client("frontier", "big", api_key="k", post=post)
    answer = client.complete("p", system="s", schema={"type": "object"}, max_tokens=9)
    assert (answer.text, answer.model, answer.prompt_tokens, answer.completion_tokens) == ("{}", "big", 7, 3)
    url, payload, headers = sent[0]
    assert url.endswith("/v1/messages") and headers["x-api-key"] == "k" and payload["system"] == "s" and payload["max_tokens"] == 9 and payload["output_config"]["format"]["schema"] == {"type": "object"}
    assert not {"temperature", "top_p"} & payload.keys() and client.complete("harm").text == ""
    small = clients.build_client("small", "some-thinking-model", base_url="http://h")
    assert isinstance(small, clients.ChatClient) and small.structured is False
    with pytest.raises(ValueError, match="unknown tier"):
        clients.build_client("huge")


TRUTH = [{"trajectory_id": "bad", "failures": [{"failure_id": 1, "step_number": 2, "failure_category": "System Failure"}], "root_cause": {"failure_id": 1}}]


def test_bench_resumes(spark, tmp_path, capsys):
    traces, truth, out = tmp_path / "t.jsonl", tmp_path / "g.json", tmp_path / "out"
    traces.write_text("\n".join(map(json.dumps, (BROKEN, FINE))))
    truth.write_text(json.dumps(TRUTH))
    run = ["bench", str(traces), str(truth), "--system", "signals-only", "--out", str(out)]
    assert cli.main(run, spark) == 0
    said = capsys.readouterr().out
    assert "signals-only" in said and "recall" in said
    part = next((out / "system=signals-only" / "repeat=0").glob("*.json"))
    before = part.stat().st_mtime_ns
    assert cli.main([*run, "--repeats", "2"], spark) == 0  # what is there is not run again
    assert part.stat().st_mtime_ns == before and (out / "system=signals-only" / "repeat=1" / "_SUCCESS").exists()
    capsys.readouterr()
    assert cli.main([*run[:-2], "--detection-only"], spark) == 0 and "signals-only" not in capsys.readouterr().out
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.startswith("failscope ")


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "t.jsonl"
    path.write_text("\n".join(map(json.dumps, (BROKEN, FINE))))
    assert cli.main(["detect", str(path)], spark) == 0
    said = capsys.readouterr().out
    assert "FAILED   0.708" in said and said.endswith("1/2 trajectories look failed\n")
    assert cli.main(["analyze", str(path)], spark) == 2
    assert cli.main(["analyze", str(path), "--system", "signals-only", "--json"], spark) == 0
    reports = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [r["critical_step"] for r in reports] == [2]
    empty = tmp_path / "e.jsonl"
    empty.write_text("")
    assert cli.main(["detect", str(empty)], spark) == 1


def test_report(spark, tmp_path, capsys):
    rows = [("d1", "a", 10, 0, 0.5, 0.1, 0.6, 0.1), ("d2", "a", 30, 0, 0.1, 0.0, 0.2, 0.1), ("d1", "b", 10, 2, 0.9, 0.0, 0.9, 0.9), ("d2", "b", 30, 0, 0.2, 0.0, None, 0.3)]
    table = spark.createDataFrame(rows, "domain string, system string, n long, err long, exact double, exact_std double, pm5 double, root_cause_cat double")
    tables.write_results(table, str(tmp_path / "r"))
    assert cli.main(["report", str(tmp_path / "r"), "--compare", str(tmp_path / "r")], spark) == 0
    said = capsys.readouterr().out
    assert "Not results" in said and "a       40  0.200  0.300  0.100           0.025" in said and "Not pooled" in said and "delta" in said


def test_limit_and_detect_first(spark):
    traces = spark.createDataFrame([(str(i), str(i), f"d{i % 2}") for i in range(6)], "traj_key string, trajectory_id string, domain string")
    truth = spark.createDataFrame([(str(i), 5 - i) for i in range(6)], "trajectory_id string, pos int")
    assert sorted(r.traj_key for r in tables.limit_by_domain(traces, truth, 2).collect()) == ["2", "3", "4", "5"]
    verdicts = spark.createDataFrame([("1", True), ("2", False)], "traj_key string, failed boolean")
    assert [r.traj_key for r in tables.failed_only(traces, verdicts).collect()] == ["1"]


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for n, lines in enumerate(([json.dumps(BROKEN), json.dumps(FINE | {"trajectory_id": "bad"}), "{no json"], [json.dumps(FINE)])):
        (source / f"{n}.json").write_text("\n".join(lines))
        stream_verdicts(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.trajectory_id, r.failed, r.batch) for r in rows) == [("bad", False, 0), ("bad", True, 0), ("good", False, 1)]
    assert [r.value for r in spark.read.text(str(tmp_path / "out-unreadable")).collect()] == ["{no json"]
