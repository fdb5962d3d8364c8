"""Signals, constraints, detection, calibration, localization, judge and scoring on small traces."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from failscope.functions import coercion, json_tools, taxonomy
from failscope.functions.text import around, clip, clip_block, general
from failscope.operators import calibrate, constraints, detect, judge, localize, model, scoring, signals
from failscope.schema import STEPS


def call(name, error=None, **arguments):
    return {"id": None, "name": name, "arguments": json.dumps(arguments), "args_key": json_tools.canonical(arguments), "raw_arguments": None, "parse_error": error}


def step(role="assistant", content="", calls=(), result=None, agent=None, is_error=False, tool="t"):
    told = None if result is None else {"call_id": None, "name": tool, "content": result, "is_error": is_error}
    return {"role": role, "content": content, "calls": list(calls), "result": told, "agent": agent}


def steps_of(spark, **traces):
    rows = [{"traj_key": k, "trajectory_id": k, "step_index": i, **s} for k, steps in traces.items() for i, s in enumerate(steps, 1)]
    return spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in ("traj_key", "trajectory_id", "step_index", "role", "agent", "content", "calls", "result")) for r in rows], STEPS)


def found(steps, *battery, **kinds):
    return sorted((r.traj_key, r.step_index, r.kind, round(r.severity, 6)) for r in signals.run_signals(steps, list(battery) or None).collect())


TOOL = step("tool", "", result="fine")


def test_tool_errors(spark):
    steps = steps_of(spark, a=[step("tool", result=x) for x in ("Error: x", "all good", "I cannot\rever find it", "cannot\nfind", "x" * 400 + " timeout", "NOT FOUND", "ok")] + [step("tool", result="fine", is_error=True), step("assistant", "Error: x")])
    assert [e[1] for e in found(steps, ("e", signals.tool_error))] == [1, 3, 6, 8]
    told = signals.run_signals(steps, [("e", signals.tool_error)]).where("step_index = 1").first().evidence
    assert told == "tool t returned an error: Error: x"


def test_calls_without_schema_or_json(spark):
    steps = steps_of(spark, a=[step(calls=[call("f", "bad"), call("g", ""), call("h", "worse")])], b=[step(calls=[call("f")])])
    assert [e[1:] for e in found(steps, ("m", signals.malformed_arguments))] == [(1, "malformed_arguments", 0.8)] * 2
    assert found(steps, ("u", signals.unknown_tool)) == []
    declared = steps.withColumn("tool_schemas", F.when(F.col("traj_key") == "a", F.array(F.lit('{"function": {"name": "f"}}'), F.lit('{"name": "g", "parameters": {}}'), F.lit('{"name": 5}'))).otherwise(F.array().cast("array<string>")))
    assert found(declared, ("u", signals.unknown_tool)) == [("a", 1, "unknown_tool", 0.9)]


def test_argument_schema(spark):
    schema = {"name": "f", "parameters": {}, "input_schema": {"properties": {"a": {}, "b": {}}, "required": ["a", "c"]}}
    steps = steps_of(spark, a=[step(calls=[call("f", b=1, z=2), call("f", a=1, c=2), call("other", q=1)])]).withColumn("tool_schemas", F.array(F.lit('{"name": "f"}'), F.lit(json.dumps(schema))))
    rows = signals.run_signals(steps, [("s", signals.argument_schema)]).orderBy("emit_ord").collect()
    assert [(round(r.severity, 2), r.evidence) for r in rows] == [(0.75, "f missing required argument(s): a, c"), (0.4, "f passed undeclared argument(s): z"), (0.4, "f passed undeclared argument(s): c")]


def test_repeats_and_oscillation(spark):
    a, b = call("a", x=1), call("b", x=1)
    steps = steps_of(spark, r=[step(calls=[a])] * 3 + [step(calls=[call("a", x=1.0)])] + [step(calls=[a])] * 5, o=[step(calls=[c]) for c in (a, b, a, b, a, b, a, b, a)], p=[step(calls=[a]), step("user"), step(calls=[b]), step(calls=[a]), step(calls=[b]), step(calls=[a]), step(calls=[a])])
    repeats = [e for e in found(steps, ("r", signals.repeated_call)) if e[0] == "r"]
    assert [(e[1], e[3]) for e in repeats] == [(i, 0.85) for i in (2, 3, 5, 6, 7, 8, 9)]
    assert [(e[0], e[1]) for e in found(steps, ("o", signals.oscillation))] == [("o", 1), ("o", 5), ("p", 1)]
    told = signals.run_signals(steps, [("o", signals.oscillation)]).where("traj_key = 'p'").first().evidence
    assert told == 'alternates between a({"x": 1}) and b({"x": 1}) across steps 1-5 without resolving'


def greedy(keys):
    out, i = [], 0
    while i + 3 < len(keys):
        a, b, c, d = keys[i : i + 4]
        if a == c and b == d and a != b:
            out.append(i)
            i += 4
        else:
            i += 1
    return out


def test_oscillation_on_random_traces(spark):
    rng = random.Random(1)
    traces = {f"t{k}": [rng.choice("ab") for _ in range(rng.randrange(1, 25))] for k in range(80)}
    steps = steps_of(spark, **{k: [step(calls=[call(c)]) for c in v] for k, v in traces.items()})
    assert [(e[0], e[1] - 1) for e in found(steps, ("o", signals.oscillation))] == sorted((k, i) for k, v in traces.items() for i in greedy(v))


def test_runs(spark):
    thought = step("agent", "hm", agent="Orchestrator (Thought)")
    quiet = [thought] * 6
    steps = steps_of(spark, a=[step("user", "x"), *quiet, step("assistant", "hi"), *quiet, thought], b=[step("system")] * 7, c=[TOOL] * 5 + [step("user", "u"), step("assistant", " ")] + [TOOL] * 5 + [step("assistant", "done")] + [TOOL] * 9)
    assert found(steps, ("n", signals.no_progress)) == [("a", 2, "no_progress", 0.2), ("a", 9, "no_progress", 0.25), ("b", 1, "no_progress", 0.25)]
    assert found(steps, ("s", signals.stall)) == [("c", 1, "stall", 0.2)]


def test_endings(spark):
    many = [step("user", "x")] * 8
    steps = steps_of(
        spark, a=[*many, step("assistant", "I'm sorry, but I can't"), step("assistant", "Unfortunately, HTTP 500"), step("tool", "ValueError: x", result="unfortunately")], b=[step("assistant", "unable to help"), *many], c=[step("system", "failed to"), step("user", "giving up"), step("assistant", calls=[call("f")])]
    )
    assert found(steps, ("r", signals.refusal)) == [("a", 9, "refusal", 0.7)]
    assert found(steps, ("i", signals.incomplete_outcome)) == [("a", 10, "incomplete_outcome", 0.5), ("a", 10, "leaked_error", 0.6), ("a", 11, "leaked_error", 0.6), ("a", 11, "truncated_run", 0.45), ("c", 3, "truncated_run", 0.45)]


def test_budget(spark):
    steps = steps_of(spark, a=[step("user", "x")] * 90, b=[step("user", "x")] * 10, c=[step("user", "x")] * 10)
    assert found(steps, ("b", signals.budget_anomaly)) == [("a", 90, "budget_anomaly", 0.25)]
    assert found(steps, ("b", lambda s: signals.budget_anomaly(s, signals.CorpusStats(10, 20)))) == [("a", 90, "budget_anomaly", 0.4)]
    assert found(steps, ("b", lambda s: signals.budget_anomaly(s, signals.CorpusStats(10, 0)))) == [("a", 90, "budget_anomaly", 0.25)]
    row = signals.corpus_stats(steps).first()
    assert (round(row.mean_steps, 6), round(row.std_steps, 6)) == (round(110 / 3, 6), round(math.sqrt(((90 - 110 / 3) ** 2 + 2 * (10 - 110 / 3) ** 2) / 3), 6))
    assert signals.corpus_stats(steps.where("false")).first().mean_steps == 0


def test_a_broken_signal_is_isolated(spark):
    steps = steps_of(spark, a=[step("tool", result="Error: x")], b=[step()])

    def broken(s):
        raise RuntimeError("no such thing")

    got = found(steps, ("bad", broken), ("column", lambda s: (s, F.array(F.col("missing")))), ("e", signals.tool_error))
    assert got == [("a", 1, "signal_error", 0.0)] * 2 + [("a", 1, "tool_error", 0.6)] + [("b", 1, "signal_error", 0.0)] * 2
    own = signals.with_own_signals(steps, [lambda s: s.select("traj_key", "step_index", F.lit("mine").alias("kind"), F.lit(0.1).alias("severity"), F.lit("x").alias("evidence"))], [("e", signals.tool_error)])
    assert sorted(r.kind for r in own.collect()) == ["mine", "mine", "tool_error"]


def demo(spark):
    find = call("get_order", order_id="A")
    return steps_of(
        spark,
        healthy=[step("user", "refund"), step(calls=[find]), step("tool", result='{"order_id": "A", "total": 20}', tool="get_order"), step("assistant", "Done.")],
        loop=[step("user", "x"), step(calls=[find]), step("tool", result="Error: order not found"), step(calls=[find]), step("tool", result="Error: order not found"), step("assistant", "I am unable to complete this")],
        policy=[step("user", "x"), step(calls=[find]), step("tool", result='{"order_id": "A", "total": 20}', tool="get_order"), step(calls=[call("refund", order_id="A", amount=200)]), step("tool", result="ok"), step("assistant", "All set")],
        unknown=[step("user", "x"), step(calls=[call("teleport")]), step("tool", result="Error: no such tool"), step("assistant", "Unfortunately I was unable to do it")],
    )


def test_demo_confidences(spark):
    steps = demo(spark).withColumn("tool_schemas", F.array(F.lit('{"name": "get_order"}'), F.lit('{"name": "refund"}')))
    events = signals.run_signals(steps)
    rows = {r.traj_key: (round(r.confidence, 4), r.failed) for r in detect.verdicts(steps, events).collect()}
    assert rows == {"healthy": (0.0, False), "loop": (0.907, True), "policy": (0.0, False), "unknown": (0.994, True)}
    rule = constraints.latest_bound("refund_within_total", "d", "refund", "amount", "get_order", "total", "order_id")
    broken = constraints.constraint_events(steps, [rule])
    assert [(r.traj_key, r.step_index, r.evidence) for r in broken.collect()] == [("policy", 4, "refund_within_total: refunded 200.00 against order A whose reported total is 20.00")]
    more = events.unionByName(broken.withColumn("signal_ord", F.lit(99)).withColumn("emit_ord", F.lit(0)), allowMissingColumns=True)
    assert {r.traj_key: round(r.confidence, 3) for r in detect.verdicts(steps, more).collect()}["policy"] == 0.9
    text = {r.traj_key: r.text for r in detect.explain(detect.verdicts(steps, events), events, 2).collect()}
    assert text["healthy"] == "no signals fired" and text["unknown"].startswith("FAILED (confidence 0.99)\n  step 2: [unknown_tool] called undeclared tool 'teleport'\n")


def test_repeats_do_not_saturate(spark):
    events = spark.createDataFrame([("a", "repeated_call", 0.85)] * 50 + [("b", "x", 1.5), ("c", "signal_error", 0.0), ("d", "x", -1.0)], "traj_key string, kind string, severity double")
    assert {r.traj_key: round(r.confidence, 6) for r in detect.confidences(events).collect()} == {"a": 0.425, "b": 1.0, "c": 0.0, "d": 0.0}
    assert {r.traj_key: round(r.confidence, 6) for r in detect.confidences(events, {"repeated_call": 1.0}).collect()}["a"] == 0.85


def test_constraint_rules(spark):
    steps = steps_of(spark, a=[step(calls=[call("pay"), call("login"), call("pay")]), step(calls=[call("pay", n="1_000")])], b=[step(content="bad", calls=[call("pay", n="1d"), call("pay", n=5.5), call("pay", n="nan"), call("pay", n=-3)])])
    rows = lambda *c: sorted((r.traj_key, r.step_index, r.evidence) for r in constraints.constraint_events(steps, c).collect())
    assert rows(constraints.require_before("r", "", "login", "pay")) == [("a", 1, "r: called 'pay' before any call to 'login'")] + [("b", 1, "r: called 'pay' before any call to 'login'")] * 4
    assert rows(constraints.require_before("r", "", "pay", "pay")) == []
    assert rows(constraints.numeric_bound("n", "", "pay", "n", maximum=5, minimum=0)) == [("a", 2, "n: pay.n = 1000 exceeds the maximum of 5"), ("b", 1, "n: pay.n = -3 is below the minimum of 0"), ("b", 1, "n: pay.n = 5.5 exceeds the maximum of 5")]
    assert rows(constraints.step_constraint("s", "", F.when(F.col("content") == "bad", F.lit("said bad")))) == [("b", 1, "s: said bad")]

    def check(trace):
        if trace[0]["traj_key"] == "b":
            raise KeyError("b")
        return [(s["step_index"], "seen") for s in trace]

    got = sorted((r.traj_key, r.kind, r.severity) for r in constraints.constraint_events(steps, [constraints.python_constraint("p", "", check, 0.3)]).collect())
    assert got == [("a", "constraint_violation", 0.3)] * 2 + [("b", "signal_error", 0.0)]
    assert constraints.constraint_events(steps, []).collect() == []


def test_synthesised_rules(spark):
    spec = json.dumps({"constraints": [{"name": "a", "kind": "require_before", "params": {"prerequisite": "x", "dependent": "y"}}, {"kind": "numeric_bound", "params": {"tool": "t", "argument": "n", "maximum": "7"}}, {"kind": "other"}, "junk", {"kind": "numeric_bound", "params": {}}]})
    assert [c.name for c in constraints.constraints_from_spec(f"sure:\n```json\n{spec}\n```")] == ["a", "synthesized"]
    assert constraints.constraints_from_spec("no json") == []
    schemas = ['{"name": "b", "x": 1}', '{"name": "a"}']
    traces = spark.createDataFrame([("1", schemas, " p "), ("2", schemas[::-1], "p"), ("3", [], "p"), ("4", schemas, None)], "traj_key string, tool_schemas array<string>, policy string")
    keys = {r.traj_key: r.fingerprint for r in constraints.schema_fingerprints(traces).collect()}
    assert keys["1"] == keys["2"] != keys["4"] and set(keys) == {"1", "2", "4"} and len(keys["1"]) == 16
    asked = constraints.synthesised_rules(traces, lambda: judge.ScriptedClient([spec])).collect()
    assert {r.fingerprint for r in asked} == set(keys.values()) and all(r.spec == spec for r in asked)


def test_calibration(spark):
    labels = spark.createDataFrame([(str(i), i < 4, i) for i in range(10)], "traj_key string, label boolean, pos int")
    events = spark.createDataFrame([(str(i), "x", 0.1) for i in (0, 1, 2, 5)] + [("0", "x", 0.2), ("9", "y", 0.3)], "traj_key string, kind string, severity double")
    weights, bias = calibrate.fit(labels, events)
    table = {r.kind: r.log_ratio for r in weights.collect()}
    assert table["x"] == pytest.approx(math.log((4 / 6) / (2 / 8))) and table["y"] == pytest.approx(math.log((1 / 6) / (2 / 8)))
    assert bias.first().bias == pytest.approx(math.log(4 / 6))
    got = {r.traj_key: r.confidence for r in calibrate.scores(labels, events, weights, bias).collect()}
    assert got["3"] == pytest.approx(0.4) and got["0"] == pytest.approx(1 / (1 + math.exp(-math.log(4 / 6) - table["x"])))
    assert [r.kind for r in calibrate.top_weights(weights, 1).collect()] == ["x"]
    with pytest.raises(Exception, match="at least one failed"):
        calibrate.fit(labels.where("label"), events)[0].collect()


def plain_cross_validation(labels, kinds, folds=5, smoothing=1.0):
    folds = max(2, min(folds, sum(labels), len(labels) - sum(labels)))
    fold = {}
    for wanted in (True, False):
        for place, i in enumerate(i for i, y in enumerate(labels) if y == wanted):
            fold[i] = place % folds
    counts = {"tp": 0, "fp": 0, "tn": 0, "fn": 0}
    for f in range(folds):
        train = [i for i in range(len(labels)) if fold[i] != f]
        p, n = sum(labels[i] for i in train), sum(not labels[i] for i in train)
        if not p or not n:
            continue
        ratios = {}
        for kind in {k for i in train for k in kinds[i]}:
            a, b = (sum(kind in kinds[i] and labels[i] == y for i in train) for y in (True, False))
            ratios[kind] = math.log(((a + smoothing) / (p + 2 * smoothing)) / ((b + smoothing) / (n + 2 * smoothing)))
        for i in (i for i in range(len(labels)) if fold[i] == f):
            said = 1 / (1 + math.exp(-math.log(p / n) - sum(ratios.get(k, 0) for k in kinds[i]))) >= 0.5
            counts[("t" if said == labels[i] else "f") + ("p" if said else "n")] += 1
    return counts, folds


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_cross_validation(spark, seed):
    rng = random.Random(seed)
    labels = [rng.random() < 0.3 for _ in range(40)] + [True, True, False, False]
    kinds = [{k for k in "abcde" if rng.random() < (0.5 if y else 0.2)} | ({"rare"} if i == 7 else set()) for i, y in enumerate(labels)]
    table = spark.createDataFrame([(str(i), y, i) for i, y in enumerate(labels)], "traj_key string, label boolean, pos int")
    events = spark.createDataFrame([(str(i), k, 0.5) for i, own in enumerate(kinds) for k in own], "traj_key string, kind string, severity double")
    counts, folds = plain_cross_validation(labels, kinds)
    row = calibrate.cross_validate(table, events).first()
    share = lambda a, b: counts[a] / (counts[a] + counts[b]) if counts[a] + counts[b] else 0.0
    assert (row.recall, row.false_positive_rate, row.precision, row.folds) == (pytest.approx(share("tp", "fn")), pytest.approx(share("fp", "tn")), pytest.approx(share("tp", "fp")), folds)


def plain_windows(scores, n, back, forward, most):
    taken, claimed = [], set()
    for index, score in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if len(taken) >= most:
            break
        if score <= 0 or index in claimed:
            continue
        span = [i for i in range(max(1, index - back), min(n, index + forward) + 1)]
        while span and span[0] in claimed:
            span.pop(0)
        while span and span[-1] in claimed:
            span.pop()
        if span:
            claimed |= set(span)
            taken.append((span[0], span[-1], index))
    return sorted(taken) if taken else [(max(1, n - back - forward), n, n)]


@pytest.mark.parametrize(("back", "forward"), [(8, 2), (3, 3), (1, 0)])
def test_windows_on_random_scores(spark, back, forward):
    rng = random.Random(back)
    traces = {k: {i: rng.choice([0, 0, 1, 2, 3, 4.5]) for i in range(1, rng.randrange(1, 40) + 1)} for k in range(150)}
    rows = [(k, i, len(s), float(v)) for k, s in traces.items() for i, v in s.items()]
    scores = spark.createDataFrame(rows, "traj_key long, step_index int, n_steps int, score double")
    chosen = localize.EvidenceFilter(look_back=back, look_forward=forward)
    got = {r.traj_key: [(w.start, w.end, w.peak) for w in r.windows] for r in localize.window_arrays(scores, chosen).collect()}
    assert got == {k: plain_windows(s, len(s), back, forward, 5) for k, s in traces.items()}


def test_scores_and_prior(spark):
    steps = steps_of(spark, a=[step("user", "x")] * 6, b=[step("user", "x")] * 4, c=[step("agent", agent="a thought")])
    events = spark.createDataFrame([("a", 3, "x", 0.4), ("a", 3, "y", 0.2), ("c", 1, "x", 0.4), ("a", 9, "x", 1.0)], "traj_key string, step_index int, kind string, severity double")
    scores = {(r.traj_key, r.step_index): r.score for r in localize.score_steps(steps, events).collect()}
    for i in range(1, 7):
        assert scores["a", i] == pytest.approx(0.6 * 0.5 ** abs(i - 3) * (1 + 0.15 * (1 - (i - 1) / 5)))
    assert scores["c", 1] == pytest.approx(0.2) and scores["b", 2] == 0
    best = {r.traj_key: (r.step, round(r.confidence, 6)) for r in localize.prior(localize.score_steps(steps, events)).collect()}
    assert best == {"a": (3, round(scores["a", 3] / sum(scores["a", i] for i in range(1, 7)), 6)), "b": (4, 0.0), "c": (1, 1.0)}
    assert localize.EvidenceFilter(radius=3).reach == localize.EvidenceFilter(radius=3).back == 3


def test_window_text(spark):
    steps = demo(spark).where("traj_key = 'loop'")
    events = signals.run_signals(steps)
    spans = localize.windows(localize.score_steps(steps, events), localize.EvidenceFilter(look_back=1, look_forward=0, max_windows=1))
    text = localize.render_windows(steps, events, spans).first().text
    lines = text.split("\n")
    assert lines[0] == "… 3 step(s) omitted …" and lines[1].startswith("--- steps 4-5 (suspicion ") and lines[2] == '[4] assistant: -> get_order({"order_id":"A"})' and lines[3] == "[5] tool: <- Error: order not found"
    assert lines[4] == "signals:" and lines[5].startswith("  ! step 4 [repeated_call]") and lines[6].startswith("  ! step 5 [tool_error]") and lines[-1] == "… 1 step(s) omitted …"
    assert model.render(steps, 5, 6).first().text == "[5] tool: <- Error: order not found\n[6] assistant: I am unable to complete this"


def tasks(spark, steps, policy="p"):
    return steps.select("traj_key").distinct().withColumn("instruction", F.lit(" do it ")).withColumn("policy", F.lit(policy))


def test_prompts(spark):
    steps = demo(spark)
    events = signals.run_signals(steps)
    for system in judge.SYSTEMS.values():
        if not system.uses_model:
            continue
        rows = {r.traj_key: r for r in judge.prompts(tasks(spark, steps, "x" * 2100), steps, events, system).collect()}
        text = rows["loop"].prompt
        assert text.startswith("## Task\ndo it\n\n## Domain policy (excerpt)\n" + "x" * 2000 + "\n… (truncated)\n\n")
        assert ("## Violation log" in text) == system.violations and "## Violation log" not in rows["healthy"].prompt
        assert ("## Evidence (excerpt)" in text) == system.filtered and ("## Trajectory (6 steps)" in text) != system.filtered
        assert text.count("## Failure taxonomy") == 1 and "10. Inconclusive — " in text
        assert rows["loop"].steps_total == 6 and rows["loop"].steps_shown == 6


def test_violation_log_is_capped(spark):
    events = spark.createDataFrame([("a", i, "k", i / 100, "e", 0, 0) for i in range(1, 51)], "traj_key string, step_index int, kind string, severity double, evidence string, signal_ord int, emit_ord int")
    lines = judge.violation_log(events).first().log.split("\n")
    assert len(lines) == 41 and lines[0] == "- step 11 [k, severity 0.11] e" and lines[-1] == "- … 10 weaker signal(s) omitted"


@pytest.mark.parametrize(
    ("answers", "wanted"),
    [
        (['{"critical_step": 3, "category": 9, "cause": "c", "confidence": 2}'], (3, 9, "c", 1.0, 0, False)),
        (["<think>{\"critical_step\": 1}</think> so ```json\n{\"critical_step\": \"2\", \"category\": \"invalid invocation\"}\n```"], (2, 3, "", 0.0, 0, False)),
        (["nope", "still", '{"critical_step": 0, "category": true, "confidence": "0.25"}'], (1, 10, "", 0.25, 2, False)),
        (["nope"], (3, 10, "", 0.0, 3, True)),
        (['{"critical_step": null, "category": "4"}'], (3, 4, "", 0.0, 0, False)),
        (['[1, 2]'], (3, 10, "", 0.0, 0, False)),
    ],
)
def test_reports(spark, answers, wanted):
    steps = demo(spark).where("traj_key = 'loop'")
    events = signals.run_signals(steps)
    prior = localize.prior(localize.score_steps(steps, events)).first().step
    found_ = judge.diagnose(tasks(spark, steps), steps, events, judge.SYSTEMS["filtered-log"], lambda: judge.ScriptedClient(answers), "x").collect()
    (row,) = found_
    wanted = (prior if answers[-1] in ("nope", "[1, 2]") or "null" in answers[-1] else wanted[0], *wanted[1:])
    assert (row.critical_step, row.category_case, row.cause, row.confidence, row.repairs, row.degraded) == wanted
    assert row.prompt_tokens > 0 and row.tier == "x" and row.compression == 1.0


def test_signals_only_and_rendering(spark):
    steps = demo(spark)
    events = signals.run_signals(steps)
    reports = judge.diagnose(tasks(spark, steps), steps, events, judge.SYSTEMS["signals-only"])
    rows = {r.traj_key: r for r in reports.collect()}
    assert rows["healthy"].critical_step == 4 and rows["loop"].category == "Inconclusive" and rows["loop"].steps_shown == 0
    text = {r.traj_key: r.text for r in judge.render_reports(reports, events).collect()}["loop"]
    assert text.startswith("trajectory loop\n  critical step : ") and "  signals:\n    step " in text and text.endswith("  cost          : $0.0000 (0+0 tok, 0.0s)")
    assert json.loads(judge.as_json(reports).first().json)["model"] == "none"
    with pytest.raises(ValueError, match="needs a client"):
        judge.diagnose(tasks(spark, steps), steps, events, judge.SYSTEMS["naive-full"])
    with pytest.raises(ValueError, match="empty"):
        judge.ScriptedClient([]).complete("x")


def test_json_in_answers():
    assert json_tools.object_in(' {"a": 1} ') == {"a": 1}
    assert json_tools.object_in('x {"a": "}\\"{"} y {"b": 2}') == {"a": '}"{'}
    for text in ("", "none", "{", '{"a": }', None):
        with pytest.raises(ValueError):
            json_tools.object_in(text)
    split = json_tools.split_reasoning
    assert split("<think>a</think> b") == ("b", "<think>a</think>") and split("a</THINK>b") == ("b", "a</THINK>")
    assert split("x <think> cut") == ("", "x <think> cut") and split(" x ") == ("x", "") and split(None) == ("", "")


def one(spark, expression, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text_functions(spark):
    assert one(spark, lambda c: clip(c, 5), " a\t\n b ", "abcdefg", "abcde") == ["a b", "abcd…", "abcde"]
    assert one(spark, lambda c: clip_block(c, 3), " ab ", "abcd") == ["ab", "abc\n… (truncated)"]
    assert one(spark, lambda c: around(c, "(?i)HIT", 6), "123456 hit 654321", "hit") == ["56 hit 65", "hit"]
    assert one(spark, general, 1000000.0, 0.0001, 0.00001, 2.5, 100.0, 123456.0, 1234567.0, 0.0, -3.0, 1 / 3, kind="double") == ["1e+06", "0.0001", "1e-05", "2.5", "100", "123456", "1.23457e+06", "0", "-3", "0.333333"]


def test_taxonomy(spark):
    names = ["Instruction/Plan Adherence Failure", "new information", "Intent Not Supported", "User intent", "handoff", " odd ", "", None, "user intent not clear", "Guardrail"]
    assert one(spark, taxonomy.normalize_category, *names) == ["Instruction Adherence Failure", "Invention of New Information", "Intent Not Supported", "Underspecified User Intent", "Misinterpretation of Tool Output", "odd", "Unknown", "Unknown", "user intent not clear", "Guardrails Triggered"]
    assert one(spark, taxonomy.failure_case, "3", "11", "FailureCase.SYSTEM_FAILURE", "instruction-plan adherence failure", "x", "99999999999999") == [3, 10, 9, 1, 10, 10]
    assert one(spark, taxonomy.category_case, "system failure", "4", None) == [9, 4, 10]
    assert taxonomy.dimension(spark).count() == 10 and taxonomy.checklist().count("\n") == 9


def test_coercion(spark):
    step_ = lambda c: coercion.coerce_step(c, F.lit(7))
    assert one(spark, step_, "3", "0", "99", "4.7", '"5"', '"4.7"', "null", '"x"', None, "true") == [3, 1, 7, 4, 5, None, None, None, None, 1]
    assert one(spark, lambda c: coercion.coerce_step(c, F.lit(0)), "3") == [None]
    assert one(spark, coercion.coerce_category, "4", "0", '"4"', '"system failure"', "true", "2.5", None) == [4, 10, 4, 9, 10, 10, 10]
    assert one(spark, coercion.coerce_confidence, "0.5", "2", "-1", '"0.25"', '"x"', None, "[1]") == [0.5, 1.0, 0.0, 0.25, 0.0, 0.0, 0.0]
    assert one(spark, coercion.to_float, "1_000", "1d", " 2.5 ", "1e3", "0x1", "", ".5", "5.") == [1000.0, None, 2.5, 1000.0, None, None, 0.5, 5.0]


def test_scoring_without_root_cause_and_errors(spark):
    failures = spark.createDataFrame([("a", 0, "1", 5, "System Failure"), ("a", 1, "2", 2, "Invalid Invocation"), ("b", 0, "1", 1, "x"), ("a", 2, "2", 9, "Inconclusive")], "trajectory_id string, pos int, failure_id string, step_number int, category string")
    roots = spark.createDataFrame([(" a", " 2"), ("b", None), ("c", "1")], "trajectory_id string, root_failure_id string")
    truth = {r.trajectory_id: tuple(r)[1:] for r in scoring.ground_truth(failures, roots).collect()}
    assert truth == {"a": (2, 3, 3, 10, [3, 9, 10]), "b": (None, None, 10, 10, [10]), "c": (None, None, None, None, [])}
    predictions = spark.createDataFrame(
        [("a", 4, "3", [(1, 2)], None), ("b", 1, "2", [], "boom"), ("zz", 1, None, [], None)], "trajectory_id string, step int, category string, windows array<struct<start: int, end: int>>, error string"
    ).selectExpr("*", "0.5D as cost_usd", "10L as prompt_tokens", "2L as completion_tokens", "1D as latency_s")
    row = scoring.score(scoring.records(predictions, scoring.ground_truth(failures, roots))).first()
    assert (row.n_scored, row.n_missing_root_cause, row.n_errors, row.within_1, row.within_2, row.attr_root_cause, row.attr_terminal, row.mean_step_distance, row.window_recall, row.cost_usd) == (1, 1, 1, 0.0, 1.0, 1.0, 0.0, 2.0, 1.0, 1.0)
    empty = scoring.score(scoring.records(predictions.where("false"), scoring.ground_truth(failures, roots))).first()
    assert empty.n_scored == 0 and empty.within_0 == 0.0 and empty.mean_step_distance is None
    first = spark.createDataFrame([("a", 1), ("b", 1)], "trajectory_id string, x int")
    second = spark.createDataFrame([("b", 2), ("c", 2)], "trajectory_id string, x int")
    assert sorted(map(tuple, scoring.first_wins(first, second).collect())) == [("a", 1), ("b", 1), ("c", 2)]


def test_two_places_as_printed(spark):
    from failscope.functions.text import two_places

    values = [0.0, 0.125, 0.375, 1.125, 1.035, 0.285, 0.295, 2.675, 0.005, 0.015, 0.994999, 0.995, 0.9999, 12.345, 7.0, *(i / 1000 for i in range(0, 3000, 5))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(two_places("v")).collect()
    assert [r[0] for r in got] == [f"{v:.2f}" for v in values]


def test_equal_prompts_are_answered_alike(spark):
    """Traces may have the same prompt; each begins with the first answer."""
    rows = spark.createDataFrame([(i, "same prompt") for i in range(4)], "traj_key long, prompt string").coalesce(1)
    asked = judge.ask(rows, lambda: judge.ScriptedClient(["let me see", "{}"])).collect()
    assert sorted((r.traj_key, r.repairs, r.answer) for r in asked) == [(i, 1, "{}") for i in range(4)]


def test_confidence_does_not_depend_on_the_order_of_rows(spark):
    """Products of a trace's kinds are taken in one order, to the last bit."""
    kinds = {"a": 0.6, "b": 0.375, "c": 0.5, "d": 0.27, "e": 0.7, "f": 0.1}
    wanted = 1.0
    for kind in sorted(kinds):
        wanted *= 1.0 - kinds[kind]
    rng, rows = random.Random(5), []
    for trace in range(200):
        order = list(kinds)
        rng.shuffle(order)
        rows += [(trace, kind, kinds[kind]) for kind in order]
    events = spark.createDataFrame(rows, "traj_key long, kind string, severity double")
    assert {r.confidence for r in detect.confidences(events).collect()} == {1.0 - wanted}


def test_reports_use_the_scores_they_are_given(spark):
    steps = demo(spark)
    events = signals.run_signals(steps)
    scores = localize.score_steps(steps, events).withColumn("score", F.when(F.col("step_index") == 2, 9.0).otherwise(F.lit(0.0)))
    for system in ("signals-only", "filtered-log"):
        reports = judge.diagnose(tasks(spark, steps), steps, events, judge.SYSTEMS[system], lambda: judge.ScriptedClient(["no"]), scores=scores)
        assert {r.critical_step for r in reports.collect()} == {2}
