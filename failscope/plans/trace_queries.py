"""Queries of the trace engine over the projected traces."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failscope.functions import coercion, taxonomy
from failscope.operators import calibrate, constraints, detect, judge, localize, model, scoring, signals
from failscope.plans.projection import steps_from_conversations, steps_from_events
from failscope.schema import CALL, RESULT

KEY = model.KEY


def _tid(df: DataFrame, *columns) -> DataFrame:
    return df.select(F.col(KEY).cast("long").alias("tid"), *columns)


def _r(c: str, places: int = 6, name: str | None = None):
    return F.round(F.col(c), places).alias(name or c)


def _events_of(df: DataFrame) -> DataFrame:
    return _tid(df, "step_index", "kind", _r("severity"), "evidence")


# ---------------------------------------------------------------- steps


def steps_number(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(steps_from_events(spark, sf), "step_index", "n_steps", "role")


def steps_contiguity_check(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(model.contiguity(steps_from_conversations(spark, sf)), "n_steps", "contiguous")


def steps_render(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(model.render(steps_from_conversations(spark, sf)), "text")


def step_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(steps_from_conversations(spark, sf), "step_index", model.summary(60).alias("line"))


def step_at_first(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(model.step_at(steps_from_conversations(spark, sf), 1), "step_index", "role")


def calls_explode(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(model.explode_calls(steps_from_events(spark, sf)), "step_index", "call_pos", "name", "args_key")


def role_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(steps_from_conversations(spark, sf).where(~F.col("role").isin("system", "user")), "step_index", "role")


# ---------------------------------------------------------------- signals


def _signal(spark, sf, signal, kind=None, key="weekly", modulus=100, prepare=None) -> DataFrame:
    steps = steps_from_events(spark, sf, key, modulus)
    found = signals.run_signals(prepare(steps) if prepare else steps, [("signal", signal)])
    return _events_of(found if kind is None else found.where(F.col("kind") == kind))


def _broken_arguments(steps: DataFrame) -> DataFrame:
    return steps.withColumn("calls", F.transform("calls", lambda c: F.when(F.col("k") % 10 == 0, c.withField("parse_error", F.lit("bad"))).otherwise(c)))


def _declared(*schemas: str):
    return lambda steps: steps.withColumn("tool_schemas", F.array(*[F.lit(s) for s in schemas]))


_CLICK = '{"function": {"name": "click", "parameters": {"properties": {"k": {}}, "required": ["k", "order_id"]}}}'


def sig_budget_zscore(spark: SparkSession, sf: str) -> DataFrame:
    steps = steps_from_events(spark, sf)
    stats = signals.corpus_stats(steps)
    return _events_of(signals.run_signals(steps, [("budget", lambda s: signals.budget_anomaly(s, stats))]))


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return signals.corpus_stats(steps_from_events(spark, sf)).select(_r("mean_steps"), _r("std_steps"))


#: Signals, of seven kinds, that fire on the weekly traces; arguments are coarse, so that calls repeat.
BATTERY = [
    ("tool_error", signals.tool_error),
    ("repeated_call", signals.repeated_call),
    ("refusal", signals.refusal),
    ("incomplete_outcome", signals.incomplete_outcome),
    ("stall", partial(signals.stall, window=5)),
]


def _traces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    steps = steps_from_events(spark, sf, modulus=10)
    return steps, signals.run_signals(steps, BATTERY)


def events_all_sorted(spark: SparkSession, sf: str) -> DataFrame:
    _, events = _traces(spark, sf)
    order = Window.partitionBy(KEY).orderBy(*signals.EVENT_ORDER)
    return _tid(events.withColumn("ord", F.row_number().over(order)), "ord", "step_index", "kind", _r("severity"), "evidence")


def battery_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole default battery in one pass: events by kind, and the length of all they say."""
    found = signals.run_signals(steps_from_events(spark, sf, "user"), signals.default_signals())
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("severity"), 4).alias("mass"), F.sum(F.char_length("evidence")).alias("chars"))


# ---------------------------------------------------------------- constraints


def _violations(spark, sf, *rules, prepare=None) -> DataFrame:
    steps = steps_from_events(spark, sf)
    return _tid(constraints.constraint_events(prepare(steps) if prepare else steps, rules), "step_index", "kind", _r("severity"))


def _orders(steps: DataFrame) -> DataFrame:
    """Views report an order's total; purchases pay an amount for an order."""
    order = (F.col("k") % 3).cast("string")
    result = F.struct(F.lit(None).cast("string").alias("call_id"), F.lit("get_order").alias("name"), F.to_json(F.struct(order.alias("order_id"), F.col("value").alias("total"))).alias("content"), F.lit(False).alias("is_error"))
    paid = F.transform("calls", lambda c: c.withField("arguments", F.to_json(F.struct(order.alias("order_id"), F.col("value").alias("amount")))))
    return steps.withColumn("result", F.when(F.col("event_type") == "view", result.cast(RESULT))).withColumn("calls", paid.cast(f"array<{CALL}>"))


def schema_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    traces = steps_from_events(spark, sf).where("step_index = 1").select(KEY, F.array(F.when(F.col("k") % 2 == 0, F.lit(_CLICK)).otherwise(F.lit('{"name": "purchase"}'))).alias("tool_schemas"), F.lit(" be kind ").alias("policy"))
    return _tid(constraints.schema_fingerprints(traces), "fingerprint")


# ---------------------------------------------------------------- detection


def det_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(detect.kinds(_traces(spark, sf)[1]), F.explode("kinds").alias("kind", "severity")).select("tid", "kind", _r("severity"))


def det_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(detect.confidences(_traces(spark, sf)[1]), _r("confidence"))


def det_verdict_threshold(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return _tid(detect.verdicts(steps, events, 0.75), _r("confidence"), "failed", "threshold")


def det_explain_topk(spark: SparkSession, sf: str) -> DataFrame:
    events = _traces(spark, sf)[1].withColumn("severity", F.round("severity", 6))  # ties whatever the last bit
    return _tid(detect.top_events(events, 3), "rank", "step_index", "kind", "severity")


def det_explain_text(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    events = events.withColumn("severity", F.round("severity", 6))  # ties whatever the last bit
    return _tid(detect.explain(detect.verdicts(steps, events), events), "text")


# ---------------------------------------------------------------- calibration


def _labels(steps: DataFrame) -> DataFrame:
    """A trace failed if its share of errors exceeds the corpus's."""
    total = steps.agg(F.avg((F.col("event_type") == "error").cast("double")).alias("corpus"))
    share = steps.groupBy(KEY).agg(F.avg((F.col("event_type") == "error").cast("double")).alias("own"))
    return share.crossJoin(F.broadcast(total)).select(KEY, (F.col("own") > F.col("corpus")).alias("label"), F.col(KEY).alias("pos"))


def cal_fit_log_ratios(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return calibrate.fit(_labels(steps), events)[0].select("kind", _r("log_ratio"))


def cal_bias(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return calibrate.fit(_labels(steps), events)[1].select(_r("bias"))


def cal_top_weights(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return calibrate.top_weights(calibrate.fit(_labels(steps), events)[0], 3).select("kind", _r("log_ratio"))


def cal_score(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return _tid(calibrate.scores(steps, events, *calibrate.fit(_labels(steps), events)), _r("confidence"), "failed")


def cal_cross_val(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return calibrate.cross_validate(_labels(steps), events).select(_r("recall"), _r("false_positive_rate"), _r("precision"), _r("f1"), "n_positive", "n_negative", "folds")


# ---------------------------------------------------------------- localization


def loc_own_mass(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(localize.own_mass(*_traces(spark, sf)), "step_index", _r("own_mass"))


def loc_step_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(localize.score_steps(*_traces(spark, sf)), "step_index", _score())


def _score():
    """A score to six places; the small shift keeps halves from falling either way."""
    return F.round(F.col("score") + 2e-9, 6).alias("score")


def _rounded_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores to nine places, so that ties are ties whatever the order of a sum's terms."""
    return localize.score_steps(*_traces(spark, sf)).withColumn("score", F.round("score", 9))


def loc_prior(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(localize.prior(_rounded_scores(spark, sf)), "step", _r("confidence"))


def loc_ranked_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(localize.ranked_steps(_rounded_scores(spark, sf), 3), "rank", "step_index", _score())


def loc_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _tid(localize.windows(_rounded_scores(spark, sf)), "window_no", "start", "end", "peak", _score())


def loc_window_events(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    spans = steps.select(KEY, "n_steps").distinct().where("n_steps >= 3").select(KEY, F.lit(1).alias("window_no"), F.lit(3).alias("start"), F.least(F.lit(7), F.col("n_steps")).alias("end"), F.lit(1.0).alias("score"))
    return _tid(localize.window_events(spans, events), "start", "end", "step_index", "kind", _r("severity"))


def loc_window_text(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return _tid(localize.render_windows(steps, events, localize.windows(_rounded_scores(spark, sf))), "text")


# ---------------------------------------------------------------- taxonomy and prices

#: Free texts for the taxonomy, chosen by ``k``.
TEXTS = (
    "Instruction/Plan Adherence Failure", "invention", "Some NEW information", " invalid invocation ", "Handoff error", "Intent-plan", "misalignment of intent", "underspecified", "user intent unclear", "Intent Not Supported",
    "guardrails", "System failure", "inconclusive", "4", "FailureCase.SYSTEM_FAILURE", "12", "nonsense", "",
)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").cast("int") % len(TEXTS)
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.get(F.array(*[F.lit(t) for t in TEXTS]), number).alias("text"))


def tax_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("event_id", taxonomy.normalize_category(F.col("text")).alias("category"))


def tax_case_number(spark: SparkSession, sf: str) -> DataFrame:
    case = taxonomy.category_case(F.col("text"))
    return _texts(spark, sf).select("event_id", case.alias("case_no"), taxonomy.case_category(case).alias("category"))


def price(spark: SparkSession, sf: str) -> DataFrame:
    table = (("alpha-1", 5.0, 25.0), ("alpha", 3.0, 15.0), ("beta", 1.0, 5.0))
    name = F.when(F.col("event_id") % 4 == 0, F.lit("alpha-1-x")).when(F.col("event_id") % 4 == 1, F.lit("alpha-2")).when(F.col("event_id") % 4 == 2, F.lit("beta")).otherwise(F.lit("local"))
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(coercion.price(name, k * 1000, k * 10, table), 8).alias("cost"))


# ---------------------------------------------------------------- scoring


def _ground_truth_tables(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failures are the steps whose k is a multiple of 7 and the step of the greatest value, the root."""
    names = F.create_map(F.lit("view"), F.lit("Invention of New Information"), F.lit("click"), F.lit("Invalid Invocation"), F.lit("purchase"), F.lit("Intent Not Supported"), F.lit("signup"), F.lit("Guardrails Triggered"), F.lit("error"), F.lit("System Failure"))
    root = steps.groupBy("trajectory_id").agg(F.max_by("event_id", F.struct("value", (-F.col("step_index")).alias("e"))).alias("root_failure_id"))
    failures = steps.join(root, "trajectory_id").where((F.col("k") % 7 == 0) | (F.col("event_id") == F.col("root_failure_id")))
    failures = failures.select("trajectory_id", F.col("step_index").alias("pos"), F.col("event_id").alias("failure_id"), F.col("step_index").alias("step_number"), F.element_at(names, F.col("event_type")).alias("category"))
    return failures, root


def _ground_truth(steps: DataFrame) -> DataFrame:
    return scoring.ground_truth(*_ground_truth_tables(steps))


def _paired(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    scores = _rounded_scores(spark, sf)
    spans = localize.window_arrays(scores).select(KEY, "windows")
    predicted = localize.prior(scores).join(spans, KEY).select(
        F.col(KEY).cast("string").alias("trajectory_id"), "step", F.when(F.col("step") % 2 == 0, F.lit("system failure")).otherwise(F.lit("3")).alias("category"), "windows", F.lit(None).cast("string").alias("error"),
        F.lit(0.001).alias("cost_usd"), (F.col("step") * 10).cast("long").alias("prompt_tokens"), F.col("step").cast("long").alias("completion_tokens"), F.lit(0.5).alias("latency_s"),
    )
    return scoring.records(predicted, _ground_truth(steps))


def score_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    truth = _ground_truth(steps_from_events(spark, sf))
    return truth.select(F.col("trajectory_id").cast("long").alias("tid"), F.col("critical_step").cast("int").alias("critical_step"), "root_cause_case", "earliest_case", "terminal_case", F.array_join("all_cases", ",").alias("all_cases"))


def score_localization(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(_paired(spark, sf)).select("n_scored", "n_missing_root_cause", "n_errors", *[_r(f"within_{t}") for t in scoring.TOLERANCES], _r("mean_step_distance"))


def score_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(_paired(spark, sf)).select(*[_r(c) for c in ("attr_root_cause", "attr_any", "attr_earliest", "attr_terminal")])


def score_window_recall(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(_paired(spark, sf)).select(_r("window_recall"), "prompt_tokens", "completion_tokens", _r("mean_latency_s"))


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_row(scoring.score(_paired(spark, sf))).select("n", "err", "tok", _r("exact"), _r("pm5"), "in_tok", "out_tok", "cost_usd", "latency_s")


def score_detection(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    said = detect.verdicts(steps, events, 0.75).select(F.col(KEY).alias("trajectory_id"), F.col("failed").alias("predicted_failed"))
    outcomes = _labels(steps).select(F.col(KEY).alias("trajectory_id"), F.col("label").alias("failed"))
    return scoring.score_detection(said, outcomes).select(_r("recall"), _r("false_positive_rate"), _r("precision"), _r("f1"), "n_positive", "n_negative")


def _result_rows(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    """Result rows from ``nation``: systems by key, domains by region, metrics by arithmetic."""
    n = F.col("n_nationkey").cast("int")
    return spark.read.parquet(f"{sf}/nation.parquet").select(
        F.concat(F.lit("d"), (n % 2).cast("string")).alias("domain"), F.concat(F.lit("s"), F.floor(n / 10).cast("string")).alias("system"), F.floor((n % 10) / 2).cast("int").alias("repeat"), (n % 10 + 20).cast("long").alias("n"),
        F.when(n + shift == 13, F.lit(2)).otherwise(F.lit(0)).cast("long").alias("err"), ((n + shift) * 7 % 11 / 11.0).cast("double").alias("exact"), F.when(n % 5 != 0, n * 3 % 7 / 7.0).cast("double").alias("pm5"), (n % 3 / 3.0).cast("double").alias("root_cause_cat"),
    )


def score_repeats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _result_rows(spark, sf)
    for c in scoring.MEANS:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("double"))
    return scoring.aggregate_repeats(rows, "domain", "system").select("domain", "system", "n", _r("exact"), _r("pm5"), "err", "repeats", _r("exact_std"), F.array_join(F.transform("err_per_repeat", lambda e: e.cast("string")), ",").alias("err_per_repeat"))


def _configurations(spark: SparkSession, sf: str, shift: int = 0) -> DataFrame:
    rows = _result_rows(spark, sf, shift).where("repeat = 0")
    return rows.withColumn("exact_std", (F.col("n") % 3 / 10.0).cast("double"))


def pool_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.pool(_configurations(spark, sf)).select("system", "n", _r("exact"), _r("pm5"), _r("root_cause_cat"), _r("pooled_std"))


def compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.compare_runs(_configurations(spark, sf), _configurations(spark, sf, 3)).select("domain", "system", _r("a"), _r("b"), _r("delta"))


def run_rankings(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.rankings(_configurations(spark, sf))


def join_semi_anti(spark: SparkSession, sf: str) -> DataFrame:
    traces = steps_from_events(spark, sf).groupBy("trajectory_id").agg(F.max("n_steps").alias("n_steps"))
    listed = traces.where("n_steps % 2 = 0").select("trajectory_id")
    kept = scoring.semi(traces, listed).withColumn("side", F.lit("semi")).unionByName(scoring.successes(traces, listed).withColumn("side", F.lit("anti")))
    return kept.select(F.col("trajectory_id").cast("long").alias("tid"), "n_steps", "side")


# ---------------------------------------------------------------- judge


def _task(steps: DataFrame) -> DataFrame:
    return steps.where("step_index = 1").select(KEY, F.lit("Buy what the user asks for.").alias("instruction"), F.lit("Never guess.").alias("policy"))


def judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    events = events.withColumn("severity", F.round("severity", 6))  # ties whatever the last bit
    return _tid(judge.prompts(_task(steps), steps, events, scores=_rounded_scores(spark, sf)), "prompt", "steps_shown", "steps_total")


def _scripted() -> judge.ScriptedClient:
    return judge.ScriptedClient(["let me see", '```json\n{"critical_step": 99, "category": "system failure", "cause": "timeout", "confidence": "0.7"}\n```'])


def judge_fake_report(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    found = judge.diagnose(_task(steps), steps, events, judge.SYSTEMS["filtered-log"], _scripted, "scripted", _rounded_scores(spark, sf))
    return _tid(found, "critical_step", "category", "confidence", "steps_shown", "steps_total", "repairs", "degraded")


def judge_signals_only(spark: SparkSession, sf: str) -> DataFrame:
    steps, events = _traces(spark, sf)
    return _tid(judge.diagnose(_task(steps), steps, events, judge.SYSTEMS["signals-only"], scores=_rounded_scores(spark, sf)), "critical_step", "category_case", "steps_shown", "steps_total")


QUERIES = {
    f.__name__: f
    for f in (
        steps_number, steps_contiguity_check, steps_render, step_summary, step_at_first, calls_explode, role_filter, sig_budget_zscore, corpus_stats, events_all_sorted, battery_counts, schema_fingerprint,
        det_kinds, det_confidence, det_verdict_threshold, det_explain_topk, det_explain_text, cal_fit_log_ratios, cal_bias, cal_top_weights, cal_score, cal_cross_val,
        loc_own_mass, loc_step_scores, loc_prior, loc_ranked_topk, loc_windows, loc_window_events, loc_window_text, tax_normalize, tax_case_number, price,
        score_ground_truth, score_localization, score_attribution, score_window_recall, score_table, score_detection, score_repeats, pool_weighted, compare_runs, run_rankings, join_semi_anti, judge_prompt, judge_fake_report, judge_signals_only,
    )
} | {
    "sig_tool_error": partial(_signal, signal=signals.tool_error),
    "sig_malformed_arguments": partial(_signal, signal=signals.malformed_arguments, prepare=_broken_arguments),
    "sig_unknown_tool": partial(_signal, signal=signals.unknown_tool, prepare=_declared('{"name": "click"}', '{"name": 5}')),
    "sig_argument_schema": partial(_signal, signal=signals.argument_schema, prepare=_declared(_CLICK)),
    "sig_repeated_call": partial(_signal, signal=signals.repeated_call, modulus=10),
    "sig_oscillation": partial(_signal, signal=signals.oscillation, modulus=2),
    "sig_no_progress": partial(_signal, signal=partial(signals.no_progress, window=3)),
    "sig_refusal": partial(_signal, signal=signals.refusal),
    "sig_incomplete_outcome": partial(_signal, signal=signals.incomplete_outcome, kind="incomplete_outcome"),
    "sig_leaked_error": partial(_signal, signal=signals.incomplete_outcome, kind="leaked_error"),
    "sig_truncated_run": partial(_signal, signal=signals.incomplete_outcome, kind="truncated_run"),
    "sig_budget_absolute": partial(_signal, signal=partial(signals.budget_anomaly, absolute_steps=20)),
    "sig_stall": partial(_signal, signal=partial(signals.stall, window=5)),
    "sig_stall_user": partial(_signal, signal=signals.stall, key="user"),
    "con_require_before": lambda spark, sf: _violations(spark, sf, constraints.require_before("look first", "", "click", "purchase")),
    "con_numeric_bound": lambda spark, sf: _violations(spark, sf, constraints.numeric_bound("small", "", "purchase", "amount", maximum=150.0, minimum=2.0)),
    "con_step": lambda spark, sf: _violations(spark, sf, constraints.step_constraint("no 503", "", F.when(F.col("content").contains("HTTP 503"), F.lit("saw 503")))),
    "con_asof_latest": lambda spark, sf: _violations(spark, sf, constraints.latest_bound("within total", "", "purchase", "amount", "get_order", "total", "order_id"), prepare=_orders),
}
