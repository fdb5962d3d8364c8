"""The signal battery: steps -> events.

Signals are column expressions over one pass of the steps. All windows are partitioned by trace (or
by trace and more), so the whole battery needs one exchange; the findings of a step are an array
that is exploded once.

``steps`` has the columns of ``failscope.schema.STEPS`` and, for the signals that need them,
``tool_schemas`` (JSON texts) of the trace.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.functions import patterns
from failscope.functions.text import around, clip, quoted
from failscope.operators.model import KEY, call_key, is_thought, with_step_count

#: Least severity of a finding that is no finding at all: a signal that couldn't run.
SIGNAL_ERROR = "signal_error"


@dataclass(frozen=True)
class CorpusStats:
    """Lengths of the traces of a population: a one-row table in the plan, or these numbers."""

    mean_steps: float
    std_steps: float


def corpus_stats(steps: DataFrame) -> DataFrame:
    """(mean_steps, std_steps) over traces with steps; population deviation, 0 for fewer than two."""
    lengths = steps.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return lengths.agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_steps"), F.coalesce(F.stddev_pop("n"), F.lit(0.0)).alias("std_steps"))


# ---------------------------------------------------------------- parts of expressions


def acts() -> Column:
    """The step calls a tool or brings a result."""
    return (F.size("calls") > 0) | F.col("result").isNotNull()


def in_tail(fraction: float = 0.25, minimum: int = 3) -> Column:
    """The closing steps: a quarter of them, three at least."""
    size = F.greatest(F.lit(minimum), F.floor(F.col("n_steps") * F.lit(fraction)).cast("int"))
    return F.col("step_index") >= F.greatest(F.lit(1), F.col("n_steps") - size + 1)


def finding(kind: str, severity: Column, evidence: Column, when: Column) -> Column:
    """An event struct where ``when`` holds, else null."""
    return F.when(when, F.struct(F.lit(kind).alias("kind"), severity.cast("double").alias("severity"), evidence.alias("evidence")))


def _one(event: Column) -> Column:
    return F.array_compact(F.array(event))


EVENT_ARRAY = "array<struct<kind: string, severity: double, evidence: string>>"


def declared_tools() -> Column:
    """Names of the declared tools: JSON texts, the definition itself or below ``function``."""
    return F.filter(F.transform("tool_schemas", lambda s: tool_body(s)["name"]), lambda n: n.isNotNull())


def tool_body(schema: Column) -> Column:
    """(name, body) of a tool's JSON text; the name is null unless it is a string."""
    inner = F.get_json_object(schema, "$.function")
    body = F.when(inner.startswith("{"), inner).otherwise(schema)
    name = F.get_json_object(body, "$.name")
    is_string = F.expr("true") & (F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.name", "string"), F.lit(None)).isNotNull()) & ~F.coalesce(name.rlike(r"^[\[{]"), F.lit(False))
    number = F.try_variant_get(F.try_parse_json(body), "$.name", "double").isNotNull() & ~body.rlike(r'"name"\s*:\s*"')
    return F.struct(F.when(is_string & ~number, name).alias("name"), body.alias("body"))


# ---------------------------------------------------------------- the signals


def tool_error(steps: DataFrame) -> tuple[DataFrame, Column]:
    """A result that says it is an error, or whose first 400 characters read like one."""
    text = F.coalesce("result.content", F.lit(""))
    hit = F.col("result").isNotNull() & (F.coalesce("result.is_error", F.lit(False)) | F.substring(text, 1, 400).rlike(patterns.TOOL_ERROR))
    told = F.concat(F.lit("tool "), F.coalesce(F.when(F.col("result.name") != "", F.col("result.name")), F.lit("?")), F.lit(" returned an error: "), clip(text))
    return steps, _one(finding("tool_error", F.lit(0.6), told, hit))


def malformed_arguments(steps: DataFrame) -> tuple[DataFrame, Column]:
    """A call whose arguments could not be parsed; one event a call."""
    bad = F.filter("calls", lambda c: F.coalesce(c["parse_error"], F.lit("")) != "")
    return steps, F.transform(bad, lambda c: F.struct(F.lit("malformed_arguments").alias("kind"), F.lit(0.8).alias("severity"), F.concat(F.lit("arguments to "), c["name"], F.lit(" are not valid JSON: "), c["parse_error"]).alias("evidence")))


def unknown_tool(steps: DataFrame) -> tuple[DataFrame, Column]:
    """A call to a tool that isn't declared; silent where nothing is declared."""
    if "tool_schemas" not in steps.columns:
        return steps, F.array().cast(EVENT_ARRAY)
    known = steps.withColumn("__known", declared_tools())
    strange = F.filter("calls", lambda c: ~F.array_contains(F.col("__known"), c["name"]))
    events = F.transform(strange, lambda c: F.struct(F.lit("unknown_tool").alias("kind"), F.lit(0.9).alias("severity"), F.concat(F.lit("called undeclared tool "), quoted(c["name"])).alias("evidence")))
    return known, F.when(F.size("__known") > 0, events).otherwise(F.array().cast(EVENT_ARRAY))


def argument_schema(steps: DataFrame) -> tuple[DataFrame, Column]:
    """Required arguments that are missing, then arguments that no property declares."""
    if "tool_schemas" not in steps.columns:
        return steps, F.array().cast(EVENT_ARRAY)
    full = lambda c: F.when(~c.rlike(r"^\s*(\{\s*\}|\[\s*\]|null|false|0|\"\")\s*$"), c)
    bodies = steps.withColumn("__bodies", F.transform("tool_schemas", tool_body))

    def events_of(c: Column) -> Column:
        body = F.try_element_at(F.filter("__bodies", lambda b: b["name"] == c["name"]), F.lit(-1))["body"]
        params = F.coalesce(full(F.get_json_object(body, "$.parameters")), full(F.get_json_object(body, "$.input_schema")), F.lit("{}"))
        properties = F.coalesce(F.json_object_keys(F.get_json_object(params, "$.properties")), F.array().cast("array<string>"))
        required = F.coalesce(F.from_json(F.get_json_object(params, "$.required"), "array<string>"), F.array().cast("array<string>"))
        provided = F.coalesce(F.json_object_keys(c["arguments"]), F.array().cast("array<string>"))
        missing = F.array_sort(F.array_except(required, provided))
        extra = F.array_sort(F.array_except(provided, properties))
        told = lambda what, names: F.concat(c["name"], F.lit(what), F.array_join(names, ", "))
        return F.when(
            body.isNotNull(),
            F.array_compact(
                F.array(
                    finding("argument_schema_violation", F.lit(0.75), told(" missing required argument(s): ", missing), F.size(missing) > 0),
                    finding("argument_schema_violation", F.lit(0.4), told(" passed undeclared argument(s): ", extra), (F.size(properties) > 0) & (F.size(extra) > 0)),
                )
            ),
        ).otherwise(F.array().cast(EVENT_ARRAY))

    known = F.size(F.filter("__bodies", lambda b: b["name"].isNotNull())) > 0
    return bodies, F.when(known, F.flatten(F.transform("calls", events_of))).otherwise(F.array().cast(EVENT_ARRAY))


def repeated_call(steps: DataFrame, threshold: int = 2) -> tuple[DataFrame, Column]:
    """The same calls with the same arguments again: an event for each occurrence after the first."""
    key = F.array_join(call_key(), "\u0001")
    same = Window.partitionBy(KEY, "__call_key")
    marked = steps.withColumn("__call_key", key)
    marked = marked.withColumn("__times", F.count(F.lit(1)).over(same)).withColumn("__first", F.min("step_index").over(same))
    severity = F.least(F.lit(0.3) + F.lit(0.15) * (F.col("__times") - 1), F.lit(0.85))
    told = F.concat(F.lit("repeats the identical call "), F.get(call_key(), F.lit(0)), F.lit(" first made at step "), F.col("__first").cast("string"), F.lit(" ("), F.col("__times").cast("string"), F.lit("x total)"))
    hit = F.col("__call_key").isNotNull() & (F.col("__times") >= threshold) & (F.col("step_index") > F.col("__first"))
    return marked, _one(finding("repeated_call", severity, told, hit))


def oscillation(steps: DataFrame, cycles: int = 2) -> tuple[DataFrame, Column]:
    """Two different calls in alternation, A B A B, among the acting steps.

    Candidates are taken from the left; one that begins within a taken pattern is left out. Which are
    taken follows from the runs of candidates by arithmetic, in windows of single values, so that no
    row holds its trace. A pattern has ``cycles`` cycles of two.
    """
    span = 2 * cycles
    marked = steps.withColumn("__key", F.array_join(call_key(), "\u0001"))
    turn = Window.partitionBy(KEY, F.col("__key").isNotNull()).orderBy("step_index")
    marked = marked.withColumn("__turn", F.row_number().over(turn))
    ahead = {k: F.lead("__key", k).over(turn) for k in range(1, span)}
    marked = marked.withColumns({f"__ahead{k}": c for k, c in ahead.items()}).withColumn("__last", F.lead("step_index", span - 1).over(turn)).withColumn("__other", F.lead(call_key(), 1).over(turn))
    candidate = F.col("__key").isNotNull() & F.col(f"__ahead{span - 1}").isNotNull() & (F.col("__key") != F.col("__ahead1"))
    for k in range(2, span):
        candidate &= F.col(f"__ahead{k}") == (F.col("__key") if k % 2 == 0 else F.col("__ahead1"))
    marked = marked.withColumn("__candidate", F.coalesce(candidate, F.lit(False)))
    # runs of candidates that follow each other; a run's first free candidate is its first or, where the
    # run before ends with a taken one and the two alternations share a turn, its second
    own = Window.partitionBy(KEY, "__candidate").orderBy("step_index")
    marked = marked.withColumn("__run", F.col("__turn") - F.row_number().over(own))
    of_run = Window.partitionBy(KEY, "__candidate", "__run")
    marked = marked.withColumn("__begin", F.min("__turn").over(of_run)).withColumn("__before", F.lag("__turn").over(own)).withColumn("__before_begin", F.lag("__begin").over(own))
    size = (F.col("__before") - F.col("__before_begin")) % span
    shares = (F.col("__turn") == F.col("__begin")) & (F.col("__begin") == F.col("__before") + span - 1)
    marked = marked.withColumn("__flips", F.coalesce(shares & (size == 0), F.lit(False))).withColumn("__breaks", (F.col("__turn") == F.col("__begin")) & ~F.coalesce(shares & (size <= 1), F.lit(False)))
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("__chain", F.sum(F.col("__breaks").cast("int")).over(upto))
    chained = Window.partitionBy(KEY, "__candidate", "__chain").orderBy("step_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    late = F.sum(F.col("__flips").cast("int")).over(chained) % 2
    marked = marked.withColumn("__free", F.col("__turn") - F.col("__begin") - late)
    hit = F.col("__candidate") & (F.col("__free") >= 0) & (F.col("__free") % span == 0)
    told = F.concat(F.lit("alternates between "), F.get(call_key(), F.lit(0)), F.lit(" and "), F.get("__other", F.lit(0)), F.lit(" across steps "), F.col("step_index").cast("string"), F.lit("-"), F.col("__last").cast("string"), F.lit(" without resolving"))
    return marked, _one(finding("oscillation", F.lit(0.65), told, hit))


def no_progress(steps: DataFrame, window: int = 6) -> tuple[DataFrame, Column]:
    """A maximal run of steps that neither act nor speak to the user."""
    breaks = acts() | (F.col("role").isin("user", "assistant") & ~is_thought(F.col("agent")))
    upto = Window.partitionBy(KEY).orderBy("step_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = steps.withColumn("__break", breaks).withColumn("__island", F.sum(F.col("__break").cast("int")).over(upto))
    island = Window.partitionBy(KEY, "__island")
    marked = marked.withColumn("__run", F.count_if(~F.col("__break")).over(island)).withColumn("__start", F.min(F.when(~F.col("__break"), F.col("step_index"))).over(island))
    severity = F.least(F.lit(0.2) + F.lit(0.05) * (F.col("__run") - window), F.lit(0.5))
    told = F.concat(F.col("__run").cast("string"), F.lit(" consecutive steps of deliberation without acting, starting at step "), F.col("__start").cast("string"))
    return marked, _one(finding("no_progress", severity, told, (F.col("__run") >= window) & (F.col("step_index") == F.col("__start"))))


def refusal(steps: DataFrame) -> tuple[DataFrame, Column]:
    """The agent declines or gives up in the closing steps."""
    text = F.coalesce("content", F.lit(""))
    hit = in_tail() & F.col("result").isNull() & ~F.col("role").isin("system", "user") & text.rlike(patterns.REFUSAL)
    return steps, _one(finding("refusal", F.lit(0.7), F.concat(F.lit("agent declines or gives up: …"), around(text, patterns.REFUSAL), F.lit("…")), hit))


def incomplete_outcome(steps: DataFrame) -> tuple[DataFrame, Column]:
    """The closing steps report incompleteness or leak an error; the run ends on tool activity."""
    text = F.coalesce("content", F.lit(""))
    closing = in_tail() & ~F.col("role").isin("system", "user")
    told = lambda lead, pattern: F.concat(F.lit(lead), around(text, pattern), F.lit("…"))
    events = F.array(
        finding("incomplete_outcome", F.lit(0.5), told("reports the task is incomplete: …", patterns.INCOMPLETE), closing & F.col("result").isNull() & text.rlike(patterns.INCOMPLETE)),
        finding("leaked_error", F.lit(0.6), told("raw error surfaced in output: …", patterns.LEAKED_ERROR), closing & text.rlike(patterns.LEAKED_ERROR)),
        finding("truncated_run", F.lit(0.45), F.lit("trajectory ends on tool activity with no closing response to the user"), (F.col("step_index") == F.col("n_steps")) & acts()),
    )
    return steps, F.array_compact(events)


def budget_anomaly(steps: DataFrame, stats: CorpusStats | DataFrame | None = None, z_threshold: float = 2.0, absolute_steps: int = 80) -> tuple[DataFrame, Column]:
    """A trace far longer than its corpus; without a spread to compare with, longer than a ceiling."""
    last = F.col("step_index") == F.col("n_steps")
    ceiling = finding(
        "budget_anomaly", F.lit(0.25), F.concat(F.col("n_steps").cast("string"), F.lit(f" steps exceeds the default ceiling of {absolute_steps}")), last & (F.col("n_steps") >= absolute_steps)
    )
    if stats is None:
        return steps, _one(ceiling)
    if isinstance(stats, CorpusStats):
        steps = steps.withColumn("__mean", F.lit(float(stats.mean_steps))).withColumn("__std", F.lit(float(stats.std_steps)))
    else:  # one row, so a broadcast of it is bounded
        steps = steps.crossJoin(F.broadcast(stats.select(F.col("mean_steps").alias("__mean"), F.col("std_steps").alias("__std"))))
    z = F.try_divide(F.col("n_steps") - F.col("__mean"), F.col("__std"))
    told = F.concat(F.col("n_steps").cast("string"), F.lit(" steps is "), F.format_string("%.1f", z), F.lit("σ above the corpus mean of "), F.format_string("%.0f", F.bround(F.col("__mean"), 0)))
    scored = finding("budget_anomaly", F.least(F.lit(0.2) + F.lit(0.1) * (z - z_threshold), F.lit(0.5)), told, last & (z >= z_threshold))
    return steps, _one(F.when(F.col("__std") > 0, scored).otherwise(ceiling))


def stall(steps: DataFrame, window: int = 10) -> tuple[DataFrame, Column]:
    """Many tool interactions between two answers to the user; other steps neither count nor break."""
    answers = (F.col("role") == "assistant") & ~acts() & F.coalesce(F.col("content"), F.lit("")).rlike(r"(?U)\S")
    upto = Window.partitionBy(KEY).orderBy("step_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = steps.withColumn("__acts", acts()).withColumn("__segment", F.sum(answers.cast("int")).over(upto))
    segment = Window.partitionBy(KEY, "__segment")
    marked = marked.withColumn("__tools", F.count_if("__acts").over(segment)).withColumn("__from", F.min(F.when(F.col("__acts"), F.col("step_index"))).over(segment))
    severity = F.least(F.lit(0.2) + F.lit(0.03) * (F.col("__tools") - window), F.lit(0.45))
    told = F.concat(F.col("__tools").cast("string"), F.lit(" consecutive tool interactions from step "), F.col("__from").cast("string"), F.lit(" without responding to the user"))
    return marked, _one(finding("stall", severity, told, (F.col("__tools") >= window) & (F.col("step_index") == F.col("__from"))))


Signal = Callable[[DataFrame], tuple[DataFrame, Column]]


def default_signals(stats: CorpusStats | DataFrame | None = None) -> list[tuple[str, Signal]]:
    """The battery of ten, in the order that breaks ties."""
    return [
        ("tool_error", tool_error),
        ("malformed_arguments", malformed_arguments),
        ("unknown_tool", unknown_tool),
        ("repeated_call", repeated_call),
        ("oscillation", oscillation),
        ("no_progress", no_progress),
        ("refusal", refusal),
        ("incomplete_outcome", incomplete_outcome),
        ("budget_anomaly", lambda s: budget_anomaly(s, stats)),
        ("stall", stall),
    ]


def run_signals(steps: DataFrame, signals: Sequence[tuple[str, Signal]] | None = None) -> DataFrame:
    """Events of all signals: traj_key, step_index, kind, severity, evidence, signal_ord, emit_ord.

    A signal that can't be built on these steps (a column that it needs isn't there, a rule that
    raises) gives one ``signal_error`` of severity 0 at step 1 of each trace; the others run.
    """
    columns, sized = [], with_step_count(steps)
    for order, (name, signal) in enumerate(default_signals() if signals is None else signals):
        try:
            with_columns, events = signal(sized)
            with_columns = with_columns.withColumn(f"__events{order}", events.cast(EVENT_ARRAY))
            with_columns.schema  # noqa: B018  a wrong expression shows here
        except Exception as failure:  # noqa: BLE001  one signal must not stop the others
            told = f"signal '{name}' raised: {str(failure).splitlines()[0]}"
            with_columns = sized.withColumn(f"__events{order}", _one(finding(SIGNAL_ERROR, F.lit(0.0), F.lit(told), F.col("step_index") == 1)).cast(EVENT_ARRAY))
        kept = [c for c in with_columns.columns if not c.startswith("__") or c.startswith("__events")]
        sized = with_columns.select(*kept)
        columns.append(f"__events{order}")

    def tag(order: int):
        return lambda e, i: F.struct(e["kind"].alias("kind"), e["severity"].alias("severity"), e["evidence"].alias("evidence"), F.lit(order).alias("signal_ord"), i.alias("emit_ord"))

    tagged = [F.transform(c, tag(order)) for order, c in enumerate(columns)]
    every = F.concat(*tagged) if tagged else F.array().cast("array<struct<kind: string, severity: double, evidence: string, signal_ord: int, emit_ord: int>>")
    return sized.select(KEY, "step_index", F.inline(every))


#: Order of a trace's events.
EVENT_ORDER = ("step_index", "kind", "signal_ord", "emit_ord")


def with_own_signals(steps: DataFrame, own: Sequence[Callable[[DataFrame], DataFrame]], signals: Sequence[tuple[str, Signal]] | None = None) -> DataFrame:
    """Events of the battery and of functions from steps to (traj_key, step_index, kind, severity, evidence)."""
    battery = default_signals() if signals is None else list(signals)
    found = run_signals(steps, battery)
    for order, signal in enumerate(own, start=len(battery)):
        mine = signal(steps).select(KEY, "step_index", "kind", F.col("severity").cast("double").alias("severity"), "evidence")
        place = Window.partitionBy(KEY).orderBy("step_index", "kind")
        found = found.unionByName(mine.withColumn("signal_ord", F.lit(order)).withColumn("emit_ord", F.row_number().over(place)))
    return found
