"""Steps: numbering, checks, calls and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.functions.text import collapse, shorten

KEY = "traj_key"


def number_steps(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``step_index`` from 1 in the given order, and ``n_steps``. One exchange, by trace."""
    trace = Window.partitionBy(KEY)
    return rows.withColumn("step_index", F.row_number().over(trace.orderBy(*order))).withColumn("n_steps", F.count(F.lit(1)).over(trace).cast("int"))


def with_step_count(steps: DataFrame) -> DataFrame:
    return steps if "n_steps" in steps.columns else steps.withColumn("n_steps", F.count(F.lit(1)).over(Window.partitionBy(KEY)).cast("int"))


def is_thought(agent: Column) -> Column:
    """Whether the acting agent's name says that the step is deliberation."""
    return F.coalesce(F.lower(agent).contains("thought"), F.lit(False))


def contiguity(steps: DataFrame) -> DataFrame:
    """(traj_key, n_steps, contiguous): whether the indices are 1, 2, ... without gap or repeat."""
    held = steps.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_steps"), F.min("step_index").alias("lo"), F.max("step_index").alias("hi"), F.count_distinct("step_index").alias("d"))
    return held.select(KEY, F.col("n_steps").cast("int").alias("n_steps"), ((F.col("lo") == 1) & (F.col("hi") == F.col("n_steps")) & (F.col("d") == F.col("n_steps"))).alias("contiguous"))


def require_contiguous(steps: DataFrame) -> DataFrame:
    """The steps; reading fails at the first trace whose indices aren't 1, 2, ... in order."""
    trace = Window.partitionBy(KEY).orderBy("step_index")
    wrong = F.concat(F.lit("steps of trajectory "), F.coalesce(F.col("trajectory_id"), F.lit("?")), F.lit(" are not contiguous from 1 at index "), F.col("step_index").cast("string"))
    return steps.withColumn("__rank", F.row_number().over(trace)).where(F.when(F.col("__rank") == F.col("step_index"), F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean"))).drop("__rank")


def step_at(steps: DataFrame, index: int) -> DataFrame:
    """The step of that index of each trace; fails for traces that are shorter."""
    short = F.concat(F.lit(f"step {index} out of range for a trajectory with "), F.col("n_steps").cast("string"), F.lit(" steps"))
    sized = with_step_count(steps)
    checked = sized.where(F.when((F.lit(index) >= 1) & (F.col("n_steps") >= index), F.lit(True)).otherwise(F.raise_error(short).cast("boolean")))
    return checked.where(F.col("step_index") == index)


def explode_calls(steps: DataFrame) -> DataFrame:
    """One row a call: the step's key and index, ``call_pos`` from 0, and the call's fields."""
    return steps.select(KEY, "step_index", F.posexplode("calls").alias("call_pos", "call")).select(KEY, "step_index", "call_pos", "call.*")


def call_key() -> Column:
    """Identity of all calls of a step, as an array; null for a step without calls."""
    return F.when(F.size("calls") > 0, F.transform("calls", lambda c: F.concat(c["name"], F.lit("("), c["args_key"], F.lit(")"))))


def compact_json(text: Column, limit: int = 80) -> Column:
    """JSON text without spaces after separators that stand outside strings, shortened."""
    return shorten(F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|(?<=[:,])\s+', "$1"), limit)


def summary(width: int = 160) -> Column:
    """One line for a step: ``[index] who: body``."""
    calls = F.array_join(F.transform("calls", lambda c: F.concat(c["name"], F.lit("("), compact_json(c["arguments"]), F.lit(")"))), ", ")
    result = F.concat(F.lit("<- "), F.when(F.col("result.is_error"), F.lit("ERROR ")).otherwise(F.lit("")), F.coalesce("result.content", F.lit("")))
    body = F.when(F.size("calls") > 0, F.concat(F.lit("-> "), calls)).when(F.col("result").isNotNull(), result).otherwise(F.coalesce("content", F.lit("")))
    who = F.coalesce(F.when(F.col("agent") != "", F.col("agent")), F.col("role"))
    return F.concat(F.lit("["), F.col("step_index").cast("string"), F.lit("] "), who, F.lit(": "), shorten(collapse(body), width))


def ordered_lines(line: Column | str, *order: Column | str) -> Column:
    """Aggregate: lines joined by line feeds in the given order."""
    row = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], (F.col(line) if isinstance(line, str) else line).alias("__line"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["__line"]), "\n")


def render(steps: DataFrame, first: int = 1, last: int | None = None, width: int = 160) -> DataFrame:
    """(traj_key, text): the summaries of an inclusive range of steps."""
    chosen = steps.where(F.col("step_index") >= max(1, first))
    chosen = chosen if last is None else chosen.where(F.col("step_index") <= last)
    return chosen.withColumn("__line", summary(width)).groupBy(KEY).agg(ordered_lines("__line", "step_index").alias("text"))
