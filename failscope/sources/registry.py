"""Readers by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from failscope.sources.benchmarks import read_retail, read_team
from failscope.sources.canonical import read_traces
from failscope.sources.langfuse import read_langfuse
from failscope.sources.langsmith import read_langsmith
from failscope.sources.otel import read_otel

READERS = {"canonical": read_traces, "otel": read_otel, "langfuse": read_langfuse, "langsmith": read_langsmith, "retail": read_retail, "team": read_team}


def load(spark: SparkSession, path: str, adapter: str = "canonical") -> tuple[DataFrame, DataFrame]:
    """(trajectories, steps) of ``path``; fails for names without a reader."""
    if adapter not in READERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(sorted(READERS))}")
    return READERS[adapter](spark, path)
