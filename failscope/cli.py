"""``python -m failscope.cli``: detect and diagnose from a terminal.

    detect PATH [--adapter NAME] [--threshold X]
    analyze PATH [--adapter NAME] [--base-url URL --model NAME] [--all] [--json]
    bench TRACES TRUTH [--adapter NAME] [--system NAME ...] [--tier NAME --model NAME] [--repeats N] [--limit N] [--detection-only] [--out DIR]
    report RESULTS [--compare OTHER]
    version
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import __version__
from failscope.operators import bench, detect, judge, scoring, signals, tables
from failscope.operators.clients import TIERS, ChatClient, build_client
from failscope.sources.benchmarks import read_ground_truth
from failscope.sources.registry import READERS, load


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="failscope")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("detect", "analyze"):
        command = commands.add_parser(name)
        command.add_argument("path")
        command.add_argument("--adapter", default="canonical", choices=sorted(READERS))
        command.add_argument("--threshold", type=float, default=detect.THRESHOLD)
    command.add_argument("--base-url")
    command.add_argument("--model", default="small")
    command.add_argument("--system", default="filtered-log", choices=sorted(judge.SYSTEMS))
    command.add_argument("--all", action="store_true", help="diagnose traces that look healthy too")
    command.add_argument("--json", action="store_true")
    bench = commands.add_parser("bench")
    bench.add_argument("path")
    bench.add_argument("truth")
    bench.add_argument("--adapter", default="canonical", choices=sorted(READERS))
    bench.add_argument("--domain", default="unknown")
    bench.add_argument("--system", action="append", choices=sorted(judge.SYSTEMS))
    bench.add_argument("--tier", choices=sorted(TIERS))
    bench.add_argument("--model")
    bench.add_argument("--base-url")
    bench.add_argument("--repeats", type=int, default=1)
    bench.add_argument("--limit", type=int, help="annotated traces of a domain, at most")
    bench.add_argument("--detection-only", action="store_true")
    bench.add_argument("--out", default="results")
    commands.add_parser("version")
    report = commands.add_parser("report")
    report.add_argument("results")
    report.add_argument("--compare")
    return out


def run_benchmark(args: argparse.Namespace, spark: SparkSession, trajectories: DataFrame, steps: DataFrame, events: DataFrame) -> int:
    failures, roots = read_ground_truth(spark, args.truth, args.domain)
    truth = scoring.ground_truth(failures, roots.select("trajectory_id", "root_failure_id"))
    print("Detection:\n" + tables.format_table(bench.detection_rates(trajectories, events, truth)))
    if args.detection_only:
        return 0
    systems = args.system or [s for s in judge.DEFAULT_SYSTEMS if args.tier or not judge.SYSTEMS[s].uses_model]
    if not args.tier and any(judge.SYSTEMS[s].uses_model for s in systems):
        print("a judge needs --tier; --system signals-only needs none")
        return 2
    if args.limit:
        trajectories = tables.limit_by_domain(trajectories, failures.groupBy("trajectory_id").agg(F.min("pos").alias("pos")), args.limit)
    tier, model, options = args.tier, args.model, {"api_key": os.environ.get("FAILSCOPE_API_KEY", "")} | ({"base_url": args.base_url} if args.base_url else {})
    rows = bench.run_bench(trajectories, steps, events, truth, args.out, systems, (lambda: build_client(tier, model, **options)) if tier else None, tier or "signals", args.repeats)
    print("\n" + tables.format_table(rows, [c for c in ("domain", "system", *bench.SHOWN, "repeats") if c in rows.columns]))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(f"failscope {__version__}")
        return 0
    spark = spark or SparkSession.builder.appName("failscope").getOrCreate()
    if args.command == "report":
        rows = spark.read.json(args.results)
        print(tables.run_report(rows))
        if args.compare:
            print("\n" + tables.format_table(scoring.compare_runs(spark.read.json(args.compare), rows).orderBy("domain", "system")))
        return 0
    trajectories, steps = load(spark, args.path, args.adapter)
    if trajectories.limit(1).count() == 0:
        print("no trajectories")
        return 1
    sized = steps.join(trajectories.select("traj_key", "tool_schemas"), "traj_key")
    events = signals.run_signals(sized).persist()
    if args.command == "bench":
        return run_benchmark(args, spark, trajectories, sized, events)
    verdicts = detect.verdicts(trajectories, events, args.threshold)
    if args.command == "detect":
        print(tables.format_table(tables.detection_table(trajectories, verdicts, events).drop("traj_key").orderBy(F.desc("confidence"), "trajectory_id")))
        total = tables.detection_summary(verdicts).first()
        print(f"{total.failed}/{total.total} trajectories look failed")
        return 0
    chosen = trajectories if args.all else tables.failed_only(trajectories, verdicts)
    system = judge.SYSTEMS[args.system]
    if system.uses_model and not args.base_url:
        print("a judge needs --base-url; --system signals-only needs none")
        return 2
    model, url, key = args.model, args.base_url, os.environ.get("FAILSCOPE_API_KEY", "")
    own = sized.join(chosen.select("traj_key"), "traj_key", "left_semi")
    reports = judge.diagnose(chosen, own, events.join(chosen.select("traj_key"), "traj_key", "left_semi"), system, (lambda: ChatClient(model, url, key)) if system.uses_model else None, model)
    out = judge.as_json(reports).select(F.col("json").alias("text")) if args.json else judge.render_reports(reports, events).select("text")
    for row in out.toLocalIterator():
        print(row.text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
