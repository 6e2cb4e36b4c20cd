"""Command line: ``python -m tracefold.cli COMMAND PATH`` over folders of run files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.labels import with_sequences
from tracefold.operators import align, cohorts, divergence, features, motifs, preferences
from tracefold.sources.trajectories import load_runs


def _print(df: DataFrame, as_json: bool, limit: int = 100) -> None:
    """Results are small reports; at most ``limit`` rows are shown."""
    if as_json:
        print(json.dumps([json.loads(r) for r in df.limit(limit).toJSON().collect()], indent=2))
    else:
        df.show(limit, truncate=False)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracefold")
    parser.add_argument("command", choices=["validate", "summary", "features", "patterns", "divergence", "clusters", "diff", "export", "diagnose"])
    parser.add_argument("path")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--gapped", action="store_true", help="patterns: with anything between")
    parser.add_argument("--min-runs", type=int, default=10)
    parser.add_argument("--out", help="export: folder for JSON lines")
    parser.add_argument("--causes", help="diagnose: JSON file of candidate causes")
    for name in ("model", "harness", "task-family"):
        parser.add_argument(f"--{name}", default="")
    parser.add_argument("--by", default="harness", help="diff, diagnose: the field that tells two variants apart")
    parser.add_argument("--baseline", default="")
    parser.add_argument("--current", default="")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tracefold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    loaded, rejects = load_runs(spark, args.path)
    if args.command == "validate":
        _print(rejects, args.json)
        return int(not rejects.isEmpty())
    runs = with_sequences(cohorts.filter_runs(loaded, model=args.model, harness=args.harness, task_family=args.task_family))
    if runs.isEmpty():
        print("no runs", file=sys.stderr)
        return 1
    if args.command == "summary":
        _print(cohorts.summary(runs), args.json)
        _print(cohorts.top_signatures(runs), args.json)
    elif args.command == "features":
        _print(features.rank_features(runs, args.min_runs), args.json)
    elif args.command == "patterns":
        _print(motifs.find_gapped(runs, 3) if args.gapped else motifs.find_motifs(runs), args.json)
    elif args.command == "divergence":
        mixed = cohorts.in_tasks(runs, cohorts.mixed_tasks(runs))
        _print(divergence.divergence_points(align.aligned_cells(mixed)), args.json)
    elif args.command == "clusters":
        _print(align.clusters(runs), args.json)
    elif args.command == "export":
        lines = preferences.as_dpo(preferences.preference_pairs(cohorts.in_tasks(runs, cohorts.mixed_tasks(runs))))
        lines.write.text(args.out) if args.out else _print(lines, args.json)
    elif args.command == "diff":
        a, b = (runs.where(F.col(args.by) == v) for v in (args.baseline, args.current))
        _print(cohorts.exclusive_signatures(a, b), args.json)
    else:
        shifts = cohorts.variant_shifts(runs, args.by, args.baseline, args.current)
        _print(shifts, args.json)
        if args.causes:
            with open(args.causes) as f:
                _print(cohorts.score_causes(shifts, json.load(f)).orderBy(F.desc("score")), args.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
