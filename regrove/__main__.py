"""Profile and train from a feature table.

`python -m regrove --root <shared folder> [--catalog dev] [--table NAME_OR_PATH] [--profile-only]`
"""

from __future__ import annotations

import argparse

from regrove.plans.exploration import profile_table, write_report
from regrove.plans.registry import compare_runs, read_runs
from regrove.plans.training import Settings, run_training
from regrove.session import get_spark
from regrove.sources.tables import DEFAULT_CATALOG, FEATURE_TABLE, load


def main() -> None:
    parser = argparse.ArgumentParser(prog="regrove")
    parser.add_argument("--root", required=True, help="shared folder for runs, models and aliases")
    parser.add_argument("--catalog", default=DEFAULT_CATALOG)
    parser.add_argument("--table", default=FEATURE_TABLE, help="table name, or a Parquet path")
    parser.add_argument("--key", default="DayNum,VehId,Trip", help="columns that identify a row")
    parser.add_argument("--exclude", default="", help="features to leave out, comma separated")
    parser.add_argument("--trials", type=int, default=25)
    parser.add_argument("--folds", type=int, default=5)
    parser.add_argument("--selection", choices=["validation", "test"], default="validation")
    parser.add_argument("--profile-only", action="store_true")
    args = parser.parse_args()

    spark = get_spark()
    table = load(spark, args.table, args.catalog)
    report = profile_table(table)
    write_report(report, f"{args.root.rstrip('/')}/profile")
    print(f"target: {report.target_status}; suggested exclusions: {report.exclusions}")
    if args.profile_only or report.target_status != "ok":
        return
    outcome = run_training(table, Settings(
        root=args.root, catalog=args.catalog, key=args.key.split(","), exclude=[c for c in args.exclude.split(",") if c],
        source_table=args.table if "/" in args.table else f"{args.catalog}.{args.table}",
        trials=args.trials, folds=args.folds, selection=args.selection,
    ))
    runs = compare_runs(read_runs(spark, f"{args.root.rstrip('/')}/log"))
    runs.coalesce(1).write.mode("overwrite").parquet(f"{args.root.rstrip('/')}/comparison")
    runs.show(runs.count(), truncate=False)
    print(outcome.registration)


if __name__ == "__main__":
    main()
