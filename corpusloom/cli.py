"""Command line: check a table, or check and fix it."""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from corpusloom.config import CheckerConfig, read_settings
from corpusloom.outcome import ERROR, WARNING, Outcome
from corpusloom.plans import report as reports
from corpusloom.plans.runner import check_table, fix_table, merge_config
from corpusloom.sources.loader import check_output_path, load_dataset, save_dataset
from corpusloom.sources.session import scratch

OK, WARNINGS, ERRORS, FAILED = 0, 1, 2, 3
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusloom", description="Check the quality of a text table, and repair it.")
    p.add_argument("dataset_id", help="path of a table, on any file system that Spark reads")
    p.add_argument("--split", default="train", help="which split (default: %(default)s)")
    p.add_argument("--text-field", default="text", help="name of the text column (default: %(default)s)")
    p.add_argument("--config", help="YAML file of settings")
    p.add_argument("--output", choices=["rich", "json"], default="rich", help="plain text or JSON (default: %(default)s)")
    p.add_argument("--fix", action="store_true", help="clean texts and remove rows")
    p.add_argument("--fix-output", help="where to write the fixed table")
    p.add_argument("--sample-size", type=int, help="how many rows to look at")
    p.add_argument("--skip-checker", action="append", default=[], help="a check to leave out; may be repeated")
    p.add_argument("--dry-run", action="store_true", help="tell what a fix would do, write nothing")
    p.add_argument("--id-column", help="unique integer column that numbers rows (default: position)")
    return p


def exit_code(outcome: Outcome) -> int:
    return ERRORS if outcome.count(ERROR) else WARNINGS if outcome.count(WARNING) else OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run; returns the exit code, which follows the report before any fix."""
    args = parser().parse_args(argv)
    as_json = args.output == "json" or not sys.stdout.isatty()

    def fail(message: str, code: int) -> int:
        print(reports.error_text(message, as_json), file=sys.stderr)
        return code

    if _CONTROL.search(args.dataset_id):
        return fail("DATASET_ID contains control characters. Only printable characters are allowed.", WARNINGS)
    try:
        if args.config:
            config = read_settings(args.config)
        else:
            config = CheckerConfig()
        config = merge_config(config, args.sample_size, args.skip_checker)
        if args.fix and args.fix_output and not args.dry_run:
            check_output_path(args.fix_output)
    except Exception as e:  # noqa: BLE001
        return fail(str(e), FAILED)
    spark = spark or SparkSession.builder.appName("corpusloom").getOrCreate()
    with scratch(spark):
        return _run(spark, args, config, as_json, fail)


def _run(spark: SparkSession, args: argparse.Namespace, config: CheckerConfig, as_json: bool, fail: Callable[[str, int], int]) -> int:
    try:
        df = load_dataset(spark, args.dataset_id, args.split, args.text_field, config.sample_size, args.id_column)
    except Exception as e:  # noqa: BLE001
        return fail(f"Failed to load dataset '{args.dataset_id}': {e}", FAILED)
    told = {"dataset_id": args.dataset_id, "split": args.split}
    before = check_table(df, args.text_field, config, args.id_column, **told)
    stats, after = None, None
    if args.fix or args.dry_run:
        fixed, stats, after = fix_table(df, args.text_field, config, args.id_column, **told)
        removed = stats["filter_stats"]["total_rows_removed"]
        if args.dry_run:
            if not as_json:
                print(f"Dry-run: {stats['total_fixed']} rows would be modified, {removed} rows would be removed.")
        elif args.fix_output:
            save_dataset(fixed, args.fix_output)
            if not as_json:
                print(f"Fixed dataset saved to: {args.fix_output}")
    if as_json:
        reports.write_json(sys.stdout, before, stats, after)
    else:
        sys.stdout.write(reports.text(before, stats, after))
    return exit_code(before.outcome)


if __name__ == "__main__":
    sys.exit(main())
