"""The command line: ``prepare`` a CSV file, or ``compare`` two."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .compare_report import save_compare_pdf
from .functions import columns as fc
from .sources.tables import read_csv, write_outputs
from .types import PRESETS, FeatureConfig, SemanticType


class Refused(Exception):
    """What the user is told before the program ends."""


SWITCHES = ("interactions", "datetime-cyclical", "datetime-deltas", "clustering", "text-features", "text-tfidf")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tablewright", description="Prepares tables and explains every decision.")
    commands = out.add_subparsers(dest="command", required=True)
    p = commands.add_parser("prepare", help="prepare a CSV file")
    p.add_argument("file")
    p.add_argument("--target", required=True)
    p.add_argument("--task", default="classification")
    p.add_argument("--model-hint", default="tree")
    p.add_argument("--preset")
    p.add_argument("--drop-threshold", type=float)
    p.add_argument("--outlier-method")
    p.add_argument("--cardinality-threshold", type=int)
    p.add_argument("--output-dir", default=".")
    p.add_argument("--verbose", action="store_true")
    for name in SWITCHES:
        p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--interaction-top-k", type=int)
    p.add_argument("--interaction-types", help="comma-separated")
    p.add_argument("--datetime-reference-col")
    p.add_argument("--cluster-k")
    p.add_argument("--cluster-features", help="comma-separated, or numeric_only")
    p.add_argument("--text-tfidf-top-k", type=int)
    p.add_argument("--column-type", action="append", default=[], metavar="NAME:TYPE")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--save-pdf")
    c = commands.add_parser("compare", help="prepare two CSV files and compare the results")
    c.add_argument("file_a")
    c.add_argument("file_b")
    c.add_argument("--target-a", required=True)
    c.add_argument("--target-b", required=True)
    c.add_argument("--output-pdf", required=True)
    c.add_argument("--task-a", default="classification")
    c.add_argument("--task-b", default="classification")
    c.add_argument("--preset")
    return out


def table(spark: SparkSession, path: str, target: str):
    if not os.path.isfile(path):
        raise Refused(f"The file {path} does not exist.")
    if not path.lower().endswith(".csv"):
        raise Refused(f"The file {path} is not a .csv file.")
    try:
        df = read_csv(spark, path)
    except Exception as e:  # whatever the reader makes of it, the user learns that the file could not be read
        raise Refused(f"The file {path} cannot be read: {e}") from e
    if target in df.columns and not df.agg(F.count(fc.named(target))).first()[0]:
        raise Refused(f"The target column '{target}' has no values.")
    return df


def feature_config(args: argparse.Namespace) -> FeatureConfig | None:
    """A configuration if some flag asks for one, on top of the preset's."""
    given = {name.replace("-", "_"): getattr(args, name.replace("-", "_")) for name in SWITCHES}
    given |= {
        "interaction_top_k": args.interaction_top_k, "datetime_reference_col": args.datetime_reference_col,
        "text_tfidf_top_k": args.text_tfidf_top_k,
    }
    split = lambda text: [x.strip() for x in text.split(",") if x.strip()]
    if args.interaction_types:
        given["interaction_types"] = split(args.interaction_types)
    if args.cluster_features:
        given["cluster_features"] = args.cluster_features if args.cluster_features == "numeric_only" else split(args.cluster_features)
    if args.cluster_k:
        if args.cluster_k != "auto" and not args.cluster_k.isdigit():
            raise Refused("--cluster-k must be 'auto' or a whole number.")
        given["cluster_k"] = args.cluster_k if args.cluster_k == "auto" else int(args.cluster_k)
    given = {k: v for k, v in given.items() if v is not None}
    if not given:
        return None
    base = (PRESETS[args.preset]["feature_config"] if args.preset else None) or FeatureConfig()
    return replace(base, **given)


def column_types(listed: list[str]) -> dict[str, SemanticType] | None:
    out = {}
    for item in listed:
        name, _, kind = item.rpartition(":")
        if not name or kind.upper() not in SemanticType.__members__:
            raise Refused(f"--column-type takes NAME:TYPE with one of {', '.join(SemanticType.__members__)}, not {item!r}.")
        out[name] = SemanticType[kind.upper()]
    return out or None


def run_prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.preset is not None and args.preset not in PRESETS:
        raise Refused(f"There is no preset '{args.preset}'; there are {', '.join(sorted(PRESETS))}.")
    if args.drop_threshold is not None and not 0 <= args.drop_threshold <= 1:
        raise Refused("--drop-threshold must be from 0 to 1.")
    if args.cardinality_threshold is not None and args.cardinality_threshold <= 0:
        raise Refused("--cardinality-threshold must be positive.")
    df = table(spark, args.file, args.target)
    settings = {k: v for k in ("drop_threshold", "outlier_method", "cardinality_threshold") if (v := getattr(args, k)) is not None}
    if (config := feature_config(args)) is not None:
        settings["feature_config"] = config
    result = api.prepare(
        df, args.target, args.task, args.model_hint, column_types=column_types(args.column_type), preset=args.preset,
        dry_run=args.dry_run, **settings,
    )
    written = write_outputs(result, args.file, args.output_dir)
    if args.save_pdf:
        result.report.save_pdf(args.save_pdf)
        written["pdf"] = args.save_pdf
    if args.verbose:
        result.report.show(verbose=True)
    print(f"Success! Resulting shape: {(result.df.count(), len(result.df.columns))}")
    for kind, path in written.items():
        print(f"Wrote {kind}: {path}")


def run_compare(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.preset is not None and args.preset not in PRESETS:
        raise Refused(f"There is no preset '{args.preset}'; there are {', '.join(sorted(PRESETS))}.")
    sides = ((args.file_a, args.target_a, args.task_a), (args.file_b, args.target_b, args.task_b))
    results = [api.prepare(table(spark, f, t), t, task, preset=args.preset) for f, t, task in sides]
    save_compare_pdf(*results, args.output_pdf)
    print(f"Wrote pdf: {args.output_pdf}")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tablewright").getOrCreate()
    try:
        (run_prepare if args.command == "prepare" else run_compare)(spark, args)
    except (Refused, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
