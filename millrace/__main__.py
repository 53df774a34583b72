"""python -m millrace run|validate|estimate|rubric: exit code 0 done, 2 configuration, 3 input, 4 anything else."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from millrace.plans import config as config_
from millrace.plans import estimate, rubrics
from millrace.sources.jsonl import InputError


VERDICTS = ("labels", "scores", "outputs", "reviews")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "validate"):
        p = commands.add_parser(name)
        p.add_argument("config", nargs="+", help="TOML files, later ones over earlier ones")
        p.add_argument("--input")
        p.add_argument("--output")
        p.add_argument("--limit", type=int)
        if name == "run":
            for table in VERDICTS:
                p.add_argument(f"--{table}", help="Parquet table of verdicts")
            p.add_argument("--judge", help="base URL of a live judge, for all verdicts")
            p.add_argument("--dry-run", action="store_true", help="count what would be read and called, write nothing")
            p.add_argument("--model")
            p.add_argument("--wire", choices=("chat", "messages"), default="chat")
            p.add_argument("--key-env", action="append", default=[], help="environment variable that holds a key; may be repeated")
    p = commands.add_parser("estimate")
    p.add_argument("records", type=int)
    p = commands.add_parser("rubric")
    p.add_argument("name", choices=sorted(rubrics.RUBRICS))
    args = parser.parse_args(argv)
    if args.command == "rubric":
        print(json.dumps([{"criterion": c, "weight": w, "question": q} for c, w, q in rubrics.RUBRICS[args.name]], indent=1))
        return 0
    if args.command == "estimate":
        print(json.dumps(estimate.estimate(args.records, estimate.Run())))
        return 0
    try:
        config = config_.load(*[Path(c).read_text() for c in args.config], config_.from_environment(dict(os.environ)), overrides={"run": {"input": args.input, "output": args.output}})
    except (config_.ConfigError, OSError) as error:
        print(error, file=sys.stderr)
        return 2
    if args.command == "validate":
        print(f"valid, digest {config.digest}, stages {' '.join(config.stages())}")
        return 0
    from pyspark.sql import SparkSession

    from millrace.plans.live import run_live
    from millrace.plans.run import Verdicts, dry_run, run
    from millrace.sinks import trace

    try:
        spark = SparkSession.builder.getOrCreate()
        if args.dry_run:
            print(json.dumps(dry_run(spark, config, limit=args.limit)))
            return 0
        if args.judge:
            told = run_live(spark, config, _judge(args), limit=args.limit)
        else:
            verdicts = Verdicts(**{t: spark.read.parquet(path) for t in VERDICTS if (path := getattr(args, t))})
            told = run(spark, config, verdicts, limit=args.limit, strict=True)
        print(json.dumps(told))
        print("\n".join(trace.summary(told["counts"])), file=sys.stderr)
    except config_.ConfigError as error:
        print(error, file=sys.stderr)
        return 2
    except InputError as error:
        print(error, file=sys.stderr)
        return 3
    except Exception as error:  # told by its exit code
        print(error, file=sys.stderr)
        return 4
    return 0


def _judge(args: argparse.Namespace):
    """Maker of the live judge; keys are read where the command is run and go to the tasks with it."""
    from millrace.provider import HttpJudge, Profile

    profile = Profile("default", args.judge, args.model or "", tuple(os.environ.get(k, "") for k in args.key_env) or ("",), args.wire)
    return lambda: HttpJudge(profile)


if __name__ == "__main__":
    sys.exit(main())
