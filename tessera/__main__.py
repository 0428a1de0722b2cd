"""Command line: espec, inspect, validate, compare, generate, version (inventory P1-P5)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from tessera import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("espec", "inspect", "validate"):
        verbs.add_parser(verb).add_argument("path")
    both = verbs.add_parser("compare")
    both.add_argument("original")
    both.add_argument("compared")
    made = verbs.add_parser("generate")
    made.add_argument("path")
    for name, value in (("layers", 2), ("hidden", 64), ("heads", 4), ("intermediate", 128), ("vocab", 256), ("seed", 1)):
        made.add_argument(f"--{name}", type=int, default=value)
    verbs.add_parser("version")
    args = parser.parse_args(argv)
    if args.verb == "version":
        print(__version__)
        return 0
    from tessera.plans import models
    from tessera.session import session

    spark = session()
    if args.verb == "generate":
        models.generate(spark, args.path, args.layers, args.hidden, args.heads, args.intermediate, args.vocab, args.seed)
        return 0
    if args.verb == "compare":
        report = models.compare_models(spark, args.original, args.compared).first().asDict(recursive=True)
        print(json.dumps(report, indent=2, default=str))
        return 0 if report["status"] == "MATCH" else 1
    if args.verb == "validate":
        found = models.validate_files(spark, args.path)
        print(json.dumps([r.asDict() for r in found.orderBy("path", "message").collect()], indent=2))
        return 1 if found.filter(F.col("severity").isin("ERROR", "CRITICAL")).count() else 0
    print(json.dumps({k: [r.asDict(recursive=True) for r in df.collect()] for k, df in models.inspect(spark, args.path).items()}, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
