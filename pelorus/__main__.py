"""python -m pelorus: run, cv, show, rebuild and list experiments; archives; synthetic data; queries; info."""

from __future__ import annotations

import argparse
import datetime
import json
import sys

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    from pelorus import catalogue
    from pelorus.plans import config, console, experiment, logs
    from pelorus.plans.pipeline import registered
    from pelorus.sources import minutes

    parser = argparse.ArgumentParser(prog="pelorus")
    parser.add_argument("--log", default="WARNING", help="level of the log, which is lines of JSON on standard error")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("run", "cv"):
        p = sub.add_parser(name)
        p.add_argument("spec")
        p.add_argument("--out")
    sub.add_parser("show").add_argument("out")
    sub.add_parser("rebuild", help="the metrics of a report anew, from its tables").add_argument("out")
    sub.add_parser("list", help="the reports in a folder's folders").add_argument("folder")
    p = sub.add_parser("archive", help="move a report to the archives; without one list them")
    p.add_argument("archives")
    p.add_argument("--report")
    p.add_argument("--stamp", default="")
    p.add_argument("--keep", type=int, default=10)
    p = sub.add_parser("synth")
    p.add_argument("out")
    p.add_argument("--minutes", type=int, default=129_600)
    p.add_argument("--seed", type=int, default=42)
    sub.add_parser("info")
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("tables")
    args = parser.parse_args(argv)
    log = logs.configure(args.log)
    log.info("command", extra={"command": args.command})
    if args.command == "list":
        print(json.dumps(experiment.reports(args.folder), indent=2))
    elif args.command == "rebuild":
        print(json.dumps(experiment.rebuild(session(), args.out), indent=2, default=str))
    elif args.command == "archive":
        if args.report:
            console.archive(args.report, args.archives, args.stamp or datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%S"), args.keep)
        print(json.dumps(console.archived(args.archives)))
    elif args.command == "show":
        print(json.dumps(experiment.read_report(args.out), indent=2))
    elif args.command == "info":
        print(json.dumps({"stages": registered(), "queries": sorted(catalogue.queries())}, indent=2))
    elif args.command == "synth":
        minutes.write(minutes.synthetic(session(), args.minutes, args.seed), args.out)
    elif args.command == "query":
        catalogue.queries()[args.name](session(), args.tables).show(50, truncate=False)
    else:
        spec = config.load(args.spec)
        if args.command == "cv":
            spec = spec.model_copy(update={"mode": "cv"})
        print(json.dumps(experiment.run(session(), spec, args.out), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
