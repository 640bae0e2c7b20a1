"""Command line: scan, mirror and repair."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from ledgerloom.plans import operations
from ledgerloom.sources.storage import Options, archive, configure


def parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("-c", "--concurrency", type=int, default=32, help="tasks that run at once (shuffle partitions)")
    shared.add_argument("--skip-optional", action="store_true", help="leave out consensus files")
    shared.add_argument("--low", type=int, help="first ledger, rounded down to a checkpoint")
    shared.add_argument("--high", type=int, help="last ledger, rounded up to a checkpoint")
    shared.add_argument("--verify", action="store_true", help="check the content of all files, not only that they exist")
    shared.add_argument("--report", help="write a JSON report (of repair --dry-run: a plan)")
    shared.add_argument("--root-pointer", help="file name of the root pointer; found by itself in file archives")
    shared.add_argument("--phases", action="store_true", help="log calls, bytes and time of each phase")
    shared.add_argument("--debug", action="store_true")
    shared.add_argument("--trace", action="store_true")
    shared.add_argument("--max-retries", type=int, default=3)
    shared.add_argument("--retry-min-delay-ms", type=int, default=100)
    shared.add_argument("--retry-max-delay-secs", type=int, default=30, help="accepted; delays are capped at 5 s")
    shared.add_argument("--max-concurrent", type=int, default=128, help="accepted; executor cores limit concurrency")
    shared.add_argument("--timeout-secs", type=int, default=30)
    shared.add_argument("--io-timeout-secs", type=int, default=300)
    shared.add_argument("--bandwidth-limit", type=int, default=0, help="bytes per second of the run, shared by its tasks; 0 is unlimited")
    shared.add_argument("--atomic-file-writes", action="store_true")
    top = argparse.ArgumentParser(prog="ledgerloom")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", parents=[shared])
    one.add_argument("archive")
    for name in ("mirror", "repair"):
        two = commands.add_parser(name, parents=[shared])
        two.add_argument("source")
        two.add_argument("destination")
        if name == "mirror":
            two.add_argument("--overwrite", action="store_true")
            two.add_argument("--allow-mirror-gaps", action="store_true")
        else:
            two.add_argument("--plan", help="mend what this report lists")
            two.add_argument("--dry-run", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "repair" and args.plan and (args.dry_run or args.low is not None or args.high is not None):
        top.error("--plan excludes --dry-run, --low and --high")
    logging.basicConfig(level=logging.DEBUG if args.debug or args.trace else logging.INFO)
    options = Options(args.max_retries, args.retry_min_delay_ms / 1000, args.retry_max_delay_secs, args.timeout_secs, args.io_timeout_secs, args.bandwidth_limit, args.atomic_file_writes)
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    spark.conf.set("spark.sql.shuffle.partitions", args.concurrency)
    for url in (args.archive,) if args.command == "scan" else (args.source, args.destination):
        configure(spark, url)
    common = {"low": args.low, "high": args.high, "verify": args.verify, "skip_optional": args.skip_optional, "report_path": args.report, "root_pointer": args.root_pointer}
    log = logging.getLogger("ledgerloom")
    try:
        if args.command == "scan":
            done = operations.scan(spark, archive(args.archive, options), **common)
        elif args.command == "mirror":
            done = operations.mirror(spark, archive(args.source, options), archive(args.destination, options), overwrite=args.overwrite, allow_gaps=args.allow_mirror_gaps, **common)
        else:
            done = operations.repair(spark, archive(args.source, options), archive(args.destination, options), dry_run=args.dry_run, plan=args.plan, **common)
    except Exception as e:
        log.error("%s", e)
        _log_phases(log, args, getattr(e, "result", None))
        return 1
    _log_phases(log, args, next(iter(done.values()), None) if isinstance(done, dict) else done)
    return 0


def _log_phases(log: logging.Logger, args: argparse.Namespace, result: operations.Result | None) -> None:
    if args.phases and result is not None and result.phases is not None:
        for line in result.phases.lines():
            log.info("%s", line)


if __name__ == "__main__":
    sys.exit(main())
