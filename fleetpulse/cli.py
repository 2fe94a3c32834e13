"""Command line: ``python -m fleetpulse.cli {screen,trends,hist} ...``."""

from __future__ import annotations

import argparse

from fleetpulse.plans import runs
from fleetpulse.session import build_session


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="fleetpulse")
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    p.add_argument("--shuffle-partitions", type=int, default=200)
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("screen", "trends", "hist"):
        s = sub.add_parser(name)
        s.add_argument("--product", required=True)
        s.add_argument("--telemetry", required=True, nargs="+")
        s.add_argument("--rules", required=True)
        s.add_argument("--out", required=True)
        s.add_argument("--encoding", default=None)
        if name in ("screen", "hist"):
            s.add_argument("--log", required=True, choices=["SMART", "Ext_SMART"])
        if name == "screen":
            s.add_argument("--weeks", type=int, default=2)
            s.add_argument("--no-kde", action="store_true")
            s.add_argument("--sample", action="store_true")
        if name == "trends":
            s.add_argument("--results", required=True, nargs="+")
    a = p.parse_args(argv)
    spark = build_session(a.master, a.shuffle_partitions)
    tel = a.telemetry if len(a.telemetry) > 1 else a.telemetry[0]
    if a.cmd == "screen":
        runs.screening_job(spark, a.product, a.log, tel, a.rules, a.out, n_weeks=a.weeks, kde=not a.no_kde,
                           sample=a.sample, encoding=a.encoding)
    elif a.cmd == "trends":
        runs.trend_job(spark, a.product, tel, a.rules, a.results, a.out, encoding=a.encoding)
    else:
        runs.histogram_job(spark, a.product, a.log, tel, a.rules, a.out, encoding=a.encoding)


if __name__ == "__main__":
    main()
