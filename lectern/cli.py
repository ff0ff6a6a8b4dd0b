"""Command line: ``python -m lectern PATH... [options]``. Exit code 2 if a file can't be read, 1 by --fail-on, else 0."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lectern", description="Audit the structure and text of PDF files.")
    p.add_argument("paths", nargs="*")
    p.add_argument("--source", help="original that the files are compared with")
    p.add_argument("--json", metavar="FILE", help="JSON report; - writes it to standard output and nothing else")
    p.add_argument("--sarif", metavar="FILE")
    p.add_argument("--html", metavar="FILE")
    p.add_argument("--only", action="append", default=[], help="rule ids, comma separated")
    p.add_argument("--skip", action="append", default=[])
    p.add_argument("--layer", action="append", choices=["conformance", "semantic"], default=[])
    p.add_argument("--fail-on", choices=["error", "warning", "never"], default="error")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--no-info", action="store_true")
    p.add_argument("--criteria", action="store_true")
    p.add_argument("--store", help="folder to keep the fact tables in")
    p.add_argument("--list-rules", action="store_true")
    p.add_argument("--version", action="version", version=__version__)
    return p


def _ids(values: list[str]) -> list[str]:
    return [x.strip() for v in values for x in v.split(",") if x.strip()]


def main(argv: list[str] | None = None, spark=None) -> int:
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(errors="replace", encoding="utf-8")
    a = parser().parse_args(argv)
    from . import sinks

    if a.list_rules:
        print(sinks.rule_list(), end="")
        return 0
    if not a.paths:
        parser().error("give a file or a folder")
    from .api import check
    from .sources.files import listed

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lectern").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    r = check(spark, listed(a.paths), a.source, _ids(a.only), _ids(a.skip), a.layer, store=a.store)
    if a.json == "-":
        print(sinks.json_report(r))
    else:
        print(sinks.text_report(r, a.quiet, not a.no_info, a.criteria), end="")
        for path, make in ((a.json, sinks.json_report), (a.sarif, sinks.sarif_report), (a.html, sinks.html_report)):
            if path:
                Path(path).write_text(make(r), encoding="utf-8")
    return r.exit_code(a.fail_on)


if __name__ == "__main__":
    sys.exit(main())
