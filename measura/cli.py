"""Command line: list, show, run, options, doctor."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from importlib import import_module


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="measura", description="Interval and sequence analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    p.add_argument("--registry", action="append", default=[], help="module with further queries (a collect function), such as the registry of a subpackage")
    sub.add_parser("list", help="names of the registered queries")
    sub.add_parser("options", help="options of a run as JSON")
    sub.add_parser("doctor", help="versions of what is installed")
    for name, text in (("show", "plan of a query"), ("run", "result of a query")):
        s = sub.add_parser(name, help=text)
        s.add_argument("query")
        s.add_argument("data", help="folder of Parquet tables")
        s.add_argument("--master", default=None)
        if name == "run":
            s.add_argument("--rows", type=int, default=20)
            s.add_argument("--write", default=None, help="write Parquet here instead of printing rows")
    return p


def main(argv: Sequence[str] | None = None) -> int:
    """0 on success, 2 for an unknown query."""
    a = parser().parse_args(argv)
    if a.command == "options":
        from measura.config import describe

        print(json.dumps(describe(), ensure_ascii=False, indent=1))
        return 0
    if a.command == "doctor":
        from importlib.metadata import PackageNotFoundError, version

        found = {}
        for name in ("pyspark", "pyarrow", "pandas", "numpy", "regex"):
            try:
                found[name] = version(name)
            except PackageNotFoundError:
                found[name] = None
        print(json.dumps({"python": sys.version.split()[0], **found}))
        return 0
    from measura.plans.registry import collect

    queries = collect()[0]
    for name in a.registry:
        queries |= import_module(name).collect()[0]
    if a.command == "list":
        print("\n".join(sorted(queries)))
        return 0
    if a.query not in queries:
        print(f"no query named {a.query}", file=sys.stderr)
        return 2
    from measura.session import build_session

    df = queries[a.query](build_session("measura", a.master), a.data)
    if a.command == "show":
        df.explain("formatted")
    elif a.write:
        df.write.mode("error").parquet(a.write)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
