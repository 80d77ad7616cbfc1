"""Command line: the console and the registered queries.

    python -m stockroom sql "SELECT * FROM v_revenue_by_category" --sf-dir /root/testdata/sf0.01
    python -m stockroom sql "..." --tables /path/to/stored/tables
    python -m stockroom query revenue_by_product --sf-dir /root/testdata/sf0.01 --out /path/out --format json
    python -m stockroom list

``--tables`` reads stored retail tables (see ``sources.tables``); ``--sf-dir``
derives them from the star-schema test data.  Without ``--out`` the first
``--show`` rows are printed (a display limit only); with ``--out`` the whole
result is written by Spark, one file per task.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="stockroom")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("sql", "query"):
        p = sub.add_parser(name)
        p.add_argument("text", help="SQL statement" if name == "sql" else "registered query name")
        src = p.add_mutually_exclusive_group(required=True)
        src.add_argument("--sf-dir", help="star-schema test data folder")
        src.add_argument("--tables", help="folder of stored retail tables")
        p.add_argument("--out", help="write the whole result here instead of printing")
        p.add_argument("--format", default="json", choices=("json", "parquet", "csv"))
        p.add_argument("--show", type=int, default=20)
        p.add_argument("--master", default="local[*]")
    sub.add_parser("list")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        from stockroom.plans.registry import all_queries
        print("\n".join(sorted(all_queries())))
        return 0

    from stockroom.session import build_session
    spark = build_session(args.master)
    if args.cmd == "sql":
        from stockroom.plans.console import ConsoleError, adhoc_sql
        from stockroom.sources.catalog import register_views
        if args.tables:
            from stockroom.sources.tables import read_retail_tables
            tables = read_retail_tables(spark, args.tables)
        else:
            from stockroom.sources.adapters import load_retail_from_star
            tables = load_retail_from_star(spark, args.sf_dir)
        register_views(spark, tables)
        try:
            df = adhoc_sql(spark, args.text).df
        except ConsoleError as e:
            print(f"error: {e}", file=sys.stderr)
            return 2
    else:
        from stockroom.plans.registry import all_queries
        queries = all_queries()
        if args.text not in queries:
            print(f"error: unknown query {args.text!r} (see `python -m stockroom list`)", file=sys.stderr)
            return 2
        if not args.sf_dir:
            print("error: registered queries read the star-schema test data (--sf-dir)", file=sys.stderr)
            return 2
        df = queries[args.text](spark, args.sf_dir)

    if args.out:
        from stockroom.sources.sinks import write_report
        write_report(df, args.out, args.format)
        print(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
