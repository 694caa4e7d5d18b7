"""Command line over stored tables: ``python -m threadmill stats|duplicates|export|export-posts|batch|list-formats|list-presets|list-platforms``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from threadmill import schema
from threadmill.operators import export, query
from threadmill.session import session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="threadmill")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("stats", "duplicates", "export", "export-posts", "batch"):
        p = sub.add_parser(name)
        p.add_argument("table", help="Parquet folder of comments or posts")
        p.add_argument("--client")
        p.add_argument("--platform", choices=schema.PLATFORMS)
        if name in ("export", "export-posts", "batch"):
            p.add_argument("--format", default="jsonl", choices=sorted(export.WRITERS))
            p.add_argument("--preset", choices=sorted(export.PRESETS))
            p.add_argument("--since")
            p.add_argument("--until")
            p.add_argument("--limit", type=int, default=0)
            p.add_argument("--to", required=True)
    for name in ("list-formats", "list-presets", "list-platforms"):
        sub.add_parser(name)
    args = parser.parse_args(argv)
    listed = {"list-formats": export.WRITERS, "list-presets": export.PRESETS, "list-platforms": schema.PLATFORMS}
    if args.command in listed:
        print(*sorted(listed[args.command]), sep="\n")
        return
    spark = session()
    ts = lambda x: F.lit(x).cast("timestamp") if x else None
    rows = query.select_rows(spark.read.parquet(args.table), args.client, args.platform, ts(getattr(args, "since", None)), ts(getattr(args, "until", None)), getattr(args, "limit", 0))
    if args.command == "stats":
        query.counts(rows, "client", "platform").orderBy("client", "platform").show(1000, truncate=False)
    elif args.command == "duplicates":
        query.duplicate_groups(rows, "client").orderBy(F.desc("n"), "text").show(50)
    elif args.command == "batch":
        export.write_by(rows, args.format, args.to, ["client", "platform"], export.preset(args.preset) if args.preset else None)
        print(args.to)
    else:
        print(export.write(rows, args.format, args.to, options=export.preset(args.preset) if args.preset else None))


if __name__ == "__main__":
    main()
