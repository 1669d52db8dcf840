"""Command line: write the analysis marts, or print one analysis.

    python -m emporia marts --csv /data/marketplace --out /warehouse/marts
    python -m emporia marts --testdata /root/testdata/sf0.1 --out /tmp/marts
    python -m emporia show top_customers --testdata /root/testdata/sf0.01 [--rows 20]
    python -m emporia list

The session comes from ``SparkSession.builder.getOrCreate()``, so
``spark-submit`` settings (master, executors, ``spark.checkpoint.dir``) apply.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _roles(spark: SparkSession, args):
    if args.csv:
        from emporia.sources.io import read_csv_roles

        return read_csv_roles(spark, args.csv)
    if args.parquet:
        from emporia.sources.io import read_parquet_roles

        return read_parquet_roles(spark, args.parquet)
    from emporia.sources.roles import bind_testdata

    return bind_testdata(spark, args.testdata)


def main(argv: list[str] | None = None) -> int:
    from emporia.plans.catalog import ANALYSES

    ap = argparse.ArgumentParser(prog="emporia")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list analysis names")
    for name in ("marts", "show"):
        p = sub.add_parser(name)
        if name == "show":
            p.add_argument("analysis", choices=sorted(ANALYSES))
            p.add_argument("--rows", type=int, default=20)
        src = p.add_mutually_exclusive_group(required=True)
        src.add_argument("--csv", help="folder with the marketplace dataset CSV files")
        src.add_argument("--parquet", help="folder written by emporia.sources.io.write_roles")
        src.add_argument("--testdata", help="folder with the TPC-H-like test tables")
        if name == "marts":
            p.add_argument("--out", required=True)
            p.add_argument("--only", nargs="*", help="analysis names (default: all)")
            p.add_argument("--concurrency", type=int, default=4,
                           help="analyses submitted at once (default 4)")
    args = ap.parse_args(argv)

    if args.cmd == "list":
        print("\n".join(ANALYSES))
        return 0
    spark = SparkSession.builder.appName("emporia").getOrCreate()
    from emporia.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    t = _roles(spark, args)
    if args.cmd == "show":
        ANALYSES[args.analysis].run(t).show(args.rows, truncate=False)
        return 0
    from emporia.sources.io import write_marts

    for name, path in write_marts(t, args.out, names=args.only, concurrency=args.concurrency).items():
        print(f"{name}\t{path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
