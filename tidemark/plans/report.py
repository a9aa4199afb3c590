"""Run the whole analysis and write every result table.

    python -m tidemark.plans.report --raw <csv folder> --silver <folder> --out <folder>
    python -m tidemark.plans.report --silver <folder> --out <folder>     # silver already built

Each result is written as its own Parquet table under ``out`` by the tasks
that computed it (per-person results such as the first delivered order are
as large as the customer base, so nothing is funnelled into one task; AQE
already merges the partitions of small aggregates).  Nothing is collected to
the driver.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.plans.analyses import NATIVE_PARAMS, Params, analyses
from tidemark.sources.tpch import Tables


def run_report(tables: Tables, out_dir: str, params: Params = NATIVE_PARAMS,
               only: list[str] | None = None) -> list[str]:
    """Compute and write each analysis; returns the names written."""
    written = []
    for name, fn in analyses(params).items():
        if only and name not in only:
            continue
        fn(tables).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
        written.append(name)
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--raw", help="folder of raw CSV exports (<table>.csv); builds silver first")
    ap.add_argument("--silver", required=True, help="silver Parquet folder")
    ap.add_argument("--out", required=True, help="output folder for result tables")
    ap.add_argument("--only", nargs="*", help="result names to compute")
    args = ap.parse_args(argv)

    from tidemark.session import get_session
    from tidemark.sources.native import build_silver, native_tables
    spark: SparkSession = get_session()
    if args.raw:
        build_silver(spark, args.raw, args.silver).write.mode("overwrite").parquet(f"{args.out}/row_counts")
    names = run_report(native_tables(spark, args.silver), args.out, NATIVE_PARAMS, args.only)
    print(f"wrote {len(names)} result tables to {args.out}")


if __name__ == "__main__":
    main()
