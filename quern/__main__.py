"""Command line: ``python -m quern WordCount in out`` and so on.

TeraGen takes a number of rows in place of the input.
"""

from __future__ import annotations

import argparse

from quern.operators.records import DEFAULT_ROWS
from quern.plans import registry
from quern.session import session


def main() -> None:
    parser = argparse.ArgumentParser(prog="quern", description="Run one job over text files.")
    parser.add_argument("job", choices=[*registry.JOBS, "TeraGen", "TeraSort", "TeraValidate"])
    parser.add_argument("input", help=f"folder of text files; for TeraGen the rows (for example {DEFAULT_ROWS})")
    parser.add_argument("output", help="folder to write, replacing what is there")
    parser.add_argument("-m", "--maps", type=int, help="tasks that generate rows")
    parser.add_argument("-r", "--reduces", type=int, help="partitions of a sort, or of any shuffle")
    parser.add_argument("--model", help="centroids for Classification and Kmeans")
    parser.add_argument("--master", help="Spark master, if spark-submit does not give one")
    args = parser.parse_args()
    conf = {"spark_sql_shuffle_partitions": str(args.reduces)} if args.reduces else {}
    spark = session(f"quern {args.job}", args.master, **conf)
    try:
        if args.job == "TeraGen":
            registry.run_generate(spark, int(args.input), args.output, args.maps)
        elif args.job == "TeraSort":
            parts = args.reduces or int(spark.conf.get("spark.sql.shuffle.partitions"))
            registry.run_sort(spark, args.input, args.output, parts)
        elif args.job == "TeraValidate":
            registry.run_validate(spark, args.input, args.output)
        else:
            registry.run_job(spark, args.job, args.input, args.output, args.model)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
