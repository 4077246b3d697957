"""Curate a CSV of sentence pairs into split tables.

usage: spark-submit --py-files parallax.zip tools/curate.py --raw_csv FILE --out DIR [--normalize] [--avoid_equal_text]

FILE has the columns egyptian_arabic and formal_arabic. Writes DIR/generation and DIR/detection,
partitioned by split, and prints the stage counts. The session's settings are the submitter's;
spark.checkpoint.dir must name a shared folder.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(args: list[str] | None = None) -> dict[str, int]:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--raw_csv", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--normalize", action="store_true")
    ap.add_argument("--avoid_equal_text", action="store_true")
    options = ap.parse_args(args)

    from pyspark.sql import SparkSession

    from parallax.plans.jobs import curate_file

    spark = SparkSession.builder.appName("parallax-curate").getOrCreate()
    made = curate_file(spark, options.raw_csv, options.out, options.normalize, options.avoid_equal_text)
    counts = {r["stage"]: r["n"] for r in made["counts"].collect()}
    for stage, n in counts.items():
        print(f"{stage}: {n}")
    return counts


if __name__ == "__main__":
    main()
