"""python -m pathloom FILE [--samples N] [--collapse PATH]... [--keep PATH]... [--variable-key RULE]... [--keep-key RULE]...

Prints the schema of an export as JSON; an export that can't be read at all is an error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from pathloom.schema import nodes_of
from pathloom.sources import documents
from pathloom.sources.archives import Limits


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = argparse.ArgumentParser(prog="pathloom", description="The schema of an export as JSON.")
    args.add_argument("file")
    args.add_argument("--samples", type=int, default=0, help="values to keep of each data point, masked where they identify")
    args.add_argument("--collapse", action="append", default=[], metavar="PATH", help="the folders in this one become one")
    args.add_argument("--keep", action="append", default=[], metavar="PATH", help="the folders in this one never become one")
    args.add_argument("--variable-key", action="append", default=[], metavar="RULE", help="keys of this path become a pattern")
    args.add_argument("--keep-key", action="append", default=[], metavar="RULE", help="keys of this path stay")
    given = args.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("pathloom").getOrCreate()
    limits = Limits(collapse_folders=tuple(given.collapse), keep_folders=tuple(given.keep))
    try:
        nodes = nodes_of(spark, given.file, limits, given.samples, given.variable_key, given.keep_key).cache()
        failed = nodes.where("path = '' and kind = 'unmatched'").select("error", "reason").first()
        if failed is not None:
            sys.stderr.write(f"error: {failed.error or failed.reason}\n")
            return 1
        print(documents.to_documents(nodes).first().document)
    except (OSError, PySparkException) as e:
        sys.stderr.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
