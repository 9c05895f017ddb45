"""Command line of the three lifecycles: python -m quillnet network|clusters|statistics ...

    network CORPUS OUT     annotated files and coreference files (*.pron) of a folder to co-mentions, aliases and a network
    clusters NETWORK OUT   a network's communities, ranked and labelled
    statistics NETWORK     histograms of weights and frequency tables, as CSV on standard output
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .plans import lifecycle
from .sources import annotated, networks


def network(spark: SparkSession, corpus: str, out: str) -> DataFrame:
    """Writes comentions, aliases and network below ``out``; returns what failed (path, doc, error)."""
    files = annotated.scan_files(spark, corpus)
    chains = spark.read.text(f"{corpus}/*.pron", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    found, entities, failed = lifecycle.mentions_from_text(files, chains)
    found = graph._table(found, "mentions")
    totals = found.groupBy("doc").agg(F.count_distinct("sent").alias("total_sentences"))
    networks.write_comentions(found, totals, f"{out}/comentions")
    networks.write_aliases(entities, f"{out}/aliases")
    networks.write_network(lifecycle.build_network(found), f"{out}/network")
    return failed


def clusters(spark: SparkSession, path: str, out: str) -> None:
    networks.write_clusters(lifecycle.build_clusters(networks.read_network(spark, path)), f"{out}/clusters", "cluster")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillnet", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("lifecycle", choices=["network", "clusters", "statistics"])
    parser.add_argument("source")
    parser.add_argument("out", nargs="?")
    found = parser.parse_args(args)
    if found.lifecycle != "statistics" and not found.out:
        parser.error("a folder to write to is needed")
    spark = spark or SparkSession.builder.appName("quillnet").getOrCreate()
    if found.lifecycle == "network":
        failed = network(spark, found.source, found.out)
        some = failed.limit(20).collect()
        for r in some:
            print(f"{r['path']} {r['doc']}: {r['error']}", file=sys.stderr)
        return int(bool(some))
    if found.lifecycle == "clusters":
        clusters(spark, found.source, found.out)
        return 0
    for name, table in lifecycle.statistics(networks.read_network(spark, found.source)).items():
        print(f"# {name}\n{','.join(table.columns)}")
        for r in table.orderBy(table.columns[0]).collect():  # one row a cell or bucket
            print(",".join(map(str, r)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
