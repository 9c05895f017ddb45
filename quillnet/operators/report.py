"""Labels, ranked clusters, histograms and bucketed frequency tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def community_count(members: DataFrame) -> DataFrame:
    """One row: the number of communities."""
    return members.select("community").distinct().agg(F.count("*").alias("communities"))


def rank_clusters(nodes: DataFrame, key: str = "community", drop_ties: bool = False) -> DataFrame:
    """Nodes (id, key, wdegree) with their rank in the cluster by weighted degree; drop_ties keeps the first of equal degrees only."""
    nodes = nodes.withColumn("wdegree", F.round("wdegree", 6))
    if drop_ties:
        nodes = nodes.groupBy(key, "wdegree").agg(F.min("id").alias("id"))
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("wdegree"), "id")))


def label_nodes(nodes: DataFrame, key: str = "community") -> DataFrame:
    """Labels ``c.n``: the cluster, and the node's number in it."""
    ranked = rank_clusters(nodes, key)
    return ranked.withColumn("label", F.concat_ws(".", F.col(key).cast("string"), F.col("rank").cast("string")))


def histogram(values: DataFrame, column: str, low: float, width: float, bins: int) -> DataFrame:
    """bin (0-based) and count of values from low on; the last bin is closed."""
    b = F.least(F.floor((F.round(column, 9) - low) / width), F.lit(bins - 1)).cast("int")
    return values.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def sturges_breaks(n: int, low: float, high: float) -> tuple[float, int, int]:
    """Cells (width, first, last): breaks at width times first..last that cover low..high, about log2(n) + 1 cells of a round width.

    The width is 1, 2, 5 or 10 times a power of ten, by the thresholds of R's pretty().
    """
    want = math.ceil(math.log2(max(n, 1)) + 1)
    cell = (high - low) / want or 1.0
    base = 10.0 ** math.floor(math.log10(cell))
    # fixed values: thresholds of the multiples
    times = next((m for m, most in ((1, 1.4), (2, 2.8), (5, 7.0)) if cell / base <= most), 10)
    width = times * base
    return width, math.floor(low / width + 1e-7), math.ceil(high / width - 1e-7)


def sturges_histogram(values: DataFrame, column: str) -> DataFrame:
    """bin (0-based), low, high and count of values in cells of Sturges' number and a round width, closed on the right, the first one on both sides."""
    x = F.round(column, 9)
    known = values.where(F.col(column).isNotNull())
    n, low, high = known.agg(F.count("*"), F.min(x), F.max(x)).first()  # one row
    width, first, last = sturges_breaks(n, low or 0.0, high or 0.0)
    place = F.ceil(F.round(x / width, 6) - first) - 1
    bins = known.select(F.greatest(F.least(place, F.lit(max(last - first - 1, 0))), F.lit(0)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    edge = lambda k: F.round((F.col("bin") + (first + k)) * width, 9)
    return bins.select("bin", edge(0).alias("low"), edge(1).alias("high"), "n")


def between(edges: DataFrame, column: str, low: int, high: int | None = None) -> DataFrame:
    kept = edges.where(F.col(column) >= low)
    return kept if high is None else kept.where(F.col(column) <= high)


def bucket_table(edges: DataFrame, column: str, most: int) -> DataFrame:
    """Counts of 1..most, zeros kept, and of all above as ``most+1`` with a plus."""
    name = F.when(F.col(column) <= most, F.col(column).cast("string")).otherwise(F.lit(f"{most + 1}+"))
    counts = edges.where(F.col(column) >= 1).groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))
    spark = edges.sparkSession
    every = spark.createDataFrame([(str(k),) for k in range(1, most + 1)] + [(f"{most + 1}+",)], "bucket string")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
