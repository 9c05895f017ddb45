"""The three lifecycles: network from annotated text, clusters of a network, statistics of its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cooccur, graph, mentions, report, resolve, sanitize, spans
from ..sources import annotated


def mentions_from_text(files: DataFrame, chain_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions, the entity dimension, and what failed (path, doc, error) of annotated files (path, content) and coreference files."""
    parsed = annotated.parse_documents(sanitize.repair_markup(files))
    chains = annotated.read_chains(chain_files)
    failed = parsed.where("error is not null").select("path", "doc", "error").union(chains.where("error is not null").selectExpr("string(null) as path", "doc", "error"))
    occurrences = spans.expand_coreferences(parsed.where("error is null"), chains).withColumn("ord", F.struct("doc", "seq"))
    resolved = graph._table(resolve.resolve_surfaces(occurrences), "resolved")
    return resolve.resolved_mentions(occurrences, resolved), resolve.entity_dimension(resolved), failed


def build_network(mention_table: DataFrame) -> DataFrame:
    """Ranked NPMI edges of a mention table."""
    kept = graph._table(mentions.interesting(mentions.distinct_mentions(mention_table)), "mentions")
    return cooccur.rank_edges(cooccur.npmi_edges(kept))


def build_clusters(edges: DataFrame, resolution: float = graph.RESOLUTION) -> DataFrame:
    """Labelled, ranked members of the communities of the filtered graph."""
    nodes, strong = graph.filtered_graph(edges)
    member = graph._table(graph.louvain(nodes, strong, resolution), "members")
    sized = graph.scale_size(graph.weighted_degree(strong))
    # communities are numbered within ranges of their ids plus the count of all ranges before
    named = graph._table(member.select("community").distinct().repartitionByRange("community").withColumn("part", F.spark_partition_id()), "communities")
    sizes = named.groupBy("part").agg(F.count("*").alias("c"))
    before = sizes.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a partition
    row = F.row_number().over(Window.partitionBy("part").orderBy("community"))
    numbered = named.withColumn("row", row).join(F.broadcast(before), "part").select("community", (F.col("row") + F.col("before") - 1).cast("int").alias("cluster"))
    return report.label_nodes(member.join(sized, "id").join(numbered, "community"), "cluster")


def statistics(edges: DataFrame) -> dict[str, DataFrame]:
    """Histograms of weights and frequency tables of documents and sentences, over unfiltered edges."""
    edges = graph._table(edges, "edges")
    return {
        "weights": report.sturges_histogram(edges, "npmi"),
        "weights_of_2_to_30_documents": report.sturges_histogram(report.between(edges, "documents", 2, 30), "npmi"),
        "weights_of_2_sentences": report.sturges_histogram(report.between(edges, "sentences", 2), "npmi"),
        "documents": report.bucket_table(edges, "documents", 5),
        "sentences": report.bucket_table(edges, "sentences", 7),
    }


def order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that orders mention: month, order, part."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_trunc("month", "o_orderdate").alias("doc"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey")
    n = graph.parts(items, o)
    items, o = graph.dealt(items, n, "l_orderkey"), graph.dealt(o, n, "o_orderkey")
    return items.join(o, items["l_orderkey"] == o["o_orderkey"]).select("doc", F.col("l_orderkey").alias("sent"), F.col("l_partkey").alias("ent"))


def line_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words that lines of documents mention: document, line, word."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("sent", "line"))
    names = lines.select("doc", F.col("sent").cast("long").alias("sent"), F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))).alias("ent"))
    return graph.dealt(names, graph.parts(names), "doc", "sent")
