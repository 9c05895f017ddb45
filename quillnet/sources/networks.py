"""XML files of co-mentions, aliases, networks and clusters, written and read; and a switch for kept intermediates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, root: str, row: str) -> str:
    df.write.mode("overwrite").option("rootTag", root).option("rowTag", row).format("xml").save(path)
    return path


def _read(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.option("rowTag", row).schema(schema).format("xml").load(path)


def write_network(edges: DataFrame, path: str) -> str:
    rows = edges.orderBy("npmi", "sentences", "documents", "a", "b").select(F.col("npmi").alias("_weight"), F.col("sentences").alias("_sentences"), F.col("documents").alias("_documents"), F.array(F.col("a").cast("string"), F.col("b").cast("string")).alias("node"))
    return _write(rows, path, "graph", "edge")


def read_network(spark: SparkSession, path: str) -> DataFrame:
    x = _read(spark, path, "edge", "_weight double, _sentences long, _documents long, node array<string>")
    return x.select(F.col("node")[0].alias("a"), F.col("node")[1].alias("b"), F.col("_weight").alias("npmi"), F.col("_sentences").alias("sentences"), F.col("_documents").alias("documents"))


def write_comentions(mentions: DataFrame, totals: DataFrame, path: str) -> str:
    """totals (doc, total_sentences) counts all sentences of a document."""
    sents = mentions.groupBy("doc", "sent").agg(F.array_sort(F.collect_list(F.col("ent").cast("string"))).alias("entity"))
    docs = sents.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("sent", "entity"))).alias("s")).join(totals, "doc")
    rows = docs.select(F.col("doc").cast("string").alias("_name"), F.col("total_sentences").alias("_sentences"), F.transform("s", lambda x: F.struct(x["entity"].alias("entity"))).alias("sentence"))
    return _write(rows, path, "corpus", "document")


def read_comentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions (doc, sent, ent) with sentences numbered from 0; a document that comes twice is an error."""
    x = _read(spark, path, "document", "_name string, _sentences long, sentence array<struct<entity:array<string>>>")
    twice = x.groupBy("_name").agg(F.count("*").alias("_n"))
    x = x.join(twice, "_name").select(F.when(F.col("_n") > 1, F.raise_error(F.lit("Duplicate document"))).otherwise(F.col("_name")).alias("doc"), F.posexplode("sentence").alias("sent", "s"))
    return x.select("doc", "sent", F.explode("s.entity").alias("ent"))


def write_aliases(entities: DataFrame, path: str) -> str:
    rows = entities.select(F.col("key").alias("_key"), F.col("aliases").alias("alias"))
    return _write(rows, path, "aliases", "entity")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """key, aliases (the key first); a key that comes twice is an error."""
    x = _read(spark, path, "entity", "_key string, alias array<string>").groupBy("_key").agg(F.count("*").alias("_n"), F.first("alias").alias("alias"))
    return x.select(F.when(F.col("_n") > 1, F.raise_error(F.lit("Duplicate key"))).otherwise(F.col("_key")).alias("key"), F.array_union(F.array("_key"), F.coalesce("alias", F.array().cast("array<string>"))).alias("aliases"))


def write_clusters(ranked: DataFrame, path: str, key: str = "community") -> str:
    """ranked: key, id, rank, wdegree, label."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("label").alias("_label"), F.col("wdegree").alias("_degree"), F.col("id").cast("string").alias("_VALUE")))), lambda m: F.struct(m["_label"].alias("_label"), m["_degree"].alias("_degree"), m["_VALUE"].alias("_VALUE")))
    return _write(ranked.groupBy(key).agg(members.alias("entity")).orderBy(key).select("entity"), path, "clusters", "cluster")


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    x = _read(spark, path, "cluster", "entity array<struct<_label:string,_degree:double,_VALUE:string>>")
    return x.select(F.posexplode("entity").alias("place", "e")).select("place", F.col("e._label").alias("label"), F.col("e._degree").alias("degree"), F.col("e._VALUE").alias("id"))


def gexf(nodes: list[tuple], edges: list[tuple]) -> str:
    """GEXF of a filtered graph's nodes (id, label) and edges (a, b, weight)."""
    from xml.sax.saxutils import quoteattr

    n = "".join(f"<node id={quoteattr(str(i))} label={quoteattr(str(label))}/>" for i, label in nodes)
    e = "".join(f'<edge id="{k}" source={quoteattr(str(a))} target={quoteattr(str(b))} weight="{w}"/>' for k, (a, b, w) in enumerate(edges))
    return f'<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>{n}</nodes><edges>{e}</edges></graph></gexf>'


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table kept at ``path`` if it is whole, else built anew and kept; ``refresh`` builds in any case."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if refresh or not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
