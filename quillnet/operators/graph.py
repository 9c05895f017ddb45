"""The weighted undirected graph of entities: filters, degrees, components, communities."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_SENTENCES, MIN_WEIGHT, MIN_SIZE, RESOLUTION = 2, 0.5, 3, 0.5


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="quillnet-")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share; a temporary one where none is set and all runs in this process."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not re.fullmatch(r"local(\[[^]]*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{there or _local_folder()}/{name}-{uuid.uuid4().hex}"


#: Folders of the intermediate tables written so far, by session.
_WRITTEN: dict[str, list[str]] = {}
#: Bytes of a row group of intermediate tables: a writer holds one in memory.
ROW_GROUP = 16 << 20


def _table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    spark = df.sparkSession
    path = _folder(spark, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many intermediate tables this session has written and not dropped."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def drop_tables(spark: SparkSession, but: DataFrame | None = None, since: int = 0) -> None:
    """Delete this session's intermediate tables from place ``since`` on, but those that ``but`` reads; frames that read others end here."""
    bare = lambda path: path.split(":")[-1].lstrip("/")
    used = set() if but is None else {bare(f.rsplit("/", 1)[0]) for f in but.inputFiles()}
    paths = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in [p for p in paths[since:] if bare(p) not in used]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        paths.remove(path)


#: Rows that a task of communities gives out at once, or a component more.
BATCH = 10_000
#: Bytes of input files behind one partition of a step that holds its rows in memory.
PART_BYTES = 4 << 20


def parts(*frames: DataFrame, times: int = 1) -> int:
    """Partitions in proportion to the files that frames read, ``times`` as many where a row becomes several; 0 if the engine's own number does."""
    sizes = {}
    for df in frames:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        for leaf in (leaves.apply(k) for k in range(leaves.size())):
            if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
                sizes[leaf.relation().location().rootPaths().mkString(",")] = int(str(leaf.stats().sizeInBytes()))
    n = math.ceil(times * sum(sizes.values()) / PART_BYTES)
    return n if n > frames[0].sparkSession.sparkContext.defaultParallelism else 0


def dealt(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows dealt by keys over ``parts``, so a task's memory does not grow with the input."""
    return df.repartition(n, *keys) if n else df


def weighted(edges: DataFrame) -> DataFrame:
    """Edges with the weight narrowed to single precision."""
    return edges.withColumn("weight", F.col("npmi").cast("float"))


def filter_sentences(edges: DataFrame, least: int = MIN_SENTENCES) -> DataFrame:
    return edges.where(F.col("sentences") >= least)


def filter_weight(edges: DataFrame, least: float = MIN_WEIGHT) -> DataFrame:
    return edges.where(F.col("weight") >= F.lit(least).cast("float"))


def filter_edges(edges: DataFrame, min_sentences: int = MIN_SENTENCES, min_weight: float = MIN_WEIGHT) -> DataFrame:
    return filter_weight(filter_sentences(edges, min_sentences), min_weight)


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge at both of its nodes: id, other, weight."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"), "weight").select("e.*", "weight")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()


def drop_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(vertices(edges), "id", "left_semi")


def check_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the labels of both nodes; an edge to an unknown node is an error."""
    a, b = nodes.select(F.col("id").alias("a"), F.col("label").alias("label_a")), nodes.select(F.col("id").alias("b"), F.col("label").alias("label_b"))
    known = edges.join(a, "a", "left").join(b, "b", "left")
    bad = F.col("label_a").isNull() | F.col("label_b").isNull()
    return known.withColumn("label_a", F.when(bad, F.raise_error(F.lit("Edge to an unknown node"))).otherwise(F.col("label_a")))


def degrees(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.count("*").alias("degree"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("id").agg(F.sum(F.col("weight").cast("double")).alias("wdegree"))


def scale_size(nodes: DataFrame, low: float = 4, high: float = 16) -> DataFrame:
    """Weighted degree scaled linearly to low..high; low where all are equal."""
    span = F.broadcast(nodes.agg(F.min("wdegree").alias("_lo"), F.max("wdegree").alias("_hi")))  # a single row
    width = F.col("_hi") - F.col("_lo")
    return nodes.crossJoin(span).withColumn("size", F.when(width > 0, low + (high - low) * (F.col("wdegree") - F.col("_lo")) / width).otherwise(F.lit(float(low)))).drop("_lo", "_hi")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """For edges (item, hub): item and ``component``, the least item that hubs connect it with.

    Least labels spread over hubs, then every label is replaced by its own label.
    Whatever a join meets is a table of its own, so the engine can split the
    partition of a hub or label that very many items share.
    """
    edges = _table(edges.select("item", "hub").distinct(), "edges")
    labels = _table(edges.groupBy("item").agg(F.col("item").alias("component")), "labels")
    for _ in range(rounds):
        least = _table(edges.join(labels, "item").groupBy("hub").agg(F.min("component").alias("near")), "hubs")
        near = edges.join(least, "hub").groupBy("item").agg(F.min("near").alias("near"))
        step = _table(labels.join(near, "item").select("item", F.col("component").alias("old"), F.least("component", "near").alias("component")), "steps")
        if not step.where("old <> component").limit(1).count():
            return step.select("item", "component")
        further = step.select(F.col("item").alias("component"), F.col("component").alias("further"))
        labels = _table(step.join(further, "component").select("item", F.least("component", "further").alias("component")), "labels")
    raise RuntimeError("components did not settle")


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """id, component (its least member): every node is a hub of its neighbours and of itself."""
    ends = endpoints(edges.withColumn("weight", F.lit(0.0)))
    hubs = ends.select(F.col("id").alias("item"), F.col("other").alias("hub")).union(ends.select("id", "id"))
    return components(hubs, rounds).withColumnRenamed("item", "id")


def drop_small(components: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Nodes of components with at least so many nodes."""
    sizes = components.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return components.join(sizes, "component").select("id", "component", "size")


def filtered_graph(edges: DataFrame, min_sentences: int = MIN_SENTENCES, min_weight: float = MIN_WEIGHT, min_size: int = MIN_SIZE) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, component, size) and edges of the four chained filters."""
    strong = _table(filter_edges(weighted(edges), min_sentences, min_weight), "edges")
    nodes = _table(drop_small(connected_components(strong), min_size), "nodes")
    return nodes, strong.join(nodes.select(F.col("id").alias("a")), "a", "left_semi")


def louvain_part(part: pd.DataFrame | dict, total: float, resolution: float, use_weights: bool = True) -> dict:
    """Communities of one component, deterministic: nodes in order of id, ties to the least community."""
    graph: dict = {}
    for a, b, w in zip(part["a"], part["b"], part["weight"], strict=True):
        w = float(w) if use_weights else 1.0
        graph.setdefault(a, {})[b] = graph.get(a, {}).get(b, 0.0) + w
        graph.setdefault(b, {})[a] = graph.get(b, {}).get(a, 0.0) + w
    member = {v: v for v in graph}
    loops = dict.fromkeys(graph, 0.0)
    while True:
        home = {v: v for v in graph}
        strength = {v: sum(n.values()) + loops[v] for v, n in graph.items()}
        mass = dict(strength)
        moved = any_move = True
        any_move = False
        while moved:
            moved = False
            for v in sorted(graph):
                to: dict = {}
                for u, w in graph[v].items():
                    to[home[u]] = to.get(home[u], 0.0) + w
                mass[home[v]] -= strength[v]
                gain = lambda c, v=v, to=to: resolution * to.get(c, 0.0) - strength[v] * mass[c] / total
                best = min([home[v], *to], key=lambda c: (-round(gain(c), 12), c))
                if round(gain(best) - gain(home[v]), 12) > 0:
                    home[v], moved, any_move = best, True, True
                mass[home[v]] += strength[v]
        if not any_move:
            return member
        member = {v: home[c] for v, c in member.items()}
        merged: dict = {c: {} for c in set(home.values())}
        new_loops = dict.fromkeys(merged, 0.0)
        for v, near in graph.items():
            new_loops[home[v]] += loops[v]
            for u, w in near.items():
                if home[u] == home[v]:
                    new_loops[home[v]] += w
                else:
                    merged[home[v]][home[u]] = merged[home[v]].get(home[u], 0.0) + w
        graph, loops = merged, new_loops


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = RESOLUTION, use_weights: bool = True) -> DataFrame:
    """id, component, community (its least member).

    A community never spans components, so a task takes one component after another;
    the graph's total weight is one number.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    value = F.col("weight").cast("double") if use_weights else F.lit(1.0)
    total = 2 * (edges.agg(F.sum(value)).first()[0] or 1.0)

    def part(held: dict, component) -> list[tuple]:
        member = louvain_part(held, total, resolution, use_weights)
        least: dict = {}
        for v, c in member.items():
            least[c] = min(v, least.get(c, v))
        return [(v, component, least[c]) for v, c in member.items()]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, last = {"a": [], "b": [], "weight": []}, [], None
        for f in frames:
            for component, a, b, weight in zip(*[f[c].tolist() for c in ("component", "a", "b", "weight")], strict=True):
                if held["a"] and component != last:
                    rows += part(held, last)
                    held = {"a": [], "b": [], "weight": []}
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=["id", "component", "community"])
                        rows = []
                for c, x in (("a", a), ("b", b), ("weight", weight)):
                    held[c].append(x)
                last = component
        if held["a"]:
            rows += part(held, last)
        if rows:
            yield pd.DataFrame(rows, columns=["id", "component", "community"])

    owned = edges.join(nodes.select(F.col("id").alias("a"), "component"), "a").select("component", "a", "b", F.col("weight").cast("double").alias("weight"))
    # few bytes, much work: the engine must not put them into few tasks
    n = max(parts(edges, nodes), edges.sparkSession.sparkContext.defaultParallelism)
    owned = owned.repartition(n, "component").sortWithinPartitions("component", "a", "b")
    return owned.mapInPandas(run, f"id {kind}, component {kind}, community {kind}")
