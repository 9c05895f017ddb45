"""Entity and pair frequencies, pointwise mutual information and its normalised form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _table, dealt, parts

ORDER = ("npmi", "sentences", "documents", "a", "b")
#: Mentions make this many times as many pairs, or fewer, for the sizes of partitions.
PAIRS = 2


def entity_freq(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("ent").agg(F.count("*").alias("freq"))


def corpus_size(mentions: DataFrame) -> DataFrame:
    """One row: the number of mentions."""
    return mentions.agg(F.count("*").alias("corpus_size"))


def sentence_pairs(mentions: DataFrame) -> DataFrame:
    """Unordered pairs a < b of each sentence."""
    mentions = dealt(mentions, parts(mentions), "doc", "sent")
    left, right = mentions.withColumnRenamed("ent", "a"), mentions.withColumnRenamed("ent", "b")
    return left.join(right, ["doc", "sent"]).where("a < b")


def pair_freq(mentions: DataFrame) -> DataFrame:
    """Sentences and documents of each pair.

    Counted per document first, so no distinct count has to keep documents' sets.
    """
    n = parts(mentions, times=PAIRS)
    by_doc = dealt(sentence_pairs(mentions), n, "a", "b", "doc").groupBy("a", "b", "doc").agg(F.count("*").alias("n"))
    return dealt(by_doc, n, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("sentences"), F.count("*").alias("documents"))


def with_frequencies(pairs: DataFrame, freq: DataFrame) -> DataFrame:
    """Pairs with both entities' frequencies."""
    fa, fb = freq.select(F.col("ent").alias("a"), F.col("freq").alias("freq_a")), freq.select(F.col("ent").alias("b"), F.col("freq").alias("freq_b"))
    n = parts(pairs, times=PAIRS)
    known = dealt(pairs, n, "a").join(dealt(fa, n, "a"), "a")
    return dealt(known, n, "b").join(dealt(fb, n, "b"), "b")


def log2(x: Column) -> Column:
    return F.log(x) / F.log(F.lit(2.0))


def npmi_edges(mentions: DataFrame) -> DataFrame:
    """a, b, pmi, npmi, sentences, documents for interesting mentions."""
    size = F.broadcast(corpus_size(mentions))  # a single row
    x = with_frequencies(pair_freq(mentions), entity_freq(mentions)).crossJoin(size)
    n = F.col("corpus_size").cast("double")
    pxy, px, py = F.col("sentences") / n, F.col("freq_a") / n, F.col("freq_b") / n
    x = x.withColumn("pmi", log2(pxy / (px * py))).withColumn("npmi", F.col("pmi") / -log2(pxy))
    return x.select("a", "b", "pmi", "npmi", "sentences", "documents")


def rank_edges(edges: DataFrame) -> DataFrame:
    """Edges with their place in the total order, weakest first (npmi to nine digits).

    The edges are dealt by ranges of the whole order, so ties at one weight part as
    well; an edge's rank is its row in its range plus the rows of all ranges before.
    """
    n = parts(edges, times=PAIRS)
    ranges = edges.withColumn("npmi", F.round("npmi", 9)).repartitionByRange(*([n] if n else []), *ORDER).withColumn("_range", F.spark_partition_id())
    e = _table(ranges, "ranges")
    counts = e.groupBy("_range").agg(F.count("*").alias("_c"))  # one row a partition
    before = counts.select("_range", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy("_range").orderBy(*ORDER))
    return dealt(e, n, "_range").withColumn("_row", row).join(F.broadcast(before), "_range").withColumn("rank", F.col("_row") + F.col("_before")).drop("_range", "_row", "_before")


def doc_pair_ratio(mentions: DataFrame) -> DataFrame:
    """Per document and pair: its share of the document's interesting sentences."""
    pairs = dealt(sentence_pairs(mentions), parts(mentions, times=PAIRS), "doc", "a", "b").groupBy("doc", "a", "b").agg(F.count("*").alias("n"))
    total = mentions.select("doc", "sent").distinct().groupBy("doc").agg(F.count("*").alias("doc_sentences"))
    return pairs.join(total, "doc").select("doc", "a", "b", "n", "doc_sentences", (F.col("n") / F.col("doc_sentences")).alias("ratio"))


def rational(numerator: Column, denominator: Column) -> Column:
    """A counter over a denominator: both, the truncated and the exact quotient."""
    quotient = numerator / denominator
    return F.struct(numerator.alias("num"), denominator.alias("den"), quotient.cast("long").alias("whole"), quotient.alias("value"))
