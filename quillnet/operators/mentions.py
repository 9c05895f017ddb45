"""The canonical mention table (doc, sent, ent) and its restrictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import dealt, parts

KEYS = ("doc", "sent", "ent")


def distinct_mentions(df: DataFrame) -> DataFrame:
    """An entity counts once in a sentence."""
    return df.select(*KEYS).dropDuplicates()


def interesting(mentions: DataFrame, min_entities: int = 2) -> DataFrame:
    """Mentions of sentences with at least so many distinct entities; documents without such sentences go with them."""
    n = F.count("*").over(Window.partitionBy("doc", "sent"))
    return mentions.withColumn("_n", n).where(F.col("_n") >= min_entities).drop("_n")


def kept_documents(interesting_mentions: DataFrame) -> DataFrame:
    """Documents that keep a sentence, with the number of those sentences."""
    return interesting_mentions.groupBy("doc").agg(F.count_distinct("sent").alias("sentences"))


def resolve_keys(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions joined to the alias table (key, aliases); an entity without aliases is an error."""
    n = parts(mentions, aliases)
    mentions, aliases = dealt(mentions, n, "ent"), dealt(aliases, n, "key")
    joined = mentions.join(aliases, mentions["ent"] == aliases["key"], "left")
    checked = F.when(F.col("key").isNull(), F.raise_error(F.concat(F.lit("Missing aliases: "), F.col("ent").cast("string")))).otherwise(F.col("key"))
    return joined.select("doc", "sent", checked.alias("ent"), F.size("aliases").alias("n_aliases"))
