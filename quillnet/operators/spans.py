"""Spans of tokens on document-absolute offsets, and the coreference joins on them.

Absolute offsets turn spans over several sentences into plain intervals, so
overlap is an equality of documents and two comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CORPORATION = "ORGANIZATION:CORPORATION"


def corporations(spans: DataFrame) -> DataFrame:
    return spans.where(F.col("type") == CORPORATION)


def absolute_offsets(sentences: DataFrame) -> DataFrame:
    """Sentences (doc, sent, tokens) with the offset of their first token in the document."""
    w = Window.partitionBy("doc").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    return sentences.withColumn("base", F.coalesce(F.sum(F.size("tokens")).over(w), F.lit(0)).cast("int"))


def absolute_spans(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Spans (doc, sent, start, stop) with absolute ``from`` and ``to``; a span of an unknown sentence is dropped."""
    base = absolute_offsets(sentences).select("doc", "sent", "base")
    return spans.join(base, ["doc", "sent"]).withColumn("from", F.col("base") + F.col("start")).withColumn("to", F.col("base") + F.col("stop")).drop("base")


def span_tokens(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Spans with their tokens, which may run on into following sentences; null where they overrun the document."""
    flat = sentences.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("sent", "tokens"))), lambda x: x["tokens"])).alias("_flat"))
    size = F.col("to") - F.col("from")
    got = F.when((F.col("to") <= F.size("_flat")) & (size >= 0), F.slice("_flat", F.col("from") + 1, F.greatest(size, F.lit(0))))
    return absolute_spans(spans, sentences).join(flat, "doc").withColumn("tokens", got).drop("_flat")


def overlap_join(left: DataFrame, right: DataFrame, *carried: str) -> DataFrame:
    """Pairs of spans (doc, id, from, to) of one document that share a token: doc, left_id, right_id and the columns carried from the left."""
    a, b = left.select("doc", F.col("id").alias("left_id"), F.col("from").alias("_lf"), F.col("to").alias("_lt"), *carried), right.select("doc", F.col("id").alias("right_id"), F.col("from").alias("_rf"), F.col("to").alias("_rt"))
    return a.join(b, "doc").where("_lf < _rt and _rf < _lt").select("doc", "left_id", "right_id", *carried)


def valid_entries(entries: DataFrame, sentences: DataFrame) -> DataFrame:
    """Entries (doc, sent, start, stop, val) whose recorded text equals the tokens at their range."""
    return span_tokens(entries, sentences).where(F.col("val") == F.array_join("tokens", " "))


def at_spans(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """Entries once for each span (doc, sent, start, stop) recorded at just their range."""
    place = ["doc", "sent", "start", "stop"]
    return entries.join(spans.select(place), place)


def expand(antecedents: DataFrame, entities: DataFrame, pronouns: DataFrame) -> DataFrame:
    """One step of expansion: for entries (doc, chain, id, from, to) an entity at every pronoun of a chain whose antecedent it overlaps.

    The chain goes with its antecedent through the join, as ids may repeat in a document.
    """
    met = overlap_join(antecedents, entities, "chain")
    return met.join(pronouns.select("doc", "chain", F.col("id").alias("pronoun_id")), ["doc", "chain"]).select("doc", "chain", "right_id", "pronoun_id")


def documents_with_chains(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """Documents that the coreference file names, with or without chains."""
    return docs.join(chains.select("doc").where("doc is not null").distinct(), "doc", "left_semi")


def occurrences(spans: DataFrame) -> DataFrame:
    """(doc, sent of the span's start, surface) of spans with tokens."""
    return spans.where("tokens is not null").select("doc", "sent", F.array_join("tokens", " ").alias("surface"))


def fold_chains(sentences: list, entities: list[tuple[int, int, int]], chains: list[list[tuple[str, int, int, int, str]]]) -> list[tuple[int, str]]:
    """(sentence, surface) of a document's entities (sentence, start, stop) and of those that its chains add, chain by chain.

    What a chain adds is visible to the next one.
    """
    base, flat = [], []
    for s in sentences:
        base.append(len(flat))
        flat += s
    held = [(s, base[s] + a, base[s] + b, " ".join(flat[base[s] + a : base[s] + b])) for s, a, b in entities if s < len(base) and base[s] + b <= len(flat)]
    for chain in chains:
        sound = [(role, s, base[s] + a, base[s] + b) for role, s, a, b, val in chain if 0 <= s < len(base) and base[s] + b <= len(flat) and " ".join(flat[base[s] + a : base[s] + b]) == val]
        new = []
        for role, _, lo, hi in sound:
            if role == "Antecedent":
                for _, x, y, surface in held:
                    if lo < y and x < hi:
                        new += [(s, a, b, surface) for r, s, a, b in sound if r == "Pronoun"]
        held += new
    return [(s, surface) for s, _, _, surface in held]


def expand_coreferences(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """Occurrences (doc, sent, surface, seq) of parsed documents, chains applied in file order; documents that no entry names are dropped.

    A document and its chains form one row, so the fold is a map, not a shuffle of its own.
    """
    per_chain = entries.where("doc is not null").groupBy("doc", "chain").agg(F.collect_list(F.when(F.col("span").isNotNull(), F.struct("role", "span.sentence", "span.start", "span.stop", "val"))).alias("entries"))
    per_doc = per_chain.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chain", "entries"))).alias("chains"))
    wide = docs.where("doc is not null").join(per_doc, "doc").select("doc", "sentences", "entities", "chains")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for doc, sentences, entities, chains in f.itertuples(index=False):
                ents = [(e["sentence"], e["start"], e["stop"]) for e in entities]
                folded = fold_chains([list(s) for s in sentences], ents, [[(e["role"], e["sentence"], e["start"], e["stop"], e["val"]) for e in c["entries"]] for c in chains])
                rows += [(doc, s, surface, k) for k, (s, surface) in enumerate(folded)]
            yield pd.DataFrame(rows, columns=["doc", "sent", "surface", "seq"])

    return wide.mapInPandas(run, "doc string, sent int, surface string, seq long")
