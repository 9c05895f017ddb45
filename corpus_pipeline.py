"""The corpus pipeline over ``documents``: language ID, near-duplicate join, substring removal, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillnet.llm import jaccard_join, langid, packing, pii, suffix_dedup
from quillnet.llm.common import materialise
from quillnet.operators.graph import drop_tables, written

#: Documents whose language is less sure than this are rejected.
LEAST_SCORE = 0.35
#: Encoded chunks that a worker of the last stage keeps: fewer than packing alone would, as the earlier stages fill the executors.
CACHED_CHUNKS = 400_000


#: Columns that the operators use by name; all others travel under plain names, as theirs may clash or hold any character.
OWN = ("doc_id", "text", "lang", "n_chars")


def _guarded(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """operator's rows with the columns of ``docs``, each as it was (text and n_chars as the operator leaves them)."""
    names = [c if c in OWN else f"_in{k}" for k, c in enumerate(docs.columns)]
    return operator(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The documents with a new text and its number of characters."""
    new = docs.withColumn("text", text)
    return new.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else new


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language is unsure; all others stay as they are.

    Null and empty texts go; long texts are read whole; repeated rows share one
    fate, and ties between languages go to the first in order of name.  Without
    any labelled row nothing is sure and all go.  An empty table stays empty.
    """
    return _guarded(docs, lambda plain: langid.identify(plain).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, as it is: that of the least doc_id (null last).

    Texts without words, null or empty, stay, each a group of its own; long texts
    are compared whole; of repeated rows one stays.  An empty table stays empty.
    """
    return _guarded(docs, jaccard_join.keep_one)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeated strings cover go; what a cut leaves of a split character goes too, but no U+FFFD of the input.

    Every document stays, with an empty text if nothing is left.  Null and empty
    texts stay as they are; long texts are read whole; rows that repeat count as
    occurrences of their own, none preferred.  An empty table stays empty.
    """
    whole = lambda part: F.regexp_replace(F.make_valid_utf8(part.cast("string")), "\ufffd", "")

    def operator(plain: DataFrame) -> DataFrame:
        # one letter a byte, parted where the three bytes of U+FFFD stand
        parts = F.split(F.decode("kept", "ISO-8859-1"), "\xef\xbf\xbd")
        own = F.array_join(F.transform(parts, lambda p: whole(F.encode(p, "ISO-8859-1"))), "\ufffd")
        text = F.when(F.col("n_removed") == 0, F.col("text")).when(F.col("text").contains("\ufffd"), own).otherwise(whole(F.col("kept")))
        return _with_text(suffix_dedup.remove_repeats(plain), text)

    return _guarded(docs, operator)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by pseudonyms of its format; every document stays, and what holds none stays as it is.

    Null stays null; long texts are read whole; equal values get equal
    pseudonyms, in repeated rows as in others.  An empty table stays empty.
    """
    return _guarded(docs, lambda plain: _with_text(pii.pseudonymise(plain), F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences; nulls, long texts, repeated rows and empty tables as ``packing.pack`` says."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=CACHED_CHUNKS)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("suffix_dedup", repeated_substrings),
    ("pii", pseudonyms),
    ("packing", packed),
]

#: SQL can express neither the labeller nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables that a stage wrote on its way go once its rows are written."""
    since = written(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        drop_tables(spark, docs, since)
    return STAGES[-1][1](spark, docs, sf_dir)
