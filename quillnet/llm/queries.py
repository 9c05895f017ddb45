"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, jaccard_join, langid, media, packing, pii, substring_dedup, suffix_dedup, topk
from .common import materialise, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), langid.fit(docs)).drop("text")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_columns(table(spark, sf_dir, "documents")))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))).select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    # rows are numbered once, in a table: a query meets all rows but its own, also where ids repeat
    vectors = materialise(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_substring_dedup, op4_html_text, op5_pii, op6_media_columns, op7_bpe, op8_top_k, op9_packing, op10_jaccard_join)}


#: DuckDB SQL for the operators that SQL can express; the others are tested against brute force, round trips or held-out rows.
SQL: dict[str, str] = {}
SQL["op2_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
o AS (SELECT doc_id, h, n_bytes, unnest(range(0, n_bytes, 256)) AS first FROM d),
q AS MATERIALIZED (SELECT doc_id, n_bytes, first, substr(h, 2 * first::INTEGER + 1, 910) AS h FROM o),
p AS (SELECT doc_id, n_bytes, first, h, unnest(range(least(256, n_bytes - first))) AS k FROM q),
b AS (SELECT doc_id, first + k AS pos, substr(h, 2 * k::INTEGER + 1, 2) AS byte, CASE WHEN first + k + 200 <= n_bytes THEN md5(substr(h, 2 * k::INTEGER + 1, 400)) END AS win FROM p),
r AS (SELECT win FROM b WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT b.doc_id, b.pos, b.byte, (r.win IS NOT NULL)::INTEGER AS rep FROM b LEFT JOIN r ON r.win = b.win),
c AS (SELECT doc_id, pos, byte, max(rep) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM m),
g AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (WHERE gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
SQL["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
b AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 34 <= len(w) THEN md5(array_to_string(w[pos:pos + 34], ' ')) END AS win FROM p),
r AS (SELECT win FROM b WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT b.doc_id, b.pos, b.word, (r.win IS NOT NULL)::INTEGER AS rep FROM b LEFT JOIN r ON r.win = b.win),
c AS (SELECT doc_id, pos, word, max(rep) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
SQL["op8_top_k"] = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT r, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM e),
ok AS (SELECT r FROM u GROUP BY r HAVING bool_and(x IS NOT NULL AND isfinite(x))),
v AS (SELECT u.r, vec_id, k, floor(1024 * x)::BIGINT AS x FROM u JOIN ok USING (r)),
s AS (SELECT q.r, q.vec_id AS query_id, c.r AS c, c.vec_id, sum(q.x * c.x)::BIGINT AS score FROM v q JOIN v c ON c.k = q.k AND c.r <> q.r WHERE q.vec_id % 100 = 0 GROUP BY ALL),
o AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, c)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM o WHERE rank <= 10
"""
SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(w[pos:pos + 4], ' ')) AS gram FROM p),
s AS (SELECT doc_id, list(gram ORDER BY gram) AS grams FROM g GROUP BY doc_id),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS class_id, len(grams) AS n FROM s),
x AS (SELECT class_id, n, gram FROM m JOIN g USING (doc_id) WHERE doc_id = class_id),
l AS MATERIALIZED (SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
t AS (SELECT DISTINCT a, a AS root FROM l UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.a),
r AS (SELECT a, min(root) AS group_id FROM t GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(group_id, m.class_id, d.doc_id) AS group_id
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN n ON n.a = m.class_id LEFT JOIN r ON r.a = m.class_id
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
