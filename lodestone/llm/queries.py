"""The registered queries of the corpus operators; each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import embedding_dedup, html_text, ngram_join, packing, quality_crf, sentencepieces, suffix_dedup, token_counts, topk_search, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sentencepiece(spark, sf_dir):
    """Ids of every document, decoded again: doc_id, n_ids, ids_hash, decoded_sha256."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = sentencepieces.encode(table(spark, sf_dir, "documents"), path)
    return sentencepieces.decode(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("decoded_sha256")
    )


@query
def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    index = warc.archive(pages)
    return warc.read_back(pages, index, all_held=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_ngram_join(spark, sf_dir):
    """One row for each document: its class (the least id reachable by links) and its number of links."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).withColumnRenamed("component_id", "class_id")


@query
def op7_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(topk_search.finite("embedding"))
    rows = rows.select("vec_id", topk_search.integers("embedding", 64.0).alias("vector"))
    return topk_search.top_k(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op8_packing(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, field).select(
        "doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality_crf.GOOD_FROM).cast("int").alias("predicted")
    )


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


ORACLES["op7_topk"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.n, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

ORACLES["op2_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER () AS n FROM embeddings
), g AS (
  SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_inner_product(x, x) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM g a JOIN g b ON a.n <> b.n AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reach(node, least) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.w, reach.least FROM reach JOIN l ON l.u = reach.node WHERE reach.least < l.w
), c AS (SELECT node, min(least) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.u = v.vec_id) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id"""

ORACLES["op6_ngram_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10ffff}]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS m, any_value(b.n) AS n
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p
), reach(node, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.v, reach.least FROM reach JOIN l ON l.u = reach.node WHERE reach.least < l.v
), c AS (SELECT node, min(least) AS class_id FROM reach GROUP BY node
), k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, c.class_id, d.doc_id = c.class_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.u = d.doc_id"""
