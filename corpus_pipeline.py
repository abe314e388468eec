"""From raw documents to packed token sequences: four stages, each written and read again.

quality        documents that the line classifier rejects go
near_copies    of each group of near-duplicate documents the one of least id stays, as one row
repeats        passages that stand earlier in the corpus are cut out of the texts
packing        texts become token windows; the result is one row for each piece

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, extra ones of any name included. A document that loses its whole text in `repeats`
stays as an empty one. Cuts leave whole characters.

Defined cases: a null text counts as empty, and is one after `repeats`; a row without an id is a
document that comes after all others; rows of one id are documents of their own, of which
`near_copies` keeps one for each group of like texts (rows without words are like nothing and all
stay); without labels, or of one kind alone, every score is their rate (0.5 if there are none, which
is below the limit: no document stays); an empty table gives no pieces; texts of any length go
through whole.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import ngram_join, packing, quality_crf, suffix_dedup
from lodestone.llm.common import bit_map, marked
from lodestone.sources.staging import discard, stage, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.keep_good(docs, field)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row goes by its id and text, as an id may stand for several texts
    near = ngram_join.ngram_join(docs, hashed=True).groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("stays"), F.bool_and("kept").alias("all_stay"))
    near = stage(near.where("NOT all_stay"), "near-copies")
    # a bit map of fixed size tells the rows that may be among them: only those are shuffled
    held = bit_map(near.select(F.xxhash64("doc_id", "text_hash").alias("mark")), "mark")
    rows = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = rows.withColumn("__mark", F.xxhash64(F.col("doc_id").cast("long"), "__hash"))
    at = rows.columns.index("__mark")

    def maybe(known: bool) -> DataFrame:
        def run(batches):
            for batch in batches:
                hit = marked(held, batch.column(at).to_numpy())
                yield batch.filter(pa.array(hit if known else ~hit))

        return rows.mapInArrow(run, rows.schema)

    def of(part: DataFrame, how: str) -> DataFrame:
        some = maybe(True)
        return some.join(part, some["doc_id"].eqNullSafe(part["doc_id"]) & (some["__hash"] == part["text_hash"]), how)

    kept = maybe(False).union(of(near, "left_anti"))
    once = near.where("stays")  # repeated rows, of which one stays
    if not once.isEmpty():
        kept = kept.union(of(once, "left_semi").dropDuplicates(["doc_id", "__hash"]))
    return kept.select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    beside = F.encode(F.to_json(F.struct(*(F.col(f"`{c}`") for c in others)), {"ignoreNullFields": "false"}), "utf-8") if others else None
    cut = suffix_dedup.remove_repeats(docs, as_text=True, carry=beside)
    found = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    if others:
        cut = cut.withColumn("__beside", F.from_json(F.decode("carried", "utf-8"), docs.select(*(F.col(f"`{c}`") for c in others)).schema))
    return cut.select(*((found[c] if c in found else F.col("__beside").getField(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("packing", pack)]

#: No SQL expresses the trained classifier, MinHash or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again; what it staged on the way is deleted once it is written, and so is its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        before = docs
        with temporary(spark):
            docs = stage(function(spark, before, sf_dir), name, kept=True)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
