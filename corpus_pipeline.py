"""A corpus from documents to packed sequences: toxicity, line dedup, near duplicates, mixing, packing.

Every stage takes any table with doc_id, text and source. A null or empty text is a document without words: it is not
toxic by its words, has no lines to lose, is nobody's copy, and packs as its end token. Rows that repeat a doc_id are
documents of their own; rows equal in doc_id and text are one document, and stay or go together. A null doc_id stays
null. Other columns travel along, whatever their names, but for score, n_lines, n_removed and n_runs, which two stages
compute beside the documents. An empty table gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.stage import stage
from panelspark.llm import line_dedup, mixing, packing, superminhash, textbytes, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5 by a model of the labelled rows that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).where("score < 0.5").select(*textbytes.quoted(docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines of ten words or more that stand earlier in the corpus; n_chars follows."""
    cleaned = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*textbytes.quoted(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group linked by a similarity of 0.8 or more."""
    return superminhash.drop_near_duplicates(docs, superminhash.NearDupParams(percent=80, rows=5, bands=34))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: not, once or twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, packing.PackParams(tokenizer=public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack)]

#: Toxicity, near duplicates and packing are not for SQL; the tests follow the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to what the one before it kept, written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, fn in STAGES[:-1]:
        docs = stage(fn(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
