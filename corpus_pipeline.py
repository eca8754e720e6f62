"""The training-corpus pipeline over ``documents``: one operator of ``panelcast.llm`` per stage.

quality classifier -> line dedup -> n-gram Jaccard join -> source mixing -> packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder as Parquet and reads it back as the next
stage's documents.  All stages but the last return the columns of
``documents``; ``n_chars`` is kept in step with the text.  Labels come from
``sf_dir``.

Defined cases are those of the operators; rows without text do not survive the
first stage, documents emptied by the second remain as empty texts, and the
copies that the mix makes of a document are packed as documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import table, written
from panelcast.llm.jaccard import keep_one
from panelcast.llm.linededup import dedup_lines
from panelcast.llm.mixing import mix
from panelcast.llm.packing import pack_documents
from panelcast.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is that of trusted text of their language."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal, or are one edit from, an earlier line of the corpus."""
    out = dedup_lines(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                          .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word 5-grams at a similarity of 0.8."""
    return keep_one(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights take them."""
    return mix(docs, weights=(1, 2, 3), max_epochs=3, seed="mix")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of documents in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: The classifier's model and the tokenizer cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
