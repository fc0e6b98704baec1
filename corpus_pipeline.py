"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage works on all rows that the one before kept, and takes effect on
them.  Results between stages are Parquet tables in the shared scratch folder.

Defined cases: documents without words pass the stages that find nothing in
them; rows of one doc_id are one document to the stages that compare documents,
of which the near-duplicate stage keeps one row; rows with a null doc_id are
judged by their text alone and never compared; very long texts are taken whole
by every stage; extra columns pass, whatever their names; an empty table gives
an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.llm import decontam, line_dedup, ngram_join, packing, quality, scratch
from pathweave.llm.expressions import fresh


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; a document that loses all its lines goes."""
    clean = line_dedup.dedup_lines(docs)
    n_lines, n_removed = (F.col(name) for name in line_dedup.added(docs))
    counted = F.when(n_removed == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint")) if "n_chars" in docs.columns else None
    columns = [counted.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return clean.filter((n_removed == 0) | (n_removed < n_lines)).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of similar documents."""
    kept = ngram_join.similar_documents(docs).filter("component_id = doc_id").select("doc_id").distinct()
    number = fresh("number", docs.columns)
    one = Window.partitionBy("doc_id").orderBy("text")
    rows = docs.join(kept, "doc_id", "left_semi").withColumn(number, F.row_number().over(one)).filter(F.col(number) == 1)
    return rows.drop(number).unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = fresh("hit", docs.columns)
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(hit)), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: the classifier is trained, and token ids come from a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = scratch.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            scratch.remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
