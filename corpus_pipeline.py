"""Corpus pipeline over ``documents``: language ID, near-duplicate removal, substring removal, packing.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes a stage's result as Parquet in the shared folder and reads it back
as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import op4_minhash, op5_language, op7_spans, op10_packing
from lectern.llm.common import Workspace, fresh
from lectern.llm.queries import tokenizer_path

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or letters and those with an undecided language go.

    Every row is judged on its own: repeated rows and ids stay or go alike, null ids are judged like others, columns of any
    name pass through, an empty table stays empty.
    """
    pred, score = fresh("pred", docs.columns), fresh("score", docs.columns)
    told = op5_language.identify(docs, pred=pred, score=score)
    return told.where((F.col(pred) != op5_language.NONE) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component (five-word shingles, similarity 0.8): that with the smallest id, null last.

    Rows are told apart by a number of their own, not by their id: rows that share an id but not their text are
    different documents and each stays, unless another row is near to it; repeated rows are copies, of which one stays.
    Rows without words link with nothing and stay.  Columns of any name pass through; an empty table stays empty.
    """
    row, component = fresh("row", docs.columns), fresh("component", docs.columns)
    numbered = Workspace(spark, "near").save(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = op4_minhash.near_duplicates(numbered, key=row, size=5, percent=80).select(F.col("doc_id").alias(row), F.col("component_id").alias(component))
    ids = numbered.select(row, F.col("doc_id").alias("id")).join(found, row)
    first = ids.groupBy(component).agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col(row))).alias("first")).select(F.col("first")[row].alias(row))
    return numbered.join(first, row, "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentence runs that an earlier document has; those that consist of such runs alone go.

    Null and blank texts stay; rows that repeat id and text are treated alike, and texts of one id apart; null ids come first.
    ``n_chars``, where there is one, is counted anew for texts that lost some; other columns pass through; an empty table stays empty.
    """
    gone = fresh("removed", docs.columns)
    out = op7_spans.remove_repeats(docs, removed=gone).where((F.col(gone) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, padded to none but a power of two.

    Null text is the end id alone; null and repeated ids are packed each on its own; other columns are ignored; an empty table gives no row.
    """
    return op10_packing.pack_documents(docs, tokenizer_path(), end_id=0, finish=op10_packing.crc, schema=pa.schema([("ids_crc32", pa.int64())]))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("packing", packing),
]

#: Tokens and minhashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
