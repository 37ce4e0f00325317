"""Readers and writers: page tables, JSON banks and exports, CSV sinks, the versioned corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
QUERY_BANK = "query_id string, query string, query_type string, expected_docs array<string>, expected_topic string, expected_pages array<int>, expected_keywords array<string>, anchor string, search_modes array<string>, top_k int, notes string"
ANCHOR_BANK = "query_id string, query string, description string, relevant_passages array<struct<source:string,anchor:string>>"
EXPORT_ROW = "id string, document_pair string, recommendation_page string, recommendation_text string, matched_response_page string, matched_response_text string, classification string, confidence double, debug struct<alignment_confidence:double,alignment_method:string,lexical_similarity:double,confidence_factors:array<string>,classification_confidence:double,classifier_method:string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table ``(source, page_number, text, ocr)``."""
    return spark.read.schema("source string, page_number int, text string, ocr boolean").parquet(path)


def list_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Paths and sizes of files, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length").orderBy("path")


def read_query_bank(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERY_BANK).option("multiLine", True).json(path)


def read_anchor_bank(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANCHOR_BANK).option("multiLine", True).json(path)


def tidy_bank(bank: DataFrame) -> DataFrame:
    return bank.select("query_id", "query", "query_type", F.array_join("expected_docs", ", ").alias("expected_docs"), "expected_topic", F.array_join("expected_keywords", ", ").alias("expected_keywords"), F.col("anchor").isNotNull().alias("has_anchor"), F.array_join("search_modes", ", ").alias("search_modes"), "top_k")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Export rows from a JSON list or an envelope with ``recommendations``; other shapes raise."""
    shape = spark.read.option("multiLine", True).json(path)
    row = T._parse_datatype_string(EXPORT_ROW)
    if "recommendations" in shape.columns:
        return spark.read.schema(T.StructType([T.StructField("recommendations", T.ArrayType(row))])).option("multiLine", True).json(path).select(F.explode("recommendations").alias("r")).select("r.*")
    if "document_pair" not in shape.columns:
        raise ValueError("neither a list of rows nor an envelope with recommendations")
    return spark.read.schema(row).option("multiLine", True).json(path)


def export_envelope(rows: DataFrame, exported_at: str) -> DataFrame:
    """One JSON document of all rows.  It is one value, so this is for exports of a size that a reader can open; use
    ``write_json_rows`` for larger ones."""
    return rows.agg(F.to_json(F.struct(F.lit(exported_at).alias("exported_at"), F.count("*").alias("total"), F.sort_array(F.collect_list(F.struct("document_pair", "id", *[c for c in rows.columns if c not in ("document_pair", "id")]))).alias("recommendations"))).alias("json"))


def write_json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


#: Columns of the three exports as CSV, and those that a truth adds to predictions.
RECOMMENDATION_CSV = "id document_pair recommendation_page recommendation_text matched_response_page matched_response_text classification confidence".split()
PREDICTION_CSV = "document_pair id recommendation_page matched_response_page classification confidence alignment_method alignment_confidence classification_confidence classifier_method confidence_factors recommendation_text matched_response_text".split()
TRUTH_CSV = "true_label correct".split()
RESULT_CSV = "rank query retriever source pair_id page score confidence heading text display_preview".split()


def csv_columns(rows: DataFrame, columns: list[str], digits: dict[str, int] | None = None) -> DataFrame:
    """The named columns in order; those that the table lacks are null, numbers in ``digits`` are written with so many decimals."""
    fixed = digits or {}

    def cell(c: str):
        if c not in rows.columns:
            return F.lit(None).cast("string").alias(c)
        return F.format_string(f"%.{fixed[c]}f", F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) if c in fixed else F.col(c)

    return rows.select(*[cell(c) for c in columns])


def recommendations_csv(export: DataFrame) -> DataFrame:
    """Export rows as the table of recommendations: without a stance they are not addressed."""
    rows = export.withColumn("classification", F.coalesce("classification", F.lit("not_addressed")))
    return csv_columns(rows, RECOMMENDATION_CSV, {"confidence": 3})


def predictions_csv(flat: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Flattened export rows as the table of predictions; ``truth (document_pair, id, true_label)`` adds its label and whether it agrees, blank without one."""
    rows = flat.withColumnsRenamed({f"debug_{c}": c for c in ("alignment_method", "alignment_confidence", "classification_confidence", "classifier_method", "confidence_factors")})
    if truth is None:
        return csv_columns(rows, PREDICTION_CSV)
    rows = rows.join(truth.select("document_pair", "id", "true_label"), ["document_pair", "id"], "left")
    agrees = F.when(F.col("true_label").isNotNull(), F.col("classification").eqNullSafe(F.col("true_label")))
    return csv_columns(rows.withColumn("correct", agrees), [*PREDICTION_CSV, *TRUTH_CSV])


def results_csv(results: DataFrame, retriever: str) -> DataFrame:
    """Enriched search results as the table of results; the columns ``page_number`` and ``preview`` are shown as page and preview."""
    named = results.withColumnsRenamed({"page_number": "page", "preview": "display_preview"})
    return csv_columns(named.withColumn("retriever", F.lit(retriever)), RESULT_CSV, {"score": 6})


def write_csv(rows: DataFrame, path: str, line_end: str = "\r\n") -> None:
    """CSV with a header; lists joined by ``; ``, quotes doubled, lines ended by CR and LF.  Null and empty cells are both blank."""
    flat = [F.array_join(f.name, "; ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in rows.schema.fields]
    kept = rows.select(*flat).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    kept.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("lineSep", line_end).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of ``write_csv`` as text, with line breaks inside of quotes."""
    kept = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return kept.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_corpus(chunks: DataFrame, path: str, version: int = SCHEMA_VERSION) -> None:
    """Prebuilt corpus, partitioned by pair."""
    chunks.withColumn("schema_version", F.lit(version)).write.mode("overwrite").partitionBy("pair_id").parquet(path)


def read_corpus(spark: SparkSession, path: str, version: int = SCHEMA_VERSION, pairs: list[str] | None = None) -> DataFrame:
    """Rows of the expected version only; a pair filter prunes partitions, and pairs that are missing give no row."""
    rows = spark.read.parquet(path).where(F.col("schema_version") == version).drop("schema_version")
    return rows.where(F.col("pair_id").isin(pairs)) if pairs else rows


def missing_pairs(presets: DataFrame, corpus: DataFrame) -> DataFrame:
    return presets.join(corpus.select("pair_id").distinct(), "pair_id", "left_anti")


def missing_files(presets: DataFrame, files: DataFrame) -> DataFrame:
    """Preset files ``(pair_id, policy_path, response_path)`` that a listing ``(path)`` lacks."""
    asked = presets.select("pair_id", F.explode(F.array("policy_path", "response_path")).alias("path"))
    return asked.join(files.select("path").distinct(), "path", "left_anti")
