"""Checks of exported rows ``(document_pair, id, ...)`` and their difference from a golden export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["document_pair", "id"]
FIELDS = ["recommendation_page", "recommendation_text", "matched_response_page", "matched_response_text", "classification", "confidence"]
DEBUG = ["alignment_method", "alignment_confidence", "classification_confidence", "classifier_method", "confidence_factors"]


def flatten(export: DataFrame) -> DataFrame:
    """Nested ``debug`` fields as columns ``debug_<name>``."""
    rest = [c for c in export.columns if c != "debug"]
    return export.select(*rest, *[F.col(f"debug.{f.name}").alias(f"debug_{f.name}") for f in export.schema["debug"].dataType.fields])


def diff(baseline: DataFrame, candidate: DataFrame, allowed: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Rows ``(document_pair, id, field, before, after, kind)``; kind is ``missing``, ``extra``, ``allowed`` or ``unexpected``.

    ``allowed`` has ``(document_pair, id, field)``; two nulls are equal.
    """
    names = fields or [c for c in baseline.columns if c not in KEY]

    def shaped(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*KEY, F.lit(True).alias(f"in_{tag}"), *[F.col(c).cast("string").alias(f"{tag}_{c}") for c in names])

    both = shaped(baseline, "a").join(shaped(candidate, "b"), KEY, "full")
    whole = both.where("in_a is null or in_b is null").select(*KEY, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.when(F.col("in_b").isNull(), "missing").otherwise("extra").alias("kind"))
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in names])
    changed = both.where("in_a and in_b").select(*KEY, F.explode(cells).alias("c")).select(*KEY, "c.*").where(~F.col("before").eqNullSafe(F.col("after")))
    if allowed is None:
        return changed.withColumn("kind", F.lit("unexpected")).unionByName(whole)
    marked = changed.join(allowed.select(*KEY, "field", F.lit(True).alias("ok")), [*KEY, "field"], "left")
    return marked.select(*KEY, "field", "before", "after", F.when(F.col("ok"), "allowed").otherwise("unexpected").alias("kind")).unionByName(whole)


def duplicates(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def blank_ids(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == "")).select(*KEY)


def leaks(rows: DataFrame, patterns: DataFrame, text: str = "matched_response_text") -> DataFrame:
    """Rows whose text holds a pattern of the table ``(pattern, at_start)``; a small table of rules."""
    t = F.ltrim(text)
    found = F.regexp_like(t, F.concat(F.lit("(?i)"), F.when(F.col("at_start"), "^").otherwise(""), F.col("pattern")))
    return rows.join(patterns, found).select(*KEY, "pattern")


def metadata_failures(rows: DataFrame) -> DataFrame:
    """Flat export rows that lack a debug field or name another classifier."""
    tests = [F.when(F.col(f"debug_{c}").isNull(), F.lit(f"debug.{c} missing")) for c in DEBUG]
    tests.append(F.when(F.coalesce("debug_classifier_method", F.lit("")) != "rule_based", F.lit("classifier_method")))
    return rows.select(*KEY, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("failure"))


def expectation_failures(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected ``(document_pair, id, expected)`` classifications that the rows do not have."""
    return expected.join(rows.select(*KEY, "classification"), KEY, "left").where(~F.col("classification").eqNullSafe(F.col("expected")))
