"""The analysis of paired documents in one plan for all pairs: extract, segment, align, classify, export.

Report and response pages are ``(source, page_number, text, ocr)`` with the pair id as their source.  Each stage is a function from
DataFrames to DataFrames, so a stage can be written out and a later one started from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import align, classify, extract, units, views
from lectern.sources.store import Save, planned

STAGES = ("load", "extract", "align", "classify")


def recommendations(report_pages: DataFrame, committee: Column | None = None, prefix: str | None = None, rules: DataFrame | None = None, save: Save = planned) -> DataFrame:
    """Recommendations of each pair's report, with a corpus's own clean-up ``rules`` applied where it has some."""
    found = extract.extract(report_pages, committee, prefix, save)
    return (views.apply_rules(found, rules) if rules is not None else found).withColumnRenamed("source", "pair_id")


def replies(response_pages: DataFrame) -> DataFrame:
    return units.normalised_labels(units.response_units(response_pages)).withColumnRenamed("source", "pair_id")


def matches(recs: DataFrame, reply_units: DataFrame, chunks: DataFrame | None = None, k: int = 3, threshold: float = 0.05, save: Save = planned) -> DataFrame:
    """Unit matches for pairs with two units or more; for the others similar passages of ``chunks`` where given."""
    many = reply_units.groupBy("pair_id").agg(F.count("*").alias("n")).where("n >= 2").select("pair_id")
    by_unit = align.match_units(recs.join(many, "pair_id", "left_semi"), reply_units.join(many, "pair_id", "left_semi"), k, threshold, save=save)
    by_unit = by_unit.join(reply_units.select("pair_id", "unit_id", F.col("response_text").alias("matched_text"), F.col("page_start").alias("matched_page")), ["pair_id", "unit_id"])
    if chunks is None:
        return by_unit
    rest = align.match_chunks(recs.join(many, "pair_id", "left_anti"), chunks.join(many, "pair_id", "left_anti"), k, threshold)
    rest = rest.select("pair_id", F.col("chunk_id").cast("int").alias("unit_id"), "rec_id", "match_method", "score", (F.col("rank") == 1).alias("primary"), "matched_text", F.lit(None).cast("int").alias("matched_page"))
    return by_unit.select(*rest.columns).unionByName(rest)


def export(recs: DataFrame, found: DataFrame) -> DataFrame:
    """One row per recommendation with its best match, stance and confidence; without a match it is not addressed."""
    best = align.best_match(recs, found).withColumn("s", classify.classify("matched_text"))
    best = best.withColumn("classification", classify.mapped(F.col("s.label"), classify.EXPORT_LABEL)).withColumn("similarity", F.coalesce("score", F.lit(0.0)))
    best = best.withColumn("c", classify.match_confidence("matched_text", "score", "similarity", "match_method", "classification"))
    return best.select(
        F.coalesce("item_label", F.col("rec_id").cast("string")).alias("id"), F.col("pair_id").alias("document_pair"), F.col("page_number").cast("string").alias("recommendation_page"), F.col("text").alias("recommendation_text"),
        F.col("matched_page").cast("string").alias("matched_response_page"), F.col("matched_text").alias("matched_response_text"), "classification", F.round("c.confidence", 3).alias("confidence"),
        F.struct(F.round("score", 3).alias("alignment_confidence"), F.col("match_method").alias("alignment_method"), F.round("similarity", 3).alias("lexical_similarity"), F.col("c.factors").alias("confidence_factors"), F.col("s.confidence").alias("classification_confidence"), F.lit("rule_based").alias("classifier_method")).alias("debug"),
    )


def analyse(report_pages: DataFrame, response_pages: DataFrame, chunks: DataFrame | None = None, committee: Column | None = None, prefix: str | None = None, rules: DataFrame | None = None, save: Save = planned) -> DataFrame:
    """Export rows of all pairs; ``save`` keeps each stage's table for the next one."""
    recs, reply_units = save(recommendations(report_pages, committee, prefix, rules, save), "recommendations"), save(replies(response_pages), "replies")
    return export(recs, save(matches(recs, reply_units, chunks, save=save), "matches"))


def ready(status: dict[str, str], stage: str) -> bool:
    """A stage can run when all before it are done."""
    return all(status.get(s) == "done" for s in STAGES[: STAGES.index(stage)])


def after_rerun(status: dict[str, str], stage: str) -> dict[str, str]:
    """Running a stage again clears the later ones."""
    at = STAGES.index(stage)
    return {s: ("running" if s == stage else status.get(s, "idle") if k < at else "idle") for k, s in enumerate(STAGES)}
