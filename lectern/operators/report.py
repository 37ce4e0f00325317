"""Summaries over passages, matches, predictions and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def extraction_audit(pages: DataFrame) -> DataFrame:
    """Per source: pages, words, median words a page, pages below 30 words, OCR pages."""
    n = F.size(T.words(F.coalesce("text", F.lit(""))))
    return pages.withColumn("n", n).groupBy("source").agg(F.count("*").alias("pages"), F.sum("n").alias("words"), F.median("n").alias("median_words"), F.count_if(F.col("n") < 30).alias("short_pages"), F.sum(F.col("ocr").cast("int")).alias("ocr_pages"))


def chunk_audit(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("n_words"), 6).alias("mean_words"), F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"))


def value_counts(rows: DataFrame, col: str) -> DataFrame:
    """Counts of each value, null included."""
    return rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def distribution(rows: DataFrame, label: str, expected: DataFrame) -> DataFrame:
    """Counts and percentages over the labels of ``(label, expected)``, zeros included, and whether they are as expected."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    j = expected.join(counts, "label", "left").fillna(0, ["n"]).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))
    return j.select("label", "n", F.round(F.when(F.col("total") > 0, 100 * F.col("n") / F.col("total")).otherwise(0.0), 1).alias("pct"), (F.col("n") == F.col("expected")).alias("as_expected"))


def spread(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, least and most of each column, to three places."""
    parts = rows.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])
    stacked = F.array(*[F.struct(F.lit(c).alias("field"), *[F.round(f"{n}_{c}", 3).alias(n) for n in ("mean", "least", "most")]) for c in cols])
    return parts.select(F.explode(stacked).alias("s")).select("s.*")


def by_method(matches: DataFrame) -> DataFrame:
    return matches.groupBy("match_method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def prediction_summary(rows: DataFrame) -> DataFrame:
    """Totals of predictions ``(label, confidence, factors, match_method)``; averages leave out what is no finite number."""
    finite = F.when(~F.isnan("confidence") & (F.abs("confidence") < float("inf")), F.col("confidence"))

    def n(test: Column) -> Column:
        return F.count_if(F.coalesce(test, F.lit(False)))

    label = F.coalesce("label", F.lit("not_addressed"))
    return rows.agg(
        F.count("*").alias("total"), n(label == "accepted").alias("accepted"), n(label == "partial").alias("partial"), n(label == "rejected").alias("rejected"), n(label == "not_addressed").alias("not_addressed"),
        F.round(F.avg(finite), 6).alias("mean_confidence"), n(finite < 0.5).alias("low_confidence"), n(F.size("factors") > 0).alias("with_factors"), n(F.col("match_method").isin("chunk_fallback", "sequence_correction")).alias("fallback"),
    )


def alignment_errors(rows: DataFrame) -> DataFrame:
    """Counts of alignment problems in a fixed order: none, weak, pending, sequence, shared."""
    cats = {"no_match": F.col("score").isNull(), "weak_match": F.col("score") < 0.3, "label_pending": F.col("score").isNotNull() & F.col("label").isNull(), "sequence_correction": F.col("match_method") == "sequence_correction", "shared_response": F.col("shared")}
    agg = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in cats.items()])
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("category"), F.col(k).alias("n")) for i, k in enumerate(cats, 1)])
    return agg.select(F.explode(cells).alias("c")).select("c.*").where("n > 0")


def failure_table(rows: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """Per error category: count, share in percent, description and the first query."""
    said = F.create_map(*[F.lit(v) for kv in descriptions.items() for v in kv])
    total = rows.agg(F.count("*").alias("total"))
    g = rows.groupBy("error_category").agg(F.count("*").alias("n"), F.substring(F.min_by("query", "query_id"), 1, 80).alias("example"))
    return g.crossJoin(F.broadcast(total)).select("error_category", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("pct"), F.coalesce(said[F.col("error_category")], F.lit("")).alias("description"), "example")


def crosstab(rows: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts with one column per value; the value list keeps the pivot to one pass."""
    return rows.groupBy(row).pivot(col, values).count().fillna(0)


def findings(metrics: DataFrame, errors: DataFrame) -> str:
    """A short Markdown report of the metric and error tables, which are small."""
    head = ["mode", "query_type", "n_queries", "recall_at_1", "recall_at_5", "mrr", "ndcg_at_5"]
    out = ["# Retrieval findings", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    out += ["| " + " | ".join(str(r[h]) for h in head) + " |" for r in metrics.orderBy("mode", "query_type").collect()]
    out += ["", "## Failures", ""]
    out += [f"- {r['error_category']}: {r['n']} ({r['pct']} %). {r['description']}" for r in errors.orderBy(F.desc("n"), "error_category").collect()]
    return "\n".join(out)


def filter_rows(rows: DataFrame, pair: str | None = None, label: str | None = None, least: float | None = None, contains: str | None = None) -> DataFrame:
    """Rows by pair, class (null counts as not addressed), least confidence, and text in recommendation or match."""
    if pair is not None:
        rows = rows.where(F.col("pair_id") == pair)
    if label is not None:
        rows = rows.where(F.coalesce("label", F.lit("not_addressed")) == label)
    if least is not None:
        rows = rows.where(F.coalesce("confidence", F.lit(0.0)) >= least)
    if contains:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "text", "matched_text")), F.lit(contains.lower())))
    return rows


def page(rows: DataFrame, number: int, size: int, *order) -> DataFrame:
    """Page ``number`` (from 1) in the given order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
