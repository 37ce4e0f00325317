"""Rows as a reader sees them: display rows, counters, truth columns, pivots, lists for filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, classify

#: How detectors are shown.
DETECTORS = {"A": "explicit label", "B": "structured section", "C": "embedded / heuristic"}


def detector_label(detector: str, ocr: str) -> Column:
    """Display name of a detector (its own where it has none), marked where the text comes from OCR."""
    named = F.coalesce(classify.mapped(F.col(detector), DETECTORS), F.col(detector))
    return F.when(F.coalesce(F.col(ocr), F.lit(False)), F.concat(named, F.lit(" (OCR-derived)"))).otherwise(named)


def display_status(similarity: str) -> Column:
    """``matched`` from 0.5, ``weak`` from 0.3, else ``none``."""
    s = F.coalesce(F.col(similarity), F.lit(0.0))
    return F.when(s >= 0.5, "matched").when(s >= 0.3, "weak").otherwise("none")


def display_rows(recs: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per recommendation: its match (an exact label first, then the most similar), how many it has, and how it is shown."""
    on = ["pair_id", "rec_id"]
    order = Window.partitionBy(*on).orderBy(*widget_order())
    best = matches.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    counts = matches.groupBy(*on).agg(F.count("*").alias("n_matches"))
    rows = recs.select(*on, "item_label", "text").join(best, on, "left").join(counts, on, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return rows.select(*on, F.coalesce(F.nullif(F.trim("item_label"), F.lit("")), (F.col("rec_id") + 1).cast("string")).alias("shown"), "unit_id", "match_method", "score", "n_matches", display_status("score").alias("status"))


def widget_order() -> list[Column]:
    """Exact labels first, then by similarity, then the smaller unit."""
    return [(F.col("match_method") != "exact_label").cast("int"), F.round("score", 9).desc(), F.col("unit_id")]


def with_uid(rows: DataFrame, pair: str = "pair_id", key: str = "id") -> DataFrame:
    return rows.withColumn("uid", F.concat_ws("::", F.col(pair), F.col(key).cast("string")))


def page_units(chunks: DataFrame) -> DataFrame:
    """Chunks put together again by page, in order."""
    ordered = F.sort_array(F.collect_list(F.struct("ix", "text")))
    return chunks.groupBy("source", "page_number").agg(F.count("*").alias("n_chunks"), F.array_join(F.transform(ordered, lambda c: c["text"]), " ").alias("text"))


def pair_of(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Results with the pair that their passage (chunk id and source) belongs to; null where the corpus lacks it."""
    first = corpus.groupBy("chunk_id", "source").agg(F.min("pair_id").alias("pair_id"))
    return results.join(first, ["chunk_id", "source"], "left")


def row_of(asked: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """For each asked ``(pair_id, id)`` the first such row, or nulls."""
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("pair_id", "id").orderBy(order))).where("rn = 1").drop("rn")
    return asked.join(first, ["pair_id", "id"], "left")


def run_matrix(bank: DataFrame, results: DataFrame) -> DataFrame:
    """Results ``(mode, query_id, rank, ...)`` of the modes that each query of the bank asks for; a query without modes asks for all."""
    asked = bank.select("query_id", F.explode_outer("search_modes").alias("asked"))
    return results.join(asked, "query_id").where(F.col("asked").isNull() | (F.col("asked") == F.col("mode"))).drop("asked")


def type_summary(bank: DataFrame) -> DataFrame:
    return bank.groupBy("query_type").agg(F.count("*").alias("n_queries"), F.sum(F.col("anchor").isNotNull().cast("int")).alias("n_anchors"))


def recall_pivot(metrics: DataFrame, modes: list[str]) -> DataFrame:
    """Recall at 5 of each query type, a column per mode, 0 where there is none."""
    return metrics.where("query_type <> 'ALL'").groupBy("query_type").pivot("mode", modes).agg(F.first("recall_at_5")).fillna(0.0)


def counters(rows: DataFrame) -> DataFrame:
    """Number of rows, of each class, and the mean confidence (0 without rows)."""
    label = F.coalesce("label", F.lit("not_addressed"))
    return rows.agg(F.count("*").alias("shown"), *[F.count_if(label == k).alias(k) for k in ("accepted", "partial", "rejected", "not_addressed")], F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean_confidence"))


def stage_summary(rows: DataFrame) -> DataFrame:
    """Per pair: recommendations, how many are aligned and classified, and the mean confidences."""
    return rows.groupBy("pair_id").agg(F.count("*").alias("recommendations"), F.count_if(F.col("match_method").isNotNull() & (F.coalesce("score", F.lit(0.0)) > 0)).alias("aligned"), F.count("label").alias("classified"), F.round(F.avg("score"), 6).alias("mean_alignment"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def sources_found(results: DataFrame) -> DataFrame:
    """How many results each source has, most first."""
    return results.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def filter_values(rows: DataFrame, cols: list[str]) -> DataFrame:
    """``(field, value)``: the distinct values of each column, in order."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    return rows.select(F.explode(cells).alias("c")).select("c.*").where("value is not null").distinct().orderBy("field", "value")


def issues(rows: DataFrame) -> DataFrame:
    """``(issue, pair_id, id)`` of predictions that want a look: low confidence, penalty factors, rejected, not addressed, fallback matches."""
    tests = {"low_confidence": F.col("confidence") < 0.5, "confidence_factors": F.size("factors") > 0, "rejected": F.col("label") == "rejected", "not_addressed": F.coalesce("label", F.lit("not_addressed")) == "not_addressed", "fallback": F.col("match_method").isin("chunk_fallback", "sequence_correction")}
    names = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return rows.select(F.explode(names).alias("issue"), "pair_id", "id")


# -- truth ----------------------------------------------------------------------------------------


def truth_by_label(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions ``(item_label, label)`` with the truth of the same label, without case and blanks around; without one it is not addressed."""
    known = truth.groupBy(F.lower(F.trim("item_label")).alias("at")).agg(F.max("truth").alias("truth"))
    return predictions.withColumn("at", F.lower(F.trim("item_label"))).join(known, "at", "left").drop("at").withColumn("truth", F.coalesce("truth", F.lit("not_addressed")))


def truth_by_position(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions with a column ``position`` and the truth at that position; beyond its end it is not addressed."""
    return predictions.join(truth.select("position", "truth"), "position", "left").withColumn("truth", F.coalesce("truth", F.lit("not_addressed")))


def truth_status(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row ``(n_predictions, n_truth, status)``: truth is only used where the counts agree."""
    n = predictions.agg(F.count("*").alias("n_predictions")).crossJoin(truth.agg(F.count("*").alias("n_truth")))
    return n.withColumn("status", F.when(F.col("n_truth") == 0, "no ground truth").when(F.col("n_truth") != F.col("n_predictions"), "counts differ").otherwise("available"))


def benchmark_rows(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions ``(pair_id, id, label)`` with ``true_label`` and ``correct``, both null without a truth."""
    known = truth.select("pair_id", "id", classify.canonical_label("truth").alias("true_label"))
    out = predictions.join(known, ["pair_id", "id"], "left")
    return out.withColumn("correct", F.when(F.col("true_label").isNotNull(), classify.canonical_label("label") == F.col("true_label")))


# -- retrieval against resolved passages ----------------------------------------------------------


def retrieval_scores(results: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per query of ``relevant (query_id, chunk_id)``: precision at 3, recall at 5 of all its relevant passages, first hit, reciprocal rank.

    A query that found nothing has zeros.  ``results`` may come from any search.
    """
    known = relevant.select("query_id", "chunk_id").distinct()
    hits = results.select("query_id", "chunk_id", "rank").join(known, ["query_id", "chunk_id"], "left_semi")
    per = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= 3).alias("hits_at_3"), F.count_if(F.col("rank") <= 5).alias("hits_at_5"), F.min("rank").alias("first_relevant_rank"))
    got = results.groupBy("query_id").agg(F.count("*").alias("retrieved"))
    rows = known.groupBy("query_id").agg(F.count("*").alias("relevant")).join(got, "query_id", "left").join(per, "query_id", "left").fillna(0, ["retrieved", "hits_at_3", "hits_at_5"])
    return rows.select("query_id", "relevant", "retrieved", "hits_at_3", "hits_at_5", F.round(F.col("hits_at_3") / 3, 6).alias("precision_at_3"), F.round(F.col("hits_at_5") / F.col("relevant"), 6).alias("recall_at_5"), F.round(F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0)), 6).alias("mrr"), "first_relevant_rank")


def unresolved(queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """Queries without a relevant passage, which an evaluation must not have."""
    return queries.join(relevant, "query_id", "left_anti")


def retrieval_summary(scores: DataFrame) -> DataFrame:
    """``(metric, value)`` of the means over all queries."""
    row = scores.agg(F.count("*").cast("double").alias("Queries"), F.avg("precision_at_3").alias("Mean Precision@3"), F.avg("recall_at_5").alias("Mean Recall@5"), F.avg("mrr").alias("Mean MRR"))
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(f"`{c}`"), 6).alias("value")) for c in row.columns])
    return row.select(F.explode(cells).alias("c")).select("c.*")


# -- recommendation texts -------------------------------------------------------------------------


def without_next_section(text: str) -> Column:
    """The text up to the sentence end before a heading ``12: Words`` that ends it."""
    t = T.extraction_clean(text)
    cut = F.regexp_extract(t, r"^(.*?[.!?])\s+\d{1,2}\s*:\s+[A-Za-z].*$", 1)
    return F.when(cut != "", F.trim(cut)).otherwise(t)


def apply_rules(rows: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """Texts with a corpus's own clean-up rules ``(source_pattern, label, pattern, replacement)`` applied, in the order of their patterns.

    A rule is for the sources that hold its pattern and one label; the rules are a small table.
    """
    names = rows.columns
    j = rows.join(F.broadcast(rules), F.contains("source", F.col("source_pattern")) & (F.trim("item_label") == F.trim("label")), "left")
    kept = F.sort_array(F.collect_list(F.when(F.col("pattern").isNotNull(), F.struct("pattern", "replacement"))))
    own = [c for c in names if c != text]
    out = j.groupBy(*own, text).agg(kept.alias("rules"))
    changed = F.aggregate("rules", F.col(text), lambda t, r: F.trim(F.regexp_replace(t, F.concat(F.lit("(?i)"), r["pattern"]), r["replacement"])))
    return out.withColumn(text, changed).select(*names)


def fuller_body(rows: DataFrame, pages: DataFrame, lead: str = r"(?i)\b(?:we\s+)?(?:therefore\s+)?recommend", prefix: int = 60, window: int = 4000) -> DataFrame:
    """Rows ``(source, rec_id, text)`` whose text a longer version in the document's body replaces.

    For texts with a clause ``(a)``: from the directive on, its first characters are looked up in the document; with two places or more the longest
    sentence from one of them that has ``(a)`` too wins, where it is longer.  The other rows keep their text.
    """
    stop = r"(?s)^(.*?\.)(?:\s+[A-Z0-9].*|\s*)$"
    clause = F.regexp_extract(F.col("text"), f"(?s)({lead}.*)$", 1)
    first = F.regexp_extract(clause, stop, 1)
    asked = rows.select("source", "rec_id", "text", F.when(F.contains(clause, F.lit("(a)")), F.trim(F.when(first != "", first).otherwise(clause))).alias("clause"))
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    body = pages.groupBy("source").agg(T.extraction_clean(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), " ")).alias("body"))
    # pieces of the body between places of the prefix: the first stands before any
    head = F.substring("clause", 1, prefix)
    parts = F.split("body", F.concat(F.lit("\\Q"), head, F.lit("\\E")))
    found = asked.where("clause is not null and clause <> ''").join(body, "source")
    places = T.held(found, "parts", parts).where(F.size("parts") > 2)
    sentence = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.trim(F.regexp_extract(F.substring(F.concat(head, F.call_function("array_join", F.slice("parts", i + 1, F.size("parts")), head)), 1, window), stop, 1)))
    full = T.held(places, "versions", F.filter(sentence, lambda s: F.contains(s, F.lit("(a)"))))
    best = F.aggregate("versions", F.lit(""), lambda a, s: F.when(F.length(s) > F.length(a), s).otherwise(a))
    longer = T.held(full, "best", best).where(F.length("best") > F.length("clause")).select("source", "rec_id", "best")
    return rows.join(longer, ["source", "rec_id"], "left").withColumn("text", F.coalesce("best", "text")).drop("best")


def without_repeat(rec: str, block: str, response: str) -> Column:
    """A reply's block without the recommendation that it repeats at its start, where half of it and 8 words or more are repeated and
    8 words or more are left; else the reply, or the block where there is no other."""
    t = F.trim(F.coalesce(F.col(block), F.col(response), F.lit("")))
    m = align.prefix_match(rec, block)
    rest = F.ltrim(F.regexp_replace(t, F.concat(F.lit("^(?:[^A-Za-z0-9]*[A-Za-z0-9]+){"), m["matched"].cast("string"), F.lit("}")), F.lit("")), F.lit(" \t\r\n.:;,-"))
    reply = F.trim(F.coalesce(F.col(response), F.lit("")))
    return F.when((m["ratio"] >= 0.5) & (m["matched"] >= 8) & (F.size(T.words(rest)) >= 8), rest).when((reply != "") & (reply != t), reply).otherwise(t)
