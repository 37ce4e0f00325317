"""Retrieval and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.store import Save, planned

#: Grade of each relevance label.
GRADES = {"relevant": 3, "likely_relevant": 2, "partial": 1, "doc_match_only": 1, "irrelevant": 0, "unknown": 0}
LABELS = ("accepted", "partially_accepted", "rejected", "not_addressed")


def auto_relevance(anchor: Column, doc_match: Column, coverage: Column) -> Column:
    """Label from: anchor contained, source expected (null: not stated), share of expected keywords (null: none stated)."""
    hit = F.coalesce(doc_match, F.lit(False))
    return (
        F.when(F.coalesce(anchor, F.lit(False)), "relevant").when(hit & (coverage >= 0.5), "likely_relevant").when(hit & (coverage >= 0.25), "partial")
        .when(hit, "doc_match_only").when(doc_match == F.lit(False), "irrelevant").otherwise("unknown")
    )


def label_results(results: DataFrame, bank: DataFrame) -> DataFrame:
    """Adds ``doc_match, keyword_coverage, anchor_match, auto_relevance`` to results with text, by the query bank's
    ``expected_docs, expected_keywords, anchor``."""
    j = results.join(bank.select("query_id", "query_type", "expected_docs", "expected_keywords", "anchor"), "query_id")
    n = F.size("expected_keywords")
    found = F.size(F.filter("expected_keywords", lambda k: F.contains(F.lower("text"), F.lower(k))))
    j = j.withColumn("doc_match", F.when(F.size("expected_docs") > 0, F.array_contains("expected_docs", F.col("source"))))
    j = j.withColumn("keyword_coverage", F.when(n > 0, found / n))
    j = j.withColumn("anchor_match", F.coalesce(F.contains(T.normalise("text"), T.normalise("anchor")), F.lit(False)))
    return j.withColumn("auto_relevance", auto_relevance(F.col("anchor_match"), F.col("doc_match"), F.col("keyword_coverage")))


def is_hit(label: str) -> Column:
    return F.col(label).isin("relevant", "likely_relevant")


def grade(label: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(v) for kv in GRADES.items() for v in kv])[F.col(label)], F.lit(0))


def metrics(labelled: DataFrame) -> DataFrame:
    """Means by mode and query type, and over all types of a mode (``ALL``), of queries that returned rows."""
    ideal = Window.partitionBy("mode", "query_id").orderBy(F.desc("grade"), "rank")
    rows = labelled.withColumn("hit", is_hit("auto_relevance").cast("int")).withColumn("grade", grade("auto_relevance")).withColumn("best", F.row_number().over(ideal))

    def gain(rank: str) -> Column:
        return F.sum(F.when(F.col(rank) <= 5, F.col("grade") / F.log2(F.col(rank) + 1)).otherwise(0.0))

    def hits(k: int) -> Column:
        return F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))

    per = rows.groupBy("mode", "query_type", "query_id").agg(
        hits(1).alias("h1"), hits(3).alias("h3"), hits(5).alias("h5"), F.sum((F.col("rank") <= 5).cast("int")).alias("n5"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), gain("rank").alias("dcg"), gain("best").alias("idcg"),
        F.max(F.when((F.col("rank") == 1) & F.col("doc_match"), 1).otherwise(0)).alias("doc1"),
    )
    out = per.groupingSets([["mode"], ["mode", "query_type"]], "mode", "query_type").agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.col("h1")), 3).alias("recall_at_1"), F.round(F.avg((F.col("h3") > 0).cast("int")), 3).alias("recall_at_3"), F.round(F.avg((F.col("h5") > 0).cast("int")), 3).alias("recall_at_5"),
        F.round(F.avg(F.col("h1")), 3).alias("precision_at_1"), F.round(F.avg(F.col("h3") / 3), 3).alias("precision_at_3"), F.round(F.avg(F.col("h5") / F.greatest("n5", F.lit(1))), 3).alias("precision_at_5"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 3).alias("mrr"), F.round(F.avg(F.col("h1")), 3).alias("top1_accuracy"), F.round(F.avg("doc1"), 3).alias("doc_accuracy"),
        F.round(F.avg(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)), 3).alias("ndcg_at_5"), F.grouping("query_type").alias("g"),
    )
    return out.withColumn("query_type", F.when(F.col("g") == 1, "ALL").otherwise(F.col("query_type"))).drop("g")


def error_category(label: Column, preview_words: Column, doc_match: Column, coverage: Column, score: Column) -> Column:
    """Why a first result is no hit; empty for hits.  ``preview_words`` counts the words shown, or the full text's for a fuller answer."""
    hit, cov = F.coalesce(doc_match, F.lit(False)), F.coalesce(coverage, F.lit(0.0))
    return (
        F.when(label.isin("relevant", "likely_relevant"), "").when(preview_words < 60, "chunk_too_small").when(preview_words > 450, "chunk_too_large")
        .when(~hit & (score > 0.15), "wrong_doc_similar_topic").when(~hit, "wrong_document").when(cov < 0.2, "paraphrase_miss").otherwise("ranking_issue")
    )


def anchors_in(anchors: DataFrame, chunks: DataFrame, same_source: bool = False, save: Save = planned) -> DataFrame:
    """Pairs of anchor and passage whose normalised text holds the anchor's.

    Candidates come from an equi-join on the rarest three-word shingle of each anchor, then containment decides; anchors of fewer than
    three words are compared with every passage.
    """
    a = save(T.held(T.held(anchors, "a_norm", F.trim(T.normalise("anchor"))), "aw", T.words("a_norm")).where("a_norm <> ''"), "anchors")
    c = save(T.held(chunks, "c_norm", T.normalise("text")).drop("text"), "normal")

    def triples(w: str) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, F.lit(3)), " ")))

    # inner triples only: the first and last word of an anchor may be parts of longer words
    inner = F.when(F.size("aw") >= 5, F.expr("slice(aw, 2, size(aw) - 2)"))
    a = a.withColumn("inner", inner)
    asked = a.where("inner is not null").select("anchor_id", F.explode(triples("inner")).alias("t")).distinct()
    shingled = T.held(c.select("chunk_id", "c_norm"), "cw", T.words("c_norm")).select("chunk_id", F.explode(triples("cw")).alias("t"))
    postings = save(shingled.join(asked.select("t").distinct(), "t", "left_semi").distinct(), "postings")
    freq = postings.groupBy("t").agg(F.count("*").alias("df"))
    rarest = asked.join(freq, "t").groupBy("anchor_id").agg(F.min_by("t", F.struct("df", "t")).alias("t"))
    near = rarest.join(postings, "t").select("anchor_id", "chunk_id")
    few = a.where("inner is null").select("anchor_id").crossJoin(c.select("chunk_id"))
    both = near.unionByName(few).join(a, "anchor_id").join(c.select("chunk_id", "c_norm", *([F.col("source").alias("c_source")] if same_source else [])), "chunk_id")
    if same_source:
        both = both.where("source = c_source")
    return both.where(F.contains("c_norm", F.col("a_norm"))).select("anchor_id", "chunk_id")


def confusion(pairs: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts of every (truth, prediction) of the label list, zeros included."""
    spark = pairs.sparkSession
    names = spark.createDataFrame([(x,) for x in labels], "truth string")
    grid = names.crossJoin(names.withColumnRenamed("truth", "prediction"))
    counts = pairs.groupBy("truth", "prediction").agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "prediction"], "left").fillna(0, ["n"])


def scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then ``macro`` means and ``accuracy`` (in ``f1``), with 0 for 0/0."""
    tp = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0))
    by_truth = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), tp.alias("tp"))
    by_pred = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b == 0, 0.0).otherwise(a / b)

    rows = by_truth.join(by_pred, "label").withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    macro = rows.agg(F.lit("macro").alias("label"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    total = rows.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), ratio(F.sum("tp"), F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    return rows.select("label", "precision", "recall", "f1", "support").unionByName(macro).unionByName(total)
