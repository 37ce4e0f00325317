"""Registered queries of the engine's own operators; ``lectern.oracles`` has their SQL twins.

The tables stand in for the engine's relations: a document is a page (``source`` the report, ``doc_id`` the page order) or a passage,
benchmark items are queries and anchors, user and assistant turns are recommendations and responses of a pair.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern import bank
from lectern.functions import sql
from lectern.functions import text as T
from lectern.operators import align, chunks, classify, evaluate, extract, pages, report, search, units, validate, views
from lectern.plans import analysis
from lectern.oracles import SQL  # noqa: F401
from lectern.sources import io
from lectern.sources.store import shared_dir, store
from lectern.streaming import log

FLAGSHIP = "keyword_search"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page_number"), "text", (F.col("doc_id") % 7 == 0).alias("ocr"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents with ids that are unique over the corpus."""
    cut = chunks.window_chunks(table(spark, sf_dir, "documents"), 400, 50, 60, page="doc_id")
    return cut.withColumn("chunk_id", F.col("page_number").cast("long") * 1_000_000 + F.col("ix"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.clean("text").alias("query"), "text")


def digest(c) -> Column:
    return F.md5(F.encode(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "UTF-8"))


def six(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# -- pages and passages ---------------------------------------------------------------------------


@query
def extraction_audit(spark, sf_dir):
    return report.extraction_audit(page_table(spark, sf_dir))


@query
def chunks_merged(spark, sf_dir):
    return passages(spark, sf_dir).select("source", "page_number", "ix", "n_words", digest("text").alias("text_md5"))


@query
def chunks_plain(spark, sf_dir):
    cut = chunks.numbered(chunks.window_chunks(table(spark, sf_dir, "documents"), 200, 30, page="doc_id"))
    return cut.select("source", "page_number", "chunk_id", "n_words", digest("text").alias("text_md5"))


@query
def chunks_folded(spark, sf_dir):
    """The general fold, which agrees with the closed form where that holds."""
    cut = chunks.merge_short(chunks.window_chunks(table(spark, sf_dir, "documents"), 400, 50, page="doc_id"), 60)
    return cut.select("source", "page_number", "ix", "n_words", digest("text").alias("text_md5"))


@query
def chunk_audit(spark, sf_dir):
    return report.chunk_audit(passages(spark, sf_dir))


@query
def chunk_context(spark, sf_dir):
    near = chunks.with_context(chunks.numbered(passages(spark, sf_dir).drop("chunk_id")), 1)
    return near.select("source", "chunk_id", digest("context_before").alias("before_md5"), digest("context_after").alias("after_md5"))


@query
def chunk_fingerprint(spark, sf_dir):
    return chunks.fingerprint(chunks.numbered(passages(spark, sf_dir).drop("chunk_id")))


@query
def distinct_documents(spark, sf_dir):
    return chunks.distinct_chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id").select("doc_id", "source")


@query
def repeated_lines(spark, sf_dir):
    return pages.repeated_lines(page_table(spark, sf_dir), share=0.02)


@query
def without_repeated_lines(spark, sf_dir):
    return pages.without_repeated_lines(page_table(spark, sf_dir), share=0.02).select("source", "page_number", digest("text").alias("text_md5"))


@query
def full_text(spark, sf_dir):
    return pages.full_text(page_table(spark, sf_dir)).select("source", F.length("text").alias("n"), digest("text").alias("text_md5"))


@query
def page_of_offset(spark, sf_dir):
    p = page_table(spark, sf_dir)
    asked = p.groupBy("source").agg(F.sum(F.length("text")).alias("n")).select("source", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(5000))).alias("offset"))
    return pages.page_of(asked, p)


@query
def paragraph_tails(spark, sf_dir):
    p = page_table(spark, sf_dir)
    body = F.regexp_replace("text", r"[()]", "")
    marked = F.concat(F.when(F.col("page_number") % 4 == 1, F.lit("12 and 13), ")).otherwise(F.lit("")), body, F.when(F.col("page_number") % 5 == 0, F.lit(" see (paragraph ")).otherwise(F.lit("")))
    return pages.without_paragraph_tails(p.withColumn("text", marked)).select("source", "page_number", "text")


@query
def layout_text(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    y0 = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 1000).cast("double")
    spans = li.select(
        F.concat(F.lit("r"), F.col("l_suppkey") % 5).alias("source"), (F.col("l_partkey") % 40).cast("int").alias("page"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("text"),
        (F.col("l_linenumber") * 50).cast("double").alias("x0"), y0.alias("y0"), (y0 + 10).alias("y1"), F.when(F.col("l_orderkey") % 4 == 0, 8.0).otherwise(11.0).alias("size"), F.lit(1000.0).alias("page_height"),
    )
    return pages.body_text(spans).select("source", "page", F.length("text").alias("n"), digest("text").alias("text_md5"))


@query
def ocr_usage(spark, sf_dir):
    return pages.ocr_usage(page_table(spark, sf_dir))


@query
def page_filters(spark, sf_dir):
    """Flags of bank pages and documents under each page test."""
    own = spark.createDataFrame(bank.PAGES, "page_id string, ix int, text string")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("page_id"), (F.col("doc_id") % 20).cast("int").alias("ix"), "text")
    every = own.unionByName(docs)
    return every.select("page_id", pages.is_contents_page("text", "ix").alias("contents"), pages.is_title_page("text", "ix").alias("title"), pages.is_metadata_page("text").alias("metadata"), pages.is_serial_page("text").alias("serial"))


@query
def metadata_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    extra = F.element_at(F.array(*[F.lit(x) for x in ("", " Crown copyright 2020.", " ISBN 978-1-5286-2222-3 Printed in the UK", " Open Government Licence; Crown Copyright")]), (F.col("doc_id") % 4 + 1).cast("int"))
    t = docs.select("doc_id", F.concat("text", extra).alias("t"))
    return t.select("doc_id", pages.is_metadata_page("t").alias("metadata"), digest(pages.strip_licence("t")).alias("stripped_md5"))


@query
def page_pipeline(spark, sf_dir):
    own = spark.createDataFrame(bank.PAGES, "page_id string, ix int, text string").select(F.lit("bank").alias("source"), (F.col("ix") + 1).alias("page_number"), "text", F.lit(False).alias("ocr"))
    docs = page_table(spark, sf_dir).withColumn("page_number", F.col("page_number").cast("int"))
    return pages.page_pipeline(own.unionByName(docs)).select("source", "page_number", "ocr", F.length("text").alias("n"))


@query
def passage_flags(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return t.select("doc_id", T.is_title_only("t").alias("title_only"), T.is_contents("t").alias("contents"), T.is_structural("t").alias("structural"))


# -- text functions -------------------------------------------------------------------------------


@query
def text_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", digest(T.clean("text")).alias("clean_md5"), digest(T.normalise("text")).alias("normal_md5"), T.dedup_key("text").alias("dedup_key"), digest(T.extraction_clean("text")).alias("extraction_md5"),
        F.size(T.tokens(T.normalise("text"))).alias("n_tokens"), F.array_join(F.slice(T.query_terms("text"), 1, 6), " ").alias("terms"),
    )


@query
def sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(T.sentences("text")).alias("n"), digest(T.first_sentence("text")).alias("first_md5"), digest(T.last_sentence("text")).alias("last_md5"))


@query
def headings(spark, sf_dir):
    lead = F.element_at(F.array(*[F.lit(x) for x in bank.LEADS]), (F.col("doc_id") % len(bank.LEADS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.heading(F.concat(lead, "text")).alias("heading"))


@query
def label_functions(spark, sf_dir):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(bank.LABELS)], "id int, raw string")
    return rows.select("id", T.label("raw").alias("label"), T.item_label("raw").alias("item_label"), T.roman("raw").alias("roman"), T.slug(F.concat(F.lit("/a/"), F.col("raw"), F.lit(".PDF"))).alias("slug"))


@query
def label_order(spark, sf_dir):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(bank.LABELS)], "id int, raw string")
    return rows.select("id", "raw", F.row_number().over(Window.orderBy(T.label_sort_key("raw"), "id")).alias("position"))


@query
def token_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = c.withColumn("next", F.lead("text").over(w)).where("next is not null and role = 'user'")
    n = p.select("conv_id", "turn", "text", "next", T.normalise("text").alias("a"), T.normalise("next").alias("b")).withColumn("m", align.prefix_match("text", "next"))
    return n.select("conv_id", "turn", six(T.jaccard("a", "b")).alias("jaccard"), six(T.containment("text", "next")).alias("containment"), "m.matched", six("m.ratio").alias("ratio"))


@query
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", digest(pages.strip_tags("html")).alias("text_md5"))


@query
def preview_sentences(spark, sf_dir):
    return pages.distinct_sentences(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", digest("text").alias("text_md5"))


@query
def preview_window(spark, sf_dir):
    return pages.densest_window(table(spark, sf_dir, "documents"), "doc_id", "text", ["the", "que"])


@query
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pages.highlight("text", ["the", "then", "que"]).alias("t")).select("doc_id", digest("t").alias("text_md5"))


@query
def source_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", pages.source_title("source", {"src0": "First source"}).alias("title"))


@query
def find_on_page(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("wanted"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = evaluate.anchors_in(b.select(F.col("item_id").alias("anchor_id"), F.array_join(F.slice(T.words("wanted"), 2, 6), " ").alias("anchor")), d.select(F.col("doc_id").alias("chunk_id"), "text"), save=store(spark))
    j = near.join(b, F.col("anchor_id") == F.col("item_id")).join(d, F.col("chunk_id") == F.col("doc_id"))
    return j.select("item_id", "doc_id", pages.find_on_page("text", "wanted").alias("hit")).select("item_id", "doc_id", "hit.kind", "hit.at")


# -- retrieval ------------------------------------------------------------------------------------


def found_passages(spark, sf_dir, k: int) -> DataFrame:
    save = store(spark)
    return search.keyword_search(save(passages(spark, sf_dir), "passages"), questions(spark, sf_dir), k, save)


@query
def keyword_search(spark, sf_dir):
    return found_passages(spark, sf_dir, 5).select("query_id", "rank", "chunk_id", "source", six("score").alias("score"))


@query
def idf_weights(spark, sf_dir):
    return search.build_index(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")).idf.select("term", six("idf").alias("idf"))


@query
def scoped_search(spark, sf_dir):
    """Weights are fitted inside the scope, so the filter comes first."""
    save = store(spark)
    scope = save(passages(spark, sf_dir).where("source in ('src1', 'src2')"), "scope")
    return search.keyword_search(scope, questions(spark, sf_dir), 3, save).select("query_id", "rank", "chunk_id", six("score").alias("score"))


def dense_passages(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text").join(e, "chunk_id")


def dense_questions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return questions(spark, sf_dir).select("query_id", "query").join(e, "query_id")


@query
def semantic_search(spark, sf_dir):
    return search.semantic_search(dense_passages(spark, sf_dir), dense_questions(spark, sf_dir), 5).select("query_id", "rank", "chunk_id", six("score").alias("score"))


@query
def hybrid_search(spark, sf_dir):
    return search.hybrid_search(dense_passages(spark, sf_dir), dense_questions(spark, sf_dir), 5, sources=["src1"], save=store(spark)).select("query_id", "rank", "chunk_id", six("score").alias("score"))


@query
def source_boost(spark, sf_dir):
    found = keyword_search(spark, sf_dir)
    return search.boost_sources(found, ["src0", "src3"]).select("query_id", "rank", "chunk_id", six("score").alias("score"))


@query
def enriched_results(spark, sf_dir):
    found = found_passages(spark, sf_dir, 3).join(questions(spark, sf_dir).select("query_id", "query"), "query_id")
    return search.enrich(found).select("query_id", "chunk_id", F.array_join("matched_terms", " ").alias("matched_terms"), "confidence", "heading")


@query
def query_types(spark, sf_dir):
    own = spark.createDataFrame([(1000 + i, q) for i, q in enumerate(bank.QUERIES)], "query_id long, query string")
    every = own.unionByName(questions(spark, sf_dir).select("query_id", "query"))
    return every.select("query_id", search.query_type("query").alias("kind"), search.recommended_alpha("query").alias("alpha"), search.mix_label(search.recommended_alpha("query")).alias("mix"))


# -- evaluation -----------------------------------------------------------------------------------


@query
def anchors(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("anchor_id"), F.col("text").alias("anchor"))
    return evaluate.anchors_in(a, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), save=store(spark))


@query
def unresolved_anchors(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("anchor_id"))
    return a.join(anchors(spark, sf_dir).select("anchor_id").distinct(), "anchor_id", "left_anti")


def labelled_results(spark, sf_dir) -> DataFrame:
    q = questions(spark, sf_dir)
    kind = F.when(F.col("query_id") % 3 == 0, "exact").when(F.col("query_id") % 3 == 1, "broad").otherwise("topic")
    docs = F.when(F.col("query_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(*[F.lit(f"src{i}") for i in range(0, 20, 2)]))
    known = q.select("query_id", kind.alias("query_type"), docs.alias("expected_docs"), F.slice(T.query_terms("query"), 1, 4).alias("expected_keywords"), F.when(F.col("query_id") % 5 == 0, F.array_join(F.slice(T.words("text"), 1, 6), " ")).alias("anchor"))
    found = store(spark)(found_passages(spark, sf_dir, 5).select("query_id", "rank", "chunk_id", "source", "text", "score").withColumn("mode", F.lit("keyword")), "found")
    alone = found.where("rank <= 3").withColumn("mode", F.lit("short"))
    return evaluate.label_results(found.unionByName(alone), known).join(q.select("query_id", "query"), "query_id")


@query
def relevance_labels(spark, sf_dir):
    return labelled_results(spark, sf_dir).select("mode", "query_id", "rank", "doc_match", six("keyword_coverage").alias("keyword_coverage"), "anchor_match", "auto_relevance")


@query
def retrieval_metrics(spark, sf_dir):
    return evaluate.metrics(labelled_results(spark, sf_dir))


def failures(spark, sf_dir) -> DataFrame:
    rows = labelled_results(spark, sf_dir).where("rank = 1 and mode = 'keyword'")
    shown = F.size(T.words(F.substring("text", 1, 200)))
    full = F.size(T.words("text"))
    cat = evaluate.error_category(F.col("auto_relevance"), shown, F.col("doc_match"), F.col("keyword_coverage"), F.col("score"))
    more = evaluate.error_category(F.col("auto_relevance"), full, F.col("doc_match"), F.col("keyword_coverage"), F.col("score"))
    return rows.withColumn("error_category", cat).withColumn("error_category_full", more).where("error_category <> ''")


@query
def error_table(spark, sf_dir):
    rows = failures(spark, sf_dir).drop("error_category").withColumnRenamed("error_category_full", "error_category")
    return report.failure_table(rows, bank.ERRORS)


@query
def error_crosstab(spark, sf_dir):
    return report.crosstab(failures(spark, sf_dir).withColumnRenamed("error_category_full", "cat"), "query_type", "cat", ["chunk_too_small", "wrong_document", "wrong_doc_similar_topic", "paraphrase_miss", "ranking_issue"])


def label_pairs(spark, sf_dir) -> DataFrame:
    truth = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("quality") == 1, "partially_accepted").when(F.col("toxic") == 1, "rejected").otherwise("not_addressed")
    guess = F.element_at(F.array(*[F.lit(x) for x in ("accepted", "partially_accepted", "accepted", "rejected")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select("doc_id", truth.alias("truth"), guess.alias("prediction"))


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(label_pairs(spark, sf_dir))


@query
def class_scores(spark, sf_dir):
    s = evaluate.scores(evaluate.confusion(label_pairs(spark, sf_dir)))
    return s.select("label", six("precision").alias("precision"), six("recall").alias("recall"), six("f1").alias("f1"), "support")


# -- alignment ------------------------------------------------------------------------------------


def turns(spark, sf_dir, role: str, name: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").where(F.col("role") == role).select(F.col("conv_id").alias("pair_id"), (F.row_number().over(w) - 1).alias(name), "text")


def recommendations(spark, sf_dir) -> DataFrame:
    numbered = F.when(F.col("pair_id") % 3 == 0, F.concat(F.lit("Recommendation "), (F.col("rec_id") + 1).cast("string"), F.lit("."))).otherwise("")
    return turns(spark, sf_dir, "user", "rec_id").withColumn("item_label", numbered)


def reply_units(spark, sf_dir) -> DataFrame:
    asked = turns(spark, sf_dir, "user", "unit_id").select("pair_id", "unit_id", T.squeeze("text").alias("echo"))
    labels = F.when(F.col("unit_id") % 2 == 0, F.array((F.col("unit_id") + 1).cast("string"), F.lit("9"))).otherwise(F.array(F.lit("x"), F.lit("9")))
    u = turns(spark, sf_dir, "assistant", "unit_id").withColumnRenamed("text", "response_text").join(asked, ["pair_id", "unit_id"], "left")
    quoted = F.when(F.col("pair_id") % 2 == 0, F.col("echo"))
    u = u.withColumn("recommendation_labels", labels).withColumn("quoted_recommendation_text", quoted).withColumn("full_unit_text", F.concat_ws(" ", F.col("echo"), F.col("response_text")))
    return u.withColumn("boundary_reason", F.lit("next_heading")).withColumn("extraction_confidence", F.lit(0.95)).drop("echo")


@query
def similarity_join(spark, sf_dir):
    m = align.match_chunks(turns(spark, sf_dir, "user", "rec_id"), turns(spark, sf_dir, "assistant", "chunk_id"))
    return m.select("pair_id", "rec_id", "chunk_id", "rank", six("score").alias("score"))


@query
def label_index(spark, sf_dir):
    return align.label_index(reply_units(spark, sf_dir))


@query
def unit_matches(spark, sf_dir):
    m = align.match_units(recommendations(spark, sf_dir), reply_units(spark, sf_dir), save=store(spark))
    return m.select("pair_id", "rec_id", "unit_id", "match_method", six("score").alias("score"), "primary")


@query
def ordinal_matches(spark, sf_dir):
    m = align.match_ordinal(recommendations(spark, sf_dir), reply_units(spark, sf_dir), save=store(spark))
    return m.select("pair_id", "rec_id", "unit_id", "match_method", six("score").alias("score"))


@query
def best_matches(spark, sf_dir):
    recs, u = recommendations(spark, sf_dir), reply_units(spark, sf_dir)
    m = store(spark)(align.match_units(recs, u, save=store(spark)), "matches")
    shared = align.shared_units(m).select("pair_id", "unit_id", F.lit(True).alias("shared"))
    b = align.best_match(recs, m).join(shared, ["pair_id", "unit_id"], "left")
    return b.select("pair_id", "rec_id", "unit_id", "match_method", six("score").alias("score"), align.status(F.col("match_method"), F.coalesce("shared", F.lit(False)), F.coalesce("score", F.lit(0.0))).alias("status"))


@query
def alignment_summary(spark, sf_dir):
    return report.by_method(align.match_units(recommendations(spark, sf_dir), reply_units(spark, sf_dir), save=store(spark)))


# -- stance, confidence, export -------------------------------------------------------------------


def replies(spark, sf_dir) -> DataFrame:
    phrase = F.element_at(F.array(*[F.lit(x) for x in bank.REPLIES]), (F.col("doc_id") % len(bank.REPLIES) + 1).cast("int"))
    tail = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(phrase, tail).alias("matched_text"), (F.col("doc_id") % 10 / 10.0).alias("similarity"), F.element_at(F.array(*[F.lit(x) for x in bank.METHODS]), (F.col("doc_id") % len(bank.METHODS) + 1).cast("int")).alias("match_method"))


@query
def stance(spark, sf_dir):
    return replies(spark, sf_dir).withColumn("s", classify.classify("matched_text")).select("doc_id", "s.label", "s.confidence")


def export_rows(spark, sf_dir) -> DataFrame:
    r = replies(spark, sf_dir).withColumn("s", classify.classify("matched_text")).withColumn("classification", classify.mapped(F.col("s.label"), classify.EXPORT_LABEL))
    r = r.withColumn("c", classify.match_confidence("matched_text", "similarity", "similarity", "match_method", "classification"))
    return r.select(
        F.col("source").alias("document_pair"), F.col("doc_id").cast("string").alias("id"), F.col("matched_text").alias("matched_response_text"), "classification", six("c.confidence").alias("confidence"),
        F.struct(F.col("similarity").alias("alignment_confidence"), F.col("match_method").alias("alignment_method"), F.col("c.factors").alias("confidence_factors"), F.col("s.confidence").alias("classification_confidence"), F.when(F.col("doc_id") % 50 == 7, F.lit(None)).otherwise(F.lit("rule_based")).alias("classifier_method")).alias("debug"),
    )


@query
def match_confidence(spark, sf_dir):
    return export_rows(spark, sf_dir).select("id", "classification", "confidence", F.array_join("debug.confidence_factors", "|").alias("factors"))


@query
def export_flat(spark, sf_dir):
    return validate.flatten(export_rows(spark, sf_dir)).drop("matched_response_text").withColumn("debug_confidence_factors", F.array_join("debug_confidence_factors", "; "))


@query
def metadata_failures(spark, sf_dir):
    return validate.metadata_failures(validate.flatten(export_rows(spark, sf_dir)))


@query
def golden_diff(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select(F.col("source").alias("document_pair"), F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("classification"), F.col("n_chars").alias("confidence"))
    n = F.col("id").cast("long")
    new = base.where(n % 11 != 3).withColumn("classification", F.when(n % 7 == 0, "xx").otherwise(F.col("classification"))).withColumn("confidence", F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("confidence")))
    extra = base.where(n % 13 == 0).withColumn("id", F.concat(F.lit("new"), F.col("id")))
    allowed = base.where(n % 35 == 0).select("document_pair", "id", F.lit("classification").alias("field"))
    return validate.diff(base, new.unionByName(extra), allowed)


@query
def export_duplicates(spark, sf_dir):
    r = export_rows(spark, sf_dir).withColumn("id", (F.col("id").cast("long") % 17).cast("string"))
    return validate.duplicates(r)


@query
def export_leaks(spark, sf_dir):
    rules = spark.createDataFrame([("the government", True), (r"\bnoted\b", False)], "pattern string, at_start boolean")
    return validate.leaks(export_rows(spark, sf_dir), rules)


@query
def expectation_failures(spark, sf_dir):
    want = table(spark, sf_dir, "documents").where("doc_id % 9 = 0").select(F.col("source").alias("document_pair"), F.col("doc_id").cast("string").alias("id"), F.lit("accepted").alias("expected"))
    return validate.expectation_failures(export_rows(spark, sf_dir), want)


def predictions(spark, sf_dir) -> DataFrame:
    return validate.flatten(export_rows(spark, sf_dir)).select(F.col("document_pair").alias("pair_id"), "id", F.when(F.col("id").cast("long") % 10 == 9, F.lit(None)).otherwise(F.col("classification")).alias("label"), "confidence", F.col("debug_confidence_factors").alias("factors"), F.col("debug_alignment_method").alias("match_method"), F.col("debug_alignment_confidence").alias("score"), F.col("matched_response_text").alias("matched_text"), F.lit("").alias("text"), (F.col("id").cast("long") % 6 == 0).alias("shared"))


@query
def prediction_summary(spark, sf_dir):
    return report.prediction_summary(predictions(spark, sf_dir))


@query
def alignment_errors(spark, sf_dir):
    return report.alignment_errors(predictions(spark, sf_dir))


@query
def label_distribution(spark, sf_dir):
    want = spark.createDataFrame([("accepted", 100), ("partial", 5), ("rejected", 7), ("not_addressed", 0), ("unknown", 0)], "label string, expected long")
    return report.distribution(predictions(spark, sf_dir), "label", want)


@query
def confidence_spread(spark, sf_dir):
    return report.spread(predictions(spark, sf_dir), ["confidence", "score"])


@query
def pair_summary(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "accepted").alias("accepted"), F.count_if(F.col("label") == "partial").alias("partial"), F.count_if(F.col("label") == "rejected").alias("rejected"), F.count_if(F.coalesce("label", F.lit("not_addressed")) == "not_addressed").alias("not_addressed"), six(F.avg("confidence")).alias("mean_confidence"))


@query
def label_counts(spark, sf_dir):
    return report.value_counts(predictions(spark, sf_dir), "label")


@query
def filtered_page(spark, sf_dir):
    rows = report.filter_rows(predictions(spark, sf_dir), label="accepted", least=0.2, contains="government")
    return report.page(rows.select("pair_id", "id", "confidence"), 2, 15, F.col("id").cast("long"))


# -- extraction and segmentation ------------------------------------------------------------------


def report_pages(spark, sf_dir) -> DataFrame:
    """Bank pages of a report, one copy for each source, among the source's documents."""
    own = spark.createDataFrame(bank.REPORT, "n int, text string")
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    copies = sources.crossJoin(F.broadcast(own)).select("source", F.col("n").alias("page_number"), "text", F.lit(False).alias("ocr"))
    w = Window.partitionBy("source").orderBy("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("k", F.row_number().over(w)).select("source", (F.col("k") + 100).cast("int").alias("page_number"), "text", F.lit(False).alias("ocr"))
    return copies.unionByName(docs)


@query
def recommendations_found(spark, sf_dir):
    return extract.extract(report_pages(spark, sf_dir), save=store(spark)).select("source", "rec_id", "item_label", "detector", "confidence", "page_number", "last_page", "text")


@query
def committee_items(spark, sf_dir):
    return extract.numbered_sections(report_pages(spark, sf_dir), save=store(spark))


@query
def inline_recommendations(spark, sf_dir):
    return extract.inline_paragraphs(report_pages(spark, sf_dir), "113")


@query
def response_units(spark, sf_dir):
    own = spark.createDataFrame(bank.RESPONSE, "n int, text string")
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    p = sources.crossJoin(F.broadcast(own)).select("source", F.col("n").alias("page_number"), "text")
    return units.response_units(p).select("source", "unit_id", "recommendation_label", F.array_join("recommendation_labels", ",").alias("labels"), "quoted_recommendation_text", "response_text", "page_start", "page_end", "extraction_confidence", "boundary_reason")


def items(spark, sf_dir) -> DataFrame:
    rows = spark.createDataFrame(bank.ITEMS, "label string, level string, text string, confidence double")
    sources = table(spark, sf_dir, "documents").select("source").distinct()
    j = sources.crossJoin(F.broadcast(rows))
    return j.select("source", F.lit(1).alias("page_number"), F.concat_ws("_", "source", "label").alias("span_id"), "text", F.lit("B").alias("detector"), "label", "level", F.lit(False).alias("ocr"), "confidence")


@query
def merged_letters(spark, sf_dir):
    return extract.merge_letters(items(spark, sf_dir)).select("source", "label", "level", "text", "confidence")


@query
def collapsed_numerals(spark, sf_dir):
    return extract.without_nested_parents(extract.collapse_single_roman(items(spark, sf_dir))).select("source", "label", "level")


@query
def best_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page_number"), F.col("doc_id").cast("string").alias("span_id"), "text", F.lit("B").alias("detector"), F.lit("").alias("label"), F.lit("numeric").alias("level"), F.lit(False).alias("ocr"), (F.col("doc_id") % 5 / 5.0).alias("confidence"))
    return extract.best_per_key(d).select("source", "span_id", "confidence")


# -- sources, sinks, log --------------------------------------------------------------------------


def shared(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/core-{uuid.uuid4().hex}"


@query
def corpus_round_trip(spark, sf_dir):
    path = f"{shared(spark)}/corpus"
    io.write_corpus(passages(spark, sf_dir).withColumnRenamed("source", "pair_id"), path)
    some = io.read_corpus(spark, path, pairs=["src0", "src1", "src2"])
    return some.groupBy("pair_id").agg(F.count("*").alias("chunks"), F.sum("n_words").alias("words"))


@query
def csv_round_trip(spark, sf_dir):
    path = f"{shared(spark)}/csv"
    io.write_csv(predictions(spark, sf_dir).select("pair_id", "id", "label", "confidence", "factors"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("pair_id", "id", "label", F.col("confidence").cast("double").alias("confidence"), F.coalesce("factors", F.lit("")).alias("factors"))


@query
def json_round_trip(spark, sf_dir):
    path = f"{shared(spark)}/json"
    io.write_json_rows(export_rows(spark, sf_dir), path)
    return spark.read.schema(io.EXPORT_ROW).json(path).select("document_pair", "id", "classification", "confidence", "debug.alignment_method")


@query
def missing_pairs(spark, sf_dir):
    presets = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("pair_id"))
    return io.missing_pairs(presets, table(spark, sf_dir, "documents").select(F.col("source").alias("pair_id")))


@query
def stage_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("ts", (F.col("user_id") % 50).cast("string").alias("pair_id"), F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("status"))
    last = rows.groupBy("pair_id", "stage", "ts").agg(F.max("status").alias("status"))
    return log.stage_status(last).select("pair_id", "stage", "status")


@query
def windowed_events(spark, sf_dir):
    return log.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type"), width="1 hour")


@query
def first_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("o_custkey", "rank", "o_orderkey", "o_totalprice")


@query
def priority_pivot(spark, sf_dir):
    return report.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


# -- views, truth, whole analysis -----------------------------------------------------------------


@query
def detector_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("detector", F.element_at(F.array(*[F.lit(x) for x in "ABCX"]), (F.col("doc_id") % 4 + 1).cast("int"))).withColumn("ocr", F.col("doc_id") % 3 == 0)
    return d.select("doc_id", views.detector_label("detector", "ocr").alias("shown"))


@query
def display_rows(spark, sf_dir):
    recs = recommendations(spark, sf_dir)
    save = store(spark)
    matches = save(align.match_units(recs, reply_units(spark, sf_dir), save=save), "matches")
    return views.display_rows(recs, matches).withColumn("score", six("score"))


@query
def page_units(spark, sf_dir):
    return views.with_uid(views.page_units(passages(spark, sf_dir)), "source", "page_number").select("uid", "n_chunks", digest("text").alias("text_md5"))


@query
def pair_lookup(spark, sf_dir):
    c = passages(spark, sf_dir)
    corpus = c.where("page_number % 3 <> 1").select("chunk_id", "source", F.concat(F.lit("pair-"), F.col("source")).alias("pair_id"))
    return views.pair_of(c.select("chunk_id", "source"), corpus)


@query
def row_lookup(spark, sf_dir):
    rows = predictions(spark, sf_dir).select("pair_id", (F.col("id").cast("long") % 40).cast("string").alias("id"), F.col("id").cast("long").alias("at"), "label")
    asked = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey")).alias("pair_id"), F.col("n_nationkey").cast("string").alias("id"))
    return views.row_of(asked, rows, "at")


def query_bank(spark, sf_dir) -> DataFrame:
    modes = F.when(F.col("query_id") % 3 == 0, F.array(F.lit("keyword"))).when(F.col("query_id") % 3 == 1, F.array(F.lit("keyword"), F.lit("short")))
    kind = F.when(F.col("query_id") % 3 == 0, "exact").when(F.col("query_id") % 3 == 1, "broad").otherwise("topic")
    return questions(spark, sf_dir).withColumn("search_modes", modes).withColumn("query_type", kind).withColumn("anchor", F.when(F.col("query_id") % 5 == 0, F.col("text")))


@query
def type_summary(spark, sf_dir):
    return views.type_summary(query_bank(spark, sf_dir))


@query
def run_matrix(spark, sf_dir):
    found = store(spark)(found_passages(spark, sf_dir, 5).select("query_id", "rank", "chunk_id", F.lit("keyword").alias("mode")), "found")
    return views.run_matrix(query_bank(spark, sf_dir), found.unionByName(found.where("rank <= 3").withColumn("mode", F.lit("short"))))


@query
def recall_pivot(spark, sf_dir):
    return views.recall_pivot(retrieval_metrics(spark, sf_dir), ["keyword", "short"])


@query
def counters(spark, sf_dir):
    return views.counters(report.filter_rows(predictions(spark, sf_dir), least=0.2))


@query
def stage_summary(spark, sf_dir):
    return views.stage_summary(predictions(spark, sf_dir))


@query
def sources_found(spark, sf_dir):
    return views.sources_found(found_passages(spark, sf_dir, 5))


@query
def filter_values(spark, sf_dir):
    return views.filter_values(predictions(spark, sf_dir), ["pair_id", "label", "match_method"])


@query
def issues(spark, sf_dir):
    return views.issues(predictions(spark, sf_dir))


@query
def truth_by_label(spark, sf_dir):
    p = label_pairs(spark, sf_dir).select(F.concat(F.lit(" L"), F.col("doc_id")).alias("item_label"), F.col("prediction").alias("label"))
    t = label_pairs(spark, sf_dir).where("doc_id % 5 <> 2").select(F.concat(F.lit("l"), F.col("doc_id"), F.lit(" ")).alias("item_label"), "truth")
    return evaluate.confusion(views.truth_by_label(p, t).withColumnRenamed("label", "prediction"))


@query
def truth_by_position(spark, sf_dir):
    p = label_pairs(spark, sf_dir).select(F.col("doc_id").alias("position"), "prediction")
    return evaluate.confusion(views.truth_by_position(p, label_pairs(spark, sf_dir).where("doc_id < 100").select(F.col("doc_id").alias("position"), "truth")))


@query
def truth_status(spark, sf_dir):
    return views.truth_status(label_pairs(spark, sf_dir), table(spark, sf_dir, "documents"))


@query
def benchmark_rows(spark, sf_dir):
    truth = predictions(spark, sf_dir).where("id % 4 = 0").select("pair_id", "id", F.lit("Partially-Accepted").alias("truth"))
    return views.benchmark_rows(predictions(spark, sf_dir), truth).select("pair_id", "id", "label", "true_label", "correct")


@query
def retrieval_scores(spark, sf_dir):
    """Passages of the documents that hold a benchmark item are the relevant ones of its query."""
    save = store(spark)
    every = save(passages(spark, sf_dir), "passages")
    held = anchors(spark, sf_dir).select(F.col("anchor_id").alias("query_id"), F.col("chunk_id").alias("page_number"))
    found = search.keyword_search(every, questions(spark, sf_dir), 5, save)
    return views.retrieval_scores(found, every.join(held, "page_number").select("query_id", "chunk_id"))


@query
def retrieval_summary(spark, sf_dir):
    return views.retrieval_summary(store(spark)(retrieval_scores(spark, sf_dir), "scores"))


@query
def next_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit(". 12: Further matters of note")).otherwise(F.lit(" 12 more"))).alias("t"))
    return d.select("doc_id", digest(views.without_next_section("t")).alias("text_md5"))


@query
def repeats_cut(spark, sf_dir):
    r, u = recommendations(spark, sf_dir).withColumnRenamed("text", "rec"), reply_units(spark, sf_dir)
    j = r.join(u, (r.pair_id == u.pair_id) & (r.rec_id == u.unit_id)).select(r.pair_id, "rec_id", "rec", F.col("full_unit_text").alias("block"), F.col("response_text").alias("response"))
    return j.select("pair_id", "rec_id", digest(views.without_repeat("rec", "block", "response")).alias("text_md5"))


def analysed(spark, sf_dir) -> DataFrame:
    """The whole analysis of the bank's report and response, one copy for each source."""
    sources = table(spark, sf_dir, "documents").select("source").distinct()

    def pages_of(rows) -> DataFrame:
        own = spark.createDataFrame(rows, "n int, text string")
        return sources.crossJoin(F.broadcast(own)).select("source", F.col("n").alias("page_number"), "text", F.lit(False).alias("ocr"))

    return analysis.analyse(pages_of(bank.REPORT), pages_of(bank.RESPONSE), save=store(spark))


@query
def whole_analysis(spark, sf_dir):
    return validate.flatten(analysed(spark, sf_dir)).select("document_pair", "id", "recommendation_text", "matched_response_text", "classification", "confidence", "debug_alignment_method")


# -- SQL functions, encoders, CSV sets ------------------------------------------------------------


@query
def sql_stance(spark, sf_dir):
    sql.register(spark)
    return replies(spark, sf_dir).selectExpr("doc_id", f"{sql.CLASSIFY}(matched_text) AS s").select("doc_id", "s.label", "s.confidence")


@query
def sql_passages(spark, sf_dir):
    sql.register(spark)
    rows = table(spark, sf_dir, "documents").selectExpr("source", "doc_id AS page_number", f"{sql.CHUNK}(text, 200, 30) AS cut").selectExpr("source", "page_number", "inline(cut)")
    return rows.select("source", "page_number", "ix", "n_words", digest("text").alias("text_md5"))


def vowel_encoder():
    """Stands in for a model: counts of the vowels."""
    return lambda texts: np.array([[t.count(v) for v in "aeiou"] for t in texts], "f8")


@query
def encoded_documents(spark, sf_dir):
    coded = search.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), vowel_encoder)
    return coded.select("doc_id", *[six(F.col("embedding")[k]).alias(v) for k, v in enumerate("aeiou")])


@query
def retriever_fallback(spark, sf_dir):
    """Neither table has vectors and no encoder is given, so the hybrid retriever that is asked for becomes the keyword one."""
    save = store(spark)
    found = search.retrieve(save(passages(spark, sf_dir), "passages"), questions(spark, sf_dir), "hybrid", 5, save=save)
    return found.select("query_id", "rank", "chunk_id", six("score").alias("score"), "retriever")


@query
def recommendations_csv(spark, sf_dir):
    path = f"{shared(spark)}/csv"
    io.write_csv(io.recommendations_csv(export_rows(spark, sf_dir)), path)
    return io.read_csv(spark, path)


@query
def predictions_csv(spark, sf_dir):
    path = f"{shared(spark)}/csv"
    flat = validate.flatten(export_rows(spark, sf_dir))
    truth = flat.where("id % 4 = 0").select("document_pair", "id", F.lit("partial").alias("true_label"))
    io.write_csv(io.predictions_csv(flat, truth), path)
    return io.read_csv(spark, path).withColumns({c: F.col(c).cast("double") for c in ("confidence", "alignment_confidence", "classification_confidence")})


@query
def results_csv(spark, sf_dir):
    path = f"{shared(spark)}/csv"
    found = found_passages(spark, sf_dir, 3).join(questions(spark, sf_dir).select("query_id", "query"), "query_id")
    io.write_csv(io.results_csv(search.enrich(found), "tfidf"), path)
    return io.read_csv(spark, path).withColumn("score", F.col("score").cast("double"))
