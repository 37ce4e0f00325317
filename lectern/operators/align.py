"""Recommendations to responses: label, structure, similarity, ordinal and sequence matches.

Recommendations have ``(pair_id, rec_id, item_label, text)``, units ``(pair_id, unit_id, recommendation_labels, quoted_recommendation_text,
response_text, full_unit_text, boundary_reason, extraction_confidence)``.  All pairs go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.sources.store import Save, planned


def pair_similarity(left: DataFrame, right: DataFrame, pad: int = 0, save: Save = planned) -> DataFrame:
    """Rows ``(pair_id, l, r, score)`` of positive TF-IDF cosines between ``(pair_id, l, text)`` and ``(pair_id, r, text)``.

    The space is fitted per pair on both sides' texts that are not empty, plus ``pad`` texts with a term of their own.
    """
    sides = left.select("pair_id", F.lit("l").alias("side"), F.col("l").cast("long").alias("id"), T.normalise("text").alias("t")).unionByName(right.select("pair_id", F.lit("r").alias("side"), F.col("r").cast("long").alias("id"), T.normalise("text").alias("t")))
    n = sides.where("side = 'l' or t <> ''").groupBy("pair_id").agg((F.count("*") + pad).alias("n"))
    toks = T.held(sides, "toks", T.tokens("t"))
    tf = save(toks.select("pair_id", "side", "id", F.explode(T.grams(F.col("toks"))).alias("term")).groupBy("pair_id", "side", "id", "term").agg(F.count("*").alias("tf")), "tf")
    df = tf.groupBy("pair_id", "term").agg(F.count("*").alias("df"))
    w = tf.join(df, ["pair_id", "term"]).join(n, "pair_id").select("pair_id", "side", "id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norms = w.groupBy("pair_id", "side", "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = w.join(norms, ["pair_id", "side", "id"]).select("pair_id", "side", "id", "term", (F.col("w") / F.col("norm")).alias("w"))
    a = unit.where("side = 'l'").select("pair_id", "term", F.col("id").alias("l"), F.col("w").alias("lw"))
    b = unit.where("side = 'r'").select("pair_id", "term", F.col("id").alias("r"), F.col("w").alias("rw"))
    return save(a.join(b, ["pair_id", "term"]).groupBy("pair_id", "l", "r").agg(F.sum(F.col("lw") * F.col("rw")).alias("score")), "similarity")


def best_first(scores: DataFrame, k: int, threshold: float) -> DataFrame:
    order = Window.partitionBy("pair_id", "l").orderBy(F.round("score", 9).desc(), "r")
    return scores.where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def match_chunks(recs: DataFrame, chunks: DataFrame, k: int = 3, threshold: float = 0.05) -> DataFrame:
    """The most similar passages of each recommendation, trimmed at the next recommendation heading."""
    scores = pair_similarity(recs.select("pair_id", F.col("rec_id").alias("l"), "text"), chunks.select("pair_id", F.col("chunk_id").alias("r"), "text"))
    best = best_first(scores, k, threshold).withColumnRenamed("l", "rec_id").withColumnRenamed("r", "chunk_id")
    trimmed = trim_at_heading("text")
    out = best.join(chunks.select("pair_id", "chunk_id", "text"), ["pair_id", "chunk_id"])
    return out.select("pair_id", "rec_id", "chunk_id", "rank", "score", trimmed.alias("matched_text"), F.when(trimmed != F.col("text"), "chunk_boundary_trim").alias("boundary_reason"), F.lit("chunk_fallback").alias("match_method"))


def trim_at_heading(text: str) -> Column:
    """The text before the first ``Recommendation N`` heading past 60 characters that follows an end mark or line break."""
    cut = F.regexp_extract(F.substring(text, 61, 1 << 30), r"(?is)^(.*?[.!?\n]\s*)\b(?:recommendation|conclusion|finding)\s+\d+(?:\.\d+)*[a-z]?\b", 1)
    return F.when(cut != "", F.rtrim(F.concat(F.substring(text, 1, 60), cut))).otherwise(F.col(text))


def label_index(units: DataFrame) -> DataFrame:
    """``(pair_id, label, unit_id)``: the first unit that claims a label has it."""
    rows = units.select("pair_id", "unit_id", F.posexplode("recommendation_labels").alias("at", "raw")).select("pair_id", "unit_id", "at", T.label("raw").alias("label"))
    order = Window.partitionBy("pair_id", "label").orderBy("unit_id", "at")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1 and label <> ''").select("pair_id", "label", "unit_id")


def match_units(recs: DataFrame, units: DataFrame, k: int = 3, threshold: float = 0.05, label_score: float = 0.95, floor: float = 0.18, grouped_pairs: list | None = None, save: Save = planned) -> DataFrame:
    """Rows ``(pair_id, rec_id, unit_id, match_method, score, primary)``.

    Primary match: the label, its last word, the most similar quoted recommendation (``floor``), the most similar response
    (``threshold``), and for the last three recommendations the sequence.  Then up to ``k - 1`` alternatives by response similarity.
    """
    recs, units = save(recs, "recs"), save(units, "units")
    index = label_index(units)
    keyed = recs.withColumn("label", T.label(F.coalesce("item_label", F.lit("")))).withColumn("tail", F.element_at(F.split("label", r"\s+"), -1))
    full = index.select("pair_id", "label", F.col("unit_id").alias("by_label"))
    short = index.select("pair_id", F.col("label").alias("tail"), F.col("unit_id").alias("by_tail"))
    left = recs.select("pair_id", F.col("rec_id").alias("l"), "text")
    response = pair_similarity(left, units.select("pair_id", F.col("unit_id").alias("r"), F.coalesce("response_text", "full_unit_text", F.lit("")).alias("text")), pad=1, save=save)
    structure = pair_similarity(left, units.select("pair_id", F.col("unit_id").alias("r"), F.coalesce("quoted_recommendation_text", F.lit("")).alias("text")), pad=1, save=save)
    by_structure = best_first(structure, 1, floor).select("pair_id", F.col("l").alias("rec_id"), F.col("r").alias("by_structure"), F.col("score").alias("structure_score"))
    by_response = best_first(response, 1, threshold).select("pair_id", F.col("l").alias("rec_id"), F.col("r").alias("by_response"), F.col("score").alias("response_score"))
    on = ["pair_id", "rec_id"]
    j = keyed.join(full, ["pair_id", "label"], "left").join(short, ["pair_id", "tail"], "left").join(by_structure, on, "left").join(by_response, on, "left")
    named = F.coalesce("by_label", "by_tail")
    reasons = units.select("pair_id", F.col("unit_id").alias("named"), "boundary_reason", "extraction_confidence")
    grouped = F.col("pair_id").isin(grouped_pairs) if grouped_pairs else F.lit(False)
    j = j.withColumn("named", named).join(reasons, ["pair_id", "named"], "left")
    method = (
        F.when(F.col("named").isNotNull() & grouped, F.when(F.col("boundary_reason") == "structured_grouped", "structured_grouped").otherwise("structured_section"))
        .when(F.col("named").isNotNull(), "exact_label").when(F.col("by_structure").isNotNull(), "structure").when(F.col("by_response").isNotNull(), "semantic")
    )
    score = F.when(F.col("named").isNotNull() & grouped, F.greatest(F.lit(0.82), F.coalesce("extraction_confidence", F.lit(0.82)))).when(F.col("named").isNotNull(), F.lit(label_score)).otherwise(F.coalesce("structure_score", "response_score"))
    tiers = save(j.select("pair_id", "rec_id", F.coalesce("named", "by_structure", "by_response").alias("unit_id"), method.alias("match_method"), score.alias("score")), "tiers")
    primary = tiers.where("unit_id is not null")
    others = best_first(response.join(primary.select("pair_id", F.col("rec_id").alias("l"), F.col("unit_id").alias("own")), ["pair_id", "l"]).where("r <> own"), max(0, k - 1), threshold)
    others = others.select("pair_id", F.col("l").alias("rec_id"), F.col("r").alias("unit_id"), F.lit("semantic").alias("match_method"), "score")
    known = save(primary.withColumn("primary", F.lit(True)).unionByName(others.withColumn("primary", F.lit(False))), "known")
    return known.unionByName(sequence_matches(recs, units, tiers, known))


def sequence_matches(recs: DataFrame, units: DataFrame, tiers: DataFrame, known: DataFrame) -> DataFrame:
    """Unmatched ones among a pair's last three recommendations get the last unit at a bare label, else the last unit, that no
    label, structure or similarity match of an earlier recommendation took."""
    back = Window.partitionBy("pair_id").orderBy(F.desc("rec_id"))
    late = tiers.withColumn("from_end", F.row_number().over(back)).where("from_end <= 3 and unit_id is null").select("pair_id", "rec_id")
    taken = known.where(F.col("match_method").isin("exact_label", "structure", "semantic")).groupBy("pair_id", "unit_id").agg(F.min("rec_id").alias("since"))
    free = late.join(units.select("pair_id", "unit_id", "boundary_reason"), "pair_id").join(taken, ["pair_id", "unit_id"], "left").where("since is null or since > rec_id")
    bare = (F.coalesce("boundary_reason", F.lit("")) == "bare_label_at_boundary").cast("int")
    best = free.groupBy("pair_id", "rec_id").agg(F.max(F.struct(bare.alias("bare"), "unit_id")).alias("m"))
    return best.select("pair_id", "rec_id", "m.unit_id", F.lit("sequence_correction").alias("match_method"), F.when(F.col("m.bare") == 1, 0.5).otherwise(0.3).alias("score"), F.lit(True).alias("primary"))


def prefix_match(rec: str, block: str) -> Column:
    """``struct(ratio, matched)``: how many leading alphanumeric tokens of the recommendation the block repeats."""
    a, b = T.alnum_tokens(rec), T.alnum_tokens(block)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, False)
    n = F.least(F.size(a), F.size(b))
    matched = F.when(miss == 0, n).otherwise(F.least(n, (miss - 1).cast("int"))).cast("int")
    return F.struct(F.when(F.size(a) == 0, 0.0).otherwise(matched / F.size(a)).alias("ratio"), matched.alias("matched"))


def match_ordinal(recs: DataFrame, units: DataFrame, threshold: float = 0.05, save: Save = planned) -> DataFrame:
    """The unit with the recommendation's ordinal if it repeats its start, else the most similar unit that quotes or repeats it."""
    order = Window.partitionBy("pair_id")
    r = recs.withColumn("ix", F.row_number().over(order.orderBy("rec_id"))).withColumnRenamed("text", "rec_text")
    u = units.withColumn("ix", F.row_number().over(order.orderBy("unit_id"))).withColumn("block", F.coalesce("full_unit_text", "response_text", F.lit(""))).withColumn("quote", F.coalesce("quoted_recommendation_text", F.lit("")))
    sim = pair_similarity(recs.select("pair_id", F.col("rec_id").alias("l"), "text"), u.select("pair_id", F.col("unit_id").alias("r"), F.when(F.col("quote") != "", F.col("quote")).otherwise(F.col("block")).alias("text")), pad=1, save=save)
    sim = sim.select("pair_id", F.col("l").alias("rec_id"), F.col("r").alias("unit_id"), "score")
    cols = ["pair_id", "rec_id", "rec_text", "unit_id", "block", "quote"]

    def judged(df: DataFrame) -> DataFrame:
        return df.withColumn("p", prefix_match("rec_text", "block")).withColumn("repeats", (F.col("p.ratio") >= 0.5) & (F.col("p.matched") >= 8)).withColumn("quotes", T.containment("rec_text", "quote") >= 0.5)

    same = judged(r.join(u.drop("label"), ["pair_id", "ix"]).select(*cols)).where("repeats").join(sim, ["pair_id", "rec_id", "unit_id"], "left")
    first = same.select("pair_id", "rec_id", "unit_id", F.greatest("p.ratio", F.coalesce("score", F.lit(0.0))).alias("score"), F.when(F.col("quotes"), "structure").otherwise("structured_ordinal").alias("match_method"))
    top = sim.withColumn("rn", F.row_number().over(Window.partitionBy("pair_id", "rec_id").orderBy(F.round("score", 9).desc(), "unit_id"))).where(f"rn = 1 and score >= {threshold}").drop("rn")
    rest = r.join(first.select("pair_id", "rec_id"), ["pair_id", "rec_id"], "left_anti").join(top, ["pair_id", "rec_id"]).join(u.select("pair_id", "unit_id", "block", "quote"), ["pair_id", "unit_id"])
    second = judged(rest.select(*cols, "score")).where("quotes or repeats").select("pair_id", "rec_id", "unit_id", "score", F.when(F.col("quotes"), "structure").otherwise("structured_ordinal").alias("match_method"))
    return first.unionByName(second).withColumn("score", F.least("score", F.lit(0.95)))


def best_match(recs: DataFrame, matches: DataFrame) -> DataFrame:
    """Each recommendation with its most similar match, the earlier row at ties, or nulls."""
    order = Window.partitionBy("pair_id", "rec_id").orderBy(F.round("score", 9).desc(), F.desc("primary"), "unit_id")
    return recs.join(matches.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn"), ["pair_id", "rec_id"], "left")


def status(method: Column, shared: Column, similarity: Column) -> Column:
    return F.when(method == "exact_label", "exact").when(shared, "shared").when((method == "structure") | (similarity >= 0.35), "matched").when(similarity > 0, "weak").otherwise("none")


def shared_units(matches: DataFrame) -> DataFrame:
    """Units that more than one recommendation has as its match."""
    return matches.where("primary").groupBy("pair_id", "unit_id").agg(F.count_distinct("rec_id").alias("n_recs")).where("n_recs > 1")
