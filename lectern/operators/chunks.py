"""Cutting pages into overlapping word windows, and repairing the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def window_chunks(pages: DataFrame, size: int = 400, overlap: int = 50, min_words: int = 0, source: str = "source", page: str = "page_number", text: str = "text") -> DataFrame:
    """Rows ``(source, page_number, ix, text, n_words)``: windows of ``size`` words that start every ``size - overlap``.

    A last window of fewer than ``min_words`` words is appended to the one before it, overlap included.  Steps below
    ``min_words`` may leave several short windows; then use ``merge_short``.
    """
    if size < 1 or overlap < 0:
        raise ValueError("size must be positive and overlap not negative")
    step = max(1, size - overlap)
    rows = pages.select(F.col(source).alias("source"), F.col(page).alias("page_number"), F.col(text).alias("text"))
    rows = T.held(rows, "w", T.words(T.clean(F.coalesce("text", F.lit(""))))).where(F.size("w") > 0)
    if min_words and step < min_words:
        return merge_short(window_chunks(pages, size, overlap, 0, source, page, text), min_words)
    n = F.size("w")
    last = F.floor((n - 1) / step).cast("int")  # number of the last window
    tail = n - last * step
    merged = F.lit(False) if not min_words else (tail < min_words) & (last > 0)
    count = F.when(merged, last).otherwise(last + 1)
    rows = rows.select("source", "page_number", "w", last.alias("last"), merged.alias("merged"), F.explode(F.sequence(F.lit(0), count - 1)).alias("ix"))
    own = F.slice("w", F.col("ix") * step + 1, F.lit(size))
    after = F.slice("w", F.col("last") * step + 1, F.lit(size))
    cut = F.when(F.col("merged") & (F.col("ix") == F.col("last") - 1), F.concat(own, after)).otherwise(own)
    return T.held(rows, "cut", cut).select("source", "page_number", "ix", F.array_join("cut", " ").alias("text"), F.size("cut").alias("n_words"))


def merge_short(chunks: DataFrame, min_words: int) -> DataFrame:
    """One pass over each page's windows: a short one goes to the next window, which is then complete, or to the one before."""
    per_page = chunks.groupBy("source", "page_number").agg(F.sort_array(F.collect_list(F.struct("ix", "text", "n_words"))).alias("c"))
    kind = "array<struct<text:string,n:int>>"
    start = F.struct(F.array().cast(kind).alias("out"), F.lit(False).alias("used"))

    def fold(acc, i):
        cur, nxt = F.col("c")[i], F.try_element_at("c", i + 2)
        item = F.struct(cur["text"].alias("text"), cur["n_words"].alias("n"))
        forward = F.struct(F.concat_ws(" ", cur["text"], nxt["text"]).alias("text"), (cur["n_words"] + nxt["n_words"]).alias("n"))
        prev = F.element_at(acc["out"], -1)
        back = F.struct(F.concat_ws(" ", prev["text"], cur["text"]).alias("text"), (prev["n"] + cur["n_words"]).alias("n"))
        short = cur["n_words"] < min_words
        return (
            F.when(acc["used"], F.struct(acc["out"].alias("out"), F.lit(False).alias("used")))
            .when(short & nxt.isNotNull(), F.struct(F.concat(acc["out"], F.array(forward)).cast(kind).alias("out"), F.lit(True).alias("used")))
            .when(short & (F.size(acc["out"]) > 0), F.struct(F.concat(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.array(back)).cast(kind).alias("out"), F.lit(False).alias("used")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(item)).cast(kind).alias("out"), F.lit(False).alias("used")))
        )

    folded = per_page.select("source", "page_number", F.aggregate(F.sequence(F.lit(0), F.size("c") - 1), start, fold)["out"].alias("out"))
    return folded.select("source", "page_number", F.posexplode("out").alias("ix", "m")).select("source", "page_number", "ix", F.col("m.text").alias("text"), F.col("m.n").alias("n_words"))


def numbered(chunks: DataFrame) -> DataFrame:
    """Adds ``chunk_id``, which restarts with each source."""
    order = Window.partitionBy("source").orderBy("page_number", "ix")
    return chunks.withColumn("chunk_id", F.row_number().over(order) - 1)


def distinct_chunks(chunks: DataFrame, *order: str) -> DataFrame:
    """The first row, in the given order, of each normalised text; texts that normalise to nothing all stay."""
    norm, sign, rn = "__norm", "__sign", "__rn"
    rows = T.held(chunks, norm, F.trim(T.normalise("text"))).withColumn(sign, F.when(F.col(norm) != "", F.sha2(norm, 256))).drop(norm)
    keep = F.row_number().over(Window.partitionBy(sign).orderBy(*order))
    first = rows.where(F.col(sign).isNotNull()).withColumn(rn, keep).where(F.col(rn) == 1).drop(rn)
    return first.unionByName(rows.where(F.col(sign).isNull())).drop(sign)


def with_context(chunks: DataFrame, window: int = 1, chars: int = 300) -> DataFrame:
    """The end of the text ``window`` chunks before and the start of the one ``window`` after, within the source."""
    order = Window.partitionBy("source").orderBy("chunk_id")
    return chunks.withColumn("context_before", F.right(F.lag("text", window).over(order), F.lit(chars))).withColumn("context_after", F.left(F.lead("text", window).over(order), F.lit(chars)))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks, and 12 hex digits over source, id and length of the first, middle and last."""
    part = F.concat_ws("#", "source", F.col("chunk_id").cast("string"), F.length("text").cast("string"))
    rows = chunks.select("source", "chunk_id", part.alias("part"))
    per = rows.groupBy("source").agg(F.count("*").alias("n"))
    # one row a source: the only thing that meets in one task; chunk ids count up from 0 in each
    before = F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.withColumn("start", before).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    placed = rows.join(F.broadcast(starts), "source").withColumn("rn", F.col("start") + F.col("chunk_id"))
    picked = placed.agg(
        F.max("total").alias("n"),
        F.max(F.when(F.col("rn") == 0, F.col("part"))).alias("a"),
        F.max(F.when(F.col("rn") == F.floor(F.col("total") / 2), F.col("part"))).alias("b"),
        F.max(F.when(F.col("rn") == F.col("total") - 1, F.col("part"))).alias("c"),
    )
    sign = F.concat_ws("::", F.col("n").cast("string"), F.substring(F.sha1(F.concat_ws("|", F.col("n").cast("string"), "a", "b", "c").cast("binary")), 1, 12))
    return picked.select(F.when(F.col("n").isNull(), "0::empty").otherwise(sign).alias("fingerprint"))
