"""The engine's functions under SQL names: a stance function and one that cuts passages."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lectern.functions import text as T
from lectern.operators import classify

CLASSIFY, CHUNK = "classify_response", "chunk_text"


def register(spark: SparkSession) -> None:
    """``classify_response(text)`` gives ``struct(label, confidence)``; ``chunk_text(text, size, overlap)`` an array of ``struct(ix, text, n_words)``
    for ``inline`` in the query around.

    Both are SQL functions whose bodies are the expressions of the DataFrame operators, so they are part of the plan and run without
    Python.  The second gives an array, since Spark plans a table function in SQL as a join of the texts with themselves.  A null or blank text is
    not addressed, and has no passages; a size below 1 gives none either.
    """
    one = spark.createDataFrame([], "text string")

    def body(column) -> str:
        """The expression as SQL text; functions of array elements have none."""
        return one.select(column)._jdf.queryExecution().analyzed().expressions().head().child().sql()

    stance, cleaned = body(classify.classify("text").alias("c")), body(T.clean("text").alias("c"))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {CLASSIFY}(text STRING) RETURNS STRUCT<label: STRING, confidence: DOUBLE> RETURN {stance}")
    step, rows = "greatest(1, size - overlap)", "ARRAY<STRUCT<ix: INT, text: STRING, n_words: INT>>"
    words = f"filter(split({cleaned}, ' '), w -> length(w) > 0)"
    cut = f"slice(w, ix * {step} + 1, size)"
    each = f"transform(sequence(0, CAST((size(w) - 1) DIV {step} AS INT)), ix -> named_struct('ix', ix, 'text', array_join({cut}, ' '), 'n_words', size({cut})))"
    passages = f"transform(array({words}), w -> CASE WHEN size(w) > 0 AND size > 0 THEN {each} END)[0]"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {CHUNK}(text STRING, size INT, overlap INT) RETURNS {rows} RETURN {passages}")
