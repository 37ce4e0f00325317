"""SQL functions, the encoder hook, the choice of a retriever and the CSV sets, by hand."""

import glob

import numpy as np
import pytest

from lectern.functions import sql
from lectern.operators import search
from lectern.sources import io
from lectern.sources.store import store


def local():
    """The encoder as a local function, which goes to the workers by value."""

    def make():
        return lambda texts: np.array([[len(t), t.count("a"), t.count("b")] for t in texts], "f8")

    return make


encoder = local()


def test_sql_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame([(1, "Officials disagreed."), (2, None), (3, " "), (4, "a  b c d e f g")], "k int, text string")
    got = spark.sql("SELECT k, classify_response(text).label AS label FROM {d}", d=rows).collect()
    assert {r.k: r.label for r in got} == {1: "rejected", 2: "not_addressed", 3: "not_addressed", 4: "not_addressed"}
    cut = spark.sql("SELECT k, inline(c) FROM (SELECT k, chunk_text(text, 3, 1) AS c FROM {d})", d=rows).collect()
    assert sorted((r.ix, r.text, r.n_words) for r in cut if r.k == 4) == [(0, "a b c", 3), (1, "c d e", 3), (2, "e f g", 3), (3, "g", 1)]
    assert {r.k for r in cut} == {1, 4}
    assert spark.sql("SELECT inline(c) FROM (SELECT chunk_text(text, 0, 0) AS c FROM {d})", d=rows).count() == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["ab", "", None, "bbbb", "xyz a"] * 40)], "k int, text string")
    got = {r.k: r.embedding for r in search.embed(rows, encoder, block=7).collect()}
    for k, t in enumerate(["ab", "", None, "bbbb", "xyz a"] * 40):
        v = encoder()([t or ""])[0]
        assert np.allclose(got[k], v / (np.linalg.norm(v) or 1))


@pytest.mark.parametrize(("asked", "make", "used"), [("semantic", encoder, "semantic"), ("hybrid", encoder, "hybrid"), ("semantic", None, "tfidf"), ("tfidf", encoder, "tfidf")])
def test_retrievers(spark, asked, make, used):
    chunks = spark.createDataFrame([(k, "s", t) for k, t in enumerate(["flood plans for towns", "new libraries open", "flood", "aaa bbb"])], "chunk_id long, source string, text string")
    queries = spark.createDataFrame([(1, "flood plans"), (2, "libraries"), (3, "  ")], "query_id int, query string")
    got = search.retrieve(chunks, queries, asked, 2, make, store(spark)).collect()
    assert {r.retriever for r in got} == {used} and {r.query_id for r in got} == {1, 2}
    if used == "tfidf":
        assert [r.chunk_id for r in sorted((x for x in got if x.query_id == 1), key=lambda x: x["rank"])] == [0, 2]
    if used == "semantic":
        best = max(range(4), key=lambda k: score(["flood plans for towns", "new libraries open", "flood", "aaa bbb"][k], "flood plans", ["flood", "plans"]))
        assert next(r.chunk_id for r in got if r.query_id == 1 and r["rank"] == 1) == best


def score(text: str, query: str, terms: list[str]) -> float:
    a, b = encoder()([text, query])
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) + 0.5 * np.mean([t in text for t in terms]) + 1.5 * (query in text)


def test_no_such_retriever(spark):
    with pytest.raises(ValueError):
        search.retriever_for("best", spark.range(1))


def test_csv_form(spark, tmp_path):
    rows = spark.createDataFrame([("p", "1", 'say "no", now', ["x", "y"], 0.5), ("p", "2", "two\nlines ", [], None)], "document_pair string, id string, recommendation_text string, confidence_factors array<string>, confidence double")
    io.write_csv(io.csv_columns(rows, ["id", "recommendation_text", "confidence_factors", "confidence", "page"], {"confidence": 3}).coalesce(1), f"file://{tmp_path}/c")
    raw = open(glob.glob(f"{tmp_path}/c/*.csv")[0], "rb").read()
    assert raw.startswith(b"id,recommendation_text,confidence_factors,confidence,page\r\n") and b'"say ""no"", now",x; y,0.500,\r\n' in raw
    back = {r.id: r for r in io.read_csv(spark, f"file://{tmp_path}/c").collect()}
    assert back["1"].recommendation_text == 'say "no", now' and back["2"].recommendation_text == "two\nlines " and back["2"].confidence == "0.000" and back["2"].page is None


def test_csv_sets(spark):
    flat = spark.createDataFrame([("p", "1", "partial", 0.4, "label"), ("p", "2", None, None, None)], "document_pair string, id string, classification string, confidence double, debug_alignment_method string")
    assert io.recommendations_csv(flat).columns == io.RECOMMENDATION_CSV and len(io.RECOMMENDATION_CSV) == 8
    assert [r.classification for r in io.recommendations_csv(flat).orderBy("id").collect()] == ["partial", "not_addressed"]
    assert io.predictions_csv(flat).columns == io.PREDICTION_CSV and len(io.PREDICTION_CSV) == 13 and len(io.RESULT_CSV) == 11
    truth = spark.createDataFrame([("p", "1", "accepted")], "document_pair string, id string, true_label string")
    got = {r.id: r for r in io.predictions_csv(flat, truth).collect()}
    assert got["1"].correct is False and got["2"].correct is None and got["1"].alignment_method == "label"
