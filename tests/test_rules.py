"""Hand-built cases for the rules that SQL can't check."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, chunks, classify, evaluate, extract, pages, units


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("We accept this.", "accepted"), ("The board accepts in principle that plans change.", "partially_accepted"), ("The board accepts the plan.", "accepted"), ("We agree in part.", "partially_accepted"), ("The council rejects this.", "rejected"),
        ("The office does not agree but will review the case.", "partially_accepted"), ("We will publish a plan.", "accepted"), ("No decisions have been taken, though we will publish a plan.", "partially_accepted"),
        ("This recommendation is not for the UK government to respond to.", "not_addressed"), ("The weather was fine.", "not_addressed"), ("", "not_addressed"), ("The point is noted and accepted.", "accepted"), ("The point is noted.", "partially_accepted"),
    ],
)
def test_stance(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(classify.classify("t")["label"]).first()[0] == label


def test_list_scan():
    state = extract.ListState()
    items = extract.list_items("1. We recommend that the board should publish (a) its plan and (b) its costs. 2. Remembering people (a) A memorial should stand. (b) An event should be held. 3. Care i. One step. ii. Two steps.", state)
    assert [(i.label, i.level) for i in items] == [("1.", "numeric"), ("2a", "alpha-nested"), ("2b", "alpha-nested"), ("3.(i)", "roman"), ("3.(ii)", "roman")]
    more = extract.list_items("and on. iii. Three steps. 4. Ministers must act now.", state)
    assert [(i.label, i.level) for i in more] == [("3.(iii)", "roman"), ("4.", "numeric")]


def test_modal_sentences():
    assert extract.is_modal("The government should publish a plan.")
    assert extract.is_modal("We recommend action.")
    assert not extract.is_modal("Snow should fall in May.")
    assert extract.is_reference("The government agrees with this recommendation.")
    assert not extract.is_reference("We recommend that this recommendation be kept.")


def test_units_grouped_and_repeated():
    text = (
        "Recommendation 8.1 We recommend a plan for all. The Government agrees with this and will publish a plan soon enough for all who asked for it to be seen.\n"
        "Recommendation 8.2 Recommendation 8.3 We urge ministers to act. 8.4. We invite more. The Government accepts these points, as under recommendation 8.1 before.\n"
        "Recommendation 8.3 We urge ministers again to act on this matter in the coming year without delay. The Government will do so. Chapter 4 Other things"
    )
    got = units.segment(text)
    assert [u["recommendation_label"] for u in got] == ["8.1", "8.3", "8.4"]  # a bare 8.2 is a citation; the second 8.3 stands for 8.4
    assert got[1]["recommendation_labels"] == ["8.3", "8.4"] and got[2]["boundary_reason"] == "sequence_correction"
    assert got[0]["response_text"].startswith("The Government agrees")
    assert "Chapter" not in got[2]["response_text"]


def test_units_integer_labels_skip_contents():
    text = "Recommendation 1: Care ........ 3 Recommendation 2: Data ........ 4\nRecommendation 1: A plan is needed. The government accepts this. It goes with Recommendation 2, as said. Recommendation 2: Data must be kept. The government rejects this."
    assert [u["recommendation_label"] for u in units.segment(text)] == ["1", "2"]


def test_simple_blocks():
    got = units.simple_blocks("Recommendation: Build more. Response: We will. Recommendation: Plant trees. Response: We have.")
    assert [(u["recommendation_label"], u["response_text"]) for u in got] == [("1", "We will."), ("2", "We have.")]


def test_sequence_match(spark):
    recs = spark.createDataFrame([("p", 0, "1", "alpha beta gamma"), ("p", 1, "", "zzz yyy xxx")], "pair_id string, rec_id int, item_label string, text string")
    u = spark.createDataFrame([("p", 0, ["1"], None, "reply one here", "", "next_heading", 0.95), ("p", 1, ["9"], None, "reply two there", "", "bare_label_at_boundary", 0.95)], "pair_id string, unit_id int, recommendation_labels array<string>, quoted_recommendation_text string, response_text string, full_unit_text string, boundary_reason string, extraction_confidence double")
    got = {(r.rec_id, r.unit_id, r.match_method, r.score) for r in align.match_units(recs, u).where("primary").collect()}
    assert got == {(0, 0, "exact_label", 0.95), (1, 1, "sequence_correction", 0.5)}


def test_chunks_cover_all_words(spark):
    n = 137
    p = spark.createDataFrame([("s", 1, " ".join(f"w{k}" for k in range(n))), ("s", 2, ""), ("s", 3, None)], "source string, page_number int, text string")
    got = chunks.window_chunks(p, 20, 5).orderBy("ix").collect()
    assert {w for r in got for w in r.text.split()} == {f"w{k}" for k in range(n)}
    assert [r.text.split()[0] for r in got] == [f"w{k}" for k in range(0, n, 15)]


def test_page_flags(spark):
    from lectern import bank

    rows = spark.createDataFrame(bank.PAGES, "id string, ix int, text string")
    got = {r.id: (r.c, r.t, r.m, r.s) for r in rows.select("id", pages.is_contents_page("text", "ix").alias("c"), pages.is_title_page("text", "ix").alias("t"), pages.is_metadata_page("text").alias("m"), pages.is_serial_page("text").alias("s")).collect()}
    assert got["contents"][0] and got["pairs"][0] and got["appendix"][0] and got["title"][1] and got["licence"][2] and got["serial"][3]
    assert not any(got["prose"]) and not got["title_late"][1] and not got["foreword"][1]


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "truth string, prediction string")
    assert {r.n for r in evaluate.confusion(none).collect()} == {0}


def test_label_order(spark):
    rows = spark.createDataFrame([(x,) for x in ["10", "", "4a ii", "4a i", "4", "8.32", "8.4"]], "x string")
    assert [r.x for r in rows.orderBy(T.label_sort_key("x")).collect()] == ["4", "4a i", "4a ii", "8.4", "8.32", "10", ""]


def test_streaming_counts(spark, tmp_path):
    from lectern.streaming import log

    rows = spark.createDataFrame([(f"2024-01-01 00:0{k}:00", "a") for k in range(6)], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type")
    rows.write.parquet(str(tmp_path / "in"))
    stream = log.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.n for r in spark.table("counts").collect()) == [1, 5]


def test_pieces_keep_their_digits(spark):
    """A piece that starts or ends with the digits of its own place stays whole."""
    rows = spark.createDataFrame([("One. 1 two 1. 22 is it 2", "0 a 0\n 1 b 1\n12 c 2")], "s string, l string")
    got = rows.select(T.sentences("s").alias("s"), T.first_sentence("l").alias("first"), T.last_sentence("s").alias("last"), T.lines("l").alias("l")).first()
    assert got.s == ["One.", "1 two 1.", "22 is it 2"] and got.last == "22 is it 2"
    assert got.first == "0 a 0\n 1 b 1\n12 c 2" and got.l == ["0 a 0", "1 b 1", "12 c 2"]


def test_densest_window(spark):
    """The window of most hits, the earliest at ties, without a shuffle."""
    texts = ["", None, "the", "a b c", "a the b THE c", "x the x x the the x", "the x\n the the  x x the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = pages.densest_window(rows, "k", "t", ["the"], 3)
    assert {r.k: r.start for r in got.collect()} == {2: 0, 3: 0, 4: 1, 5: 3, 6: 0}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_section_over_page_ends(spark):
    """Headings and item numbers cut by page ends count, also with empty pages between; an item of any length costs no more than the limit."""
    pages = ["Old conclusions and recommendations 1. The Government should not find this here at all now. Conclusions", "and", "", "recommendations 1. We recommend that the office", "publishes a plan this year. 2.", "",
             "The Department should fund it in full next year. 3. The Government should " + "go on " * 400, "and on " * 300 + "4.", "Ministers said that the government should act at once (5.1 refers). List", "of witnesses 9. The Government should not find this here either."]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate([*pages, None])] + [("few", 1, "Conclusions and recommendations 1. The Government should act on this at once. 2. More")], "source string, page_number int, text string")
    got = sorted((r.source, r.rec_id, r.paragraph, r.text) for r in extract.numbered_sections(rows).collect())
    assert got == [("s", 0, 1, "We recommend that the office publishes a plan this year."), ("s", 1, 2, "The Department should fund it in full next year."), ("s", 2, 4, "Ministers said that the government should act at once (5.1 refers).")]
    assert "ObjectHashAggregate" not in extract.unbroken(rows, r"\bx")._jdf.queryExecution().executedPlan().toString()  # no report as one string
