"""Rows written by hand for the views and the whole analysis."""

import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import phrases
from lectern.functions import text as T
from lectern.operators import classify, views
from lectern.plans import analysis
from lectern.queries import QUERIES, recommendations, reply_units
from lectern.sources.store import store

PAGES = "source string, page_number int, text string, ocr boolean"
REPORTS = [
    ("p1", 1, "Recommendation 1: The government should publish a national plan for flood defences in every coastal town.", False),
    ("p1", 2, "Recommendation 2: The department must fund new libraries in rural areas within two years of this report.", False),
    ("p2", 1, "Conclusions and recommendations 1. We recommend that the government should fund a new centre for the study of floods. 2. The weather was mild in the year under study and rain was rare. 3. The Government should publish its plans for housing within a year of this report. 4. The Department should set out how it will help people who want to move.", False),
    ("p3", 1, "113.1 Some background here. 113.2 We therefore recommend that all new homes be fitted with alarms. 113.3 More text stands here. 113.4 We also recommend that the fire service train its staff each year. 113.5 More text. 113.6 End.", False),
]
REPLIES = [
    ("p1", 1, "Recommendation 1 The government should publish a national plan for flood defences in every coastal town. The Government accepts this recommendation and will publish the national plan for flood defences by the end of the coming year.", False),
    ("p1", 2, "Recommendation 2 The department must fund new libraries in rural areas. The Government rejects this recommendation. Libraries in rural areas are a matter for councils, which set their own budgets each year.", False),
    ("p2", 1, "Recommendation 1 A new centre for floods. The Government agrees in principle with a new centre for the study of floods in the years to come after talks.\nRecommendation 2 Plans for housing. The Government will consider its plans for housing in due course, as it said before the summer in the house.", False),
]


def test_whole_analysis(spark):
    got = analysis.analyse(spark.createDataFrame(REPORTS, PAGES), spark.createDataFrame(REPLIES, PAGES), committee=F.col("source") == "p2", prefix="113", save=store(spark)).collect()
    rows = {(r.document_pair, r.id): r for r in got}
    assert rows[("p1", "1")].classification == "accepted" and rows[("p1", "1")].debug.alignment_method == "exact_label"
    assert rows[("p1", "2")].classification == "rejected" and rows[("p1", "2")].matched_response_page == "2"
    assert [k for k in rows if k[0] == "p2"] and {k[1] for k in rows if k[0] == "p2"} == {"1", "2", "3"}  # the section's items alone, numbered anew
    assert rows[("p2", "1")].classification == "partial" and rows[("p2", "2")].classification == "partial"
    inline = [r for r in got if r.document_pair == "p3"]
    assert [r.classification for r in inline] == ["not_addressed"] * 2 and all(r.matched_response_text is None and r.confidence == 0 for r in inline)
    assert all(r.debug.classifier_method == "rule_based" for r in got)


def test_registered_analysis(spark, sf_dir):
    rows = QUERIES["whole_analysis"](spark, sf_dir)
    assert rows.groupBy("id", "recommendation_text").count().select("count").distinct().count() == 1  # each source has the same report
    assert {r.classification for r in rows.select("classification").distinct().collect()} <= {"accepted", "partial", "rejected", "not_addressed"}


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("The office agreed to carry out the plan.", "accepted"), ("The board is committed to improving its records.", "accepted"), ("Ministers have already published the code.", "accepted"), ("The agency will take forward this work.", "accepted"),
        ("Its rules have been amended.", "accepted"), ("Recommendations 1 to 4 are accepted in full.", "accepted"), ("The council has a duty to report.", "accepted"), ("The board is not able to accept this.", "partially_accepted"),
        ("The board does not consider it appropriate.", "rejected"), ("The trust refuses to pay.", "rejected"), ("Officials disagreed.", "rejected"), ("The council will not act.", "rejected"), ("The agency does not support it, but will explore other ways.", "partially_accepted"),
        ("The board recognises the need.", "partially_accepted"), ("The office supports this recommendation.", "partially_accepted"), ("The trust aims to act.", "partially_accepted"), ("The board is developing a code.", "partially_accepted"),
        ("Options are being considered, and the agency will publish them.", "partially_accepted"), ("The board agrees, and will give careful consideration to it.", "partially_accepted"), ("The board partially met it.", "partially_accepted"),
        ("The lead government department model is old. It will retain an essential role.", "not_addressed"), ("Nobody reviewed the preview.", "not_addressed"), ("An acceptance speech was given.", "not_addressed"), (None, "not_addressed"), ("  ", "not_addressed"),
    ],
)
def test_stances(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(classify.classify("t")["label"]).first()[0] == label


@pytest.mark.parametrize(
    ("line", "hits", "misses"),
    [
        ("will (set out|go)* [very] far", ["Will set  out far", "will going very far"], ["will far", "will sets out far", "will go farther"]),
        ("in part ! (to|of)", ["in part", "in part for"], ["in part to", "in part  of", "in partial"]),
        ("say <1-2> now", ["say it now", "say it all now"], ["say now", "say a b c now"]),
        ("a <10 chars> z", ["a b z", "a 1234567 z"], ["a b. z", "a 1234567890 z"]),
        ("we do,? act", ["we do act", "we do, act"], ["we do; act"]),
    ],
)
def test_phrase_notation(line, hits, misses):
    found = re.compile(phrases.pattern([line]))
    assert all(found.search(h) for h in hits) and not any(found.search(m) for m in misses)


def test_decomposition(spark):
    rows = spark.createDataFrame([("ﬁnal ½ café Ａ１ x² ž ệ Ω",)], "t string")
    assert rows.select(T.normalise("t")).first()[0] == "final 12 cafe a1 x2 z e ω"


def test_next_section(spark):
    rows = spark.createDataFrame([("Act now. 12: Further matters",), ("Act now 12: Further",), ("Act at 12: now. Then",), ("",)], "t string")
    assert [r[0] for r in rows.select(views.without_next_section("t")).collect()] == ["Act now.", "Act now 12: Further", "Act at 12: now. Then", ""]


def test_repeats_cut_by_hand(spark, sf_dir):
    rec = "the board should publish all of its accounts each spring"
    rows = [(rec, rec.upper() + "; We will do so from next year as the law asks us to.", "other"), (rec, rec + " Yes.", "We will."), (rec, "No words are shared here.", None), (rec, None, "We will.")]
    got = [r[0] for r in spark.createDataFrame(rows, "rec string, block string, response string").select(views.without_repeat("rec", "block", "response")).collect()]
    assert got == ["We will do so from next year as the law asks us to.", "We will.", "No words are shared here.", "We will."]
    r, u = recommendations(spark, sf_dir), reply_units(spark, sf_dir)
    texts = {(x.pair_id, x.rec_id): x.text for x in r.collect()}
    want = 0
    for x in u.collect():
        rec, block, response = texts.get((x.pair_id, x.unit_id)), x.full_unit_text, x.response_text
        want += rec is not None and bool(block or response)
    assert QUERIES["repeats_cut"](spark, sf_dir).count() == want


def test_cleanup_rules(spark):
    rows = spark.createDataFrame([("Big report", "30", "Do it. Tail words"), ("Big report", "31", "Do it. Tail words"), ("Other", "30", "Do it. Tail words")], "source string, item_label string, text string")
    rules = spark.createDataFrame([("Big", " 30 ", r"\s+tail words\s*$", "")], "source_pattern string, label string, pattern string, replacement string")
    assert sorted(r.text for r in views.apply_rules(rows, rules).collect()) == ["Do it.", "Do it. Tail words", "Do it. Tail words"]


def test_fuller_body(spark):
    start = "We recommend that the Government (a) publish its plan for all towns each year, (b) review it, and "
    pages = spark.createDataFrame([("s", 1, "Early words. " + start + "(c) set out details of costs. Next."), ("s", 2, "Summary. " + start + "(c) details of costs. End here.")], "source string, page_number int, text string")
    rows = spark.createDataFrame([("s", 0, "8.33 " + start + "(c) details of costs."), ("s", 1, "We recommend that nothing be done.")], "source string, rec_id int, text string")
    got = {r.rec_id: r.text for r in views.fuller_body(rows, pages).collect()}
    assert got[0] == start + "(c) set out details of costs." and got[1] == "We recommend that nothing be done."
