"""Small text banks for queries and tests: sentences, labels and pages written for the rules they exercise."""

from __future__ import annotations

REPLIES = [
    "The department accepts this proposal.", "We agree in principle with the aim.", "We do not agree with the panel.", "The board rejects the idea outright.", "Officials will consider the matter in due course.",
    "The agency will publish new guidance next year.", "The ministry has already published its plan and is working with partners.", "We welcome the report but will consult on the details.", "No decisions have been taken; we will publish a paper.",
    "This recommendation is not for the UK government to respond to.", "The council partially accepted the text.", "The council acts in part to help.", "It will act, in part, this year.", "The point is noted.", "The point is noted and accepted.",
    "Recommendation accepted in principle.", "Recommendation accepted.", "The government accepts this recommendation.", "The government accepts this recommendation in principle.", "We agree that every local body should publish its accounts.",
    "We agree that all such bodies should be given time and plan to act.", "The service continues to review its work.", "Work is underway.", "The committee met twice in spring.", "", "They cannot support the measure and decline to act.",
    "The lead government department model must retain an essential role.", "We broadly support the aims.", "The office is committed to improving access.", "These options are being considered within broader plans.",
]
METHODS = ["exact_label", "structure", "semantic", "chunk_fallback", "sequence_correction"]
LEADS = ["", "Recommendation 6: ", "12. The Open Economy ", "GENERAL FINDINGS AND AIMS. ", "Rec 4 ", "recommendation 6 ", "12) Short "]
LABELS = ["12", "4a", "4a ii", "4a i", "8.32", "8.4", "", "(7)", "3.(b)", "10a v", " 5 . ", "xii", "IV", "Recommendation 3.", "2b", "2", "11."]
QUERIES = ["recommendation 12 on staff", 'the "open door" rule', "spending of 40 million", "cost", "who should pay for local housing repairs after a flood in winter", "funding local libraries today", "reform of rec 3", "growth in 2021"]
ERRORS = {
    "chunk_too_small": "Short passage.", "chunk_too_large": "Long passage.", "wrong_document": "Other document.", "wrong_doc_similar_topic": "Other document, like words.",
    "paraphrase_miss": "Right document, other words.", "ranking_issue": "Right passage below the first rank.",
}
PAGES = [
    ("contents", 3, "Contents\n" + "\n".join(f"Chapter {k}: Matters of note {k * 7}" for k in range(1, 9))),
    ("pairs", 4, "Contents\n" + "\n".join(f"Matters of note part {chr(96 + k)}\n{k * 7}" for k in range(1, 9))),
    ("title", 0, "Annual report of the panel\nVolume 2\nOrdered by the house"),
    ("title_late", 9, "Annual report of the panel\nVolume 2\nOrdered by the house"),
    ("foreword", 1, "Foreword\nThis report was written in haste"),
    ("licence", 2, "Crown copyright 2021. Printed in the UK by a firm. ISBN 978-1-5286-2222-3"),
    ("serial", 5, "E02712345 06/21\nISBN 978-1-5286-2222-3"),
    ("prose", 6, "The panel met in June. It heard from many people. They spoke of cost and of care."),
    ("appendix", 7, "Appendix 1: Terms Appendix 2: People Appendix 3: Visits Figure 1 and Box 2"),
]
REPORT = [
    (1, "Our work\nThe panel met in June and heard from many people about the service. It was a long year."),
    (2, "Recommendation 1: The government should publish a plan for local care. 4.2. This is a new paragraph. Recommendation 2a: The department must review its guidance for staff by spring."),
    (3, "Recommendations\n1. We recommend that the department should publish clear guidance on the use of data by every public body in the country.\n2. Remembering what happened to people\n(a) A memorial should be established by the government in the capital.\n(b) An annual event should be held at which the public can take part"),
    (4, "and where those who were harmed are heard. (c) Funds should be provided for travel.\n3. Ministers must consider how the board will report each year on progress in the field."),
    (5, "Chapter 5 Other matters\nIn the interim report we wrote Recommendation 9: this was said before."),
    (6, "Summary of the recommendations\n4. The government should ensure that each trust reviews its plans. 5. Snow fell in May. 6. We urge the committee to work with partners on a new scheme. 7. We welcome the recent shift to the support of small firms in the regions and hope"),
    (7, "The government should now work with the regions to deliver this support to firms. The sky is blue."),
    (8, "Conclusions and recommendations 1. We recommend that the government should fund a new centre for the study of floods. 2. The weather was mild in the year under study and rain was rare. 3. The Government should publish its plans for housing within a year of this report. 4. The Department should set out how it will help people who wait. Formal minutes"),
    (9, "113.1 Some background here. 113.2 We therefore recommend that all new homes be fitted with alarms. 113.3 This led us to recommend that nobody does so. 113.4 We also recommend that the fire service train its staff each year. 113.5 More text. 113.6 We recommend that the fire service train its staff each year. 113.7 End."),
]
RESPONSE = [
    (1, "Contents Recommendation 1: Care ........ 3 Recommendation 2: Data ........ 4\nIntroduction\nWe thank the panel for its work."),
    (2, "Recommendation 8.1 We recommend that the plan be published and kept under review by the board. The Government agrees with the panel and will publish the plan in the spring of next year after talks."),
    (3, "Recommendation 8.2 Recommendation 8.3 We urge ministers to act on staff numbers. 8.4. We invite the board to report. The Government accepts these points. As set out under recommendation 8.1 the plan covers them."),
    (4, "Recommendation 8.5 The service must publish its accounts each year in full. Recommendation accepted The service will do so from April. Chapter 3 Later matters and other things"),
]
ITEMS = [
    ("8.(a)", "alpha", "(a) fund the plan;", 0.78), ("8.(b)", "alpha", "(b) publish the plan.", 0.92), ("2", "numeric", "2. Remembering people", 0.78), ("2a", "alpha-nested", "(a) A memorial.", 0.92), ("2b", "alpha-nested", "(b) An event.", 0.86),
    ("4a i", "roman-nested", "i. One thing.", 0.92), ("4b i", "roman-nested", "i. First.", 0.78), ("4b ii", "roman-nested", "ii. Second.", 0.78), ("7", "numeric", "7. We recommend that the board act.", 0.92),
]
