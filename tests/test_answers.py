from pyspark.sql import functions as F

from examlens.functions import answers

CASES = [
    ("", (None, None, "empty_response")),
    (" \n \t", (None, None, "empty_response")),
    ("Final answer: B", ("B", None, None)),
    ("reason\nfinal  answer – **x**\nFINAL ANSWER: c.", ("C", None, None)),
    ("Antwort：'d!'", ("D", None, None)),
    # quotes are removed before the closing punctuation, so this token stays unreadable
    ("Antwort：'d'!", ("D", None, "regex_fallback")),
    ("Final answer: E…", ("E", None, None)),
    ("Final answer: A\nFinal answer: Declined", ("DECLINED", None, "declined_explicit")),
    ("Final answer: I choose not to answer.", ("DECLINED", None, "declined_explicit")),
    # an unreadable final line falls through to the later steps
    ("Final answer: maybe B", ("B", None, "regex_fallback")),
    ('{"answer": "d", "reason": "r"}', ("D", "r", None)),
    ('{"answer": "d", "reason": 3}', ("D", None, None)),
    ('{"answer": 3}', (None, None, "no_parse")),
    ("{'answer': 'B'}", ("B", None, "regex_fallback")),
    ('so {"answer":"e"} it is', ("E", None, "json_extracted")),
    ('{"answer":"b"} trailing', ("B", None, "json_extracted")),
    ('x {"answer":"declined"}', ("DECLINED", None, "declined_explicit")),
    ("Ich entscheide mich, nicht zu antworten.", ("DECLINED", None, "declined_phrase")),
    ("Well, I decline. A would be wrong", ("DECLINED", None, "declined_phrase")),
    ("KEINE   Ahnung", ("DECLINED", None, "declined_phrase")),
    ("I declined it, option b)", ("B", None, "regex_fallback")),
    ("fée café", (None, None, "no_parse")),
    ("é x", ("E", None, "regex_fallback")),
    ("value_a and 3b", (None, None, "no_parse")),
]


def test_extraction(spark):
    frame = spark.createDataFrame(
        [(i, text) for i, (text, _) in enumerate(CASES)], "i int, text string"
    )
    got = {
        r.i: (r.predicted, r.rationale, r.warning)
        for r in frame.select("i", answers.extract_answer("text").alias("a"))
        .select("i", "a.*")
        .collect()
    }
    wrong = {CASES[i][0]: (got[i], want) for i, (_, want) in enumerate(CASES) if got[i] != want}
    assert not wrong


def test_null_text(spark):
    row = spark.range(1).select(
        answers.extract_answer(F.lit(None).cast("string")).alias("a")
    ).first()
    assert row.a.warning == "empty_response"


def test_whole_text_is_searched(spark):
    text = "word " * 200_000 + "\nFinal answer: D"
    row = spark.createDataFrame([(text,)], "text string").select(
        answers.extract_answer("text").alias("a")
    ).first()
    assert row.a.predicted == "D"
