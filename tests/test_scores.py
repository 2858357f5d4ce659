import pytest
from pyspark.sql import functions as F

from pathloom.functions import score, text
from pathloom.model import ValidationConfig
from pathloom.operators import dataset, synth

W = "word "


@pytest.mark.parametrize(
    ("question", "answer", "expected", "valid", "reason"),
    [
        ("What is a long answer?", W * 38 + "end. Done.", 1.0, True, None),
        ("How it is done well", W * 34 + "end.", 0.9, True, None),
        ("Explain this at length?", W * 501 + "end.", 0.95, True, None),
        ("Is fifteen words fine?", "longer " * 14 + "end.", 0.4 * 15 / 20 + 0.3 + 0.3, True, None),
        ("Are nine words enough?", "considerable " * 8 + "end.", 0.6, False, "low_score"),
        ("Explain the thing", W * 20 + "end.", 0.7, True, None),
        ("Are ten words fine here?", "longish " * 10, 0.4 * 0.5 + 0.3 + 0.2, True, None),
        ("What is Python?", "A programming language.", 0.4, False, "low_score"),
        ("Island life is good", W * 20 + "end.", 0.9, True, None),
        ("123456789", W * 30, 0.0, False, "short_question"),
        ("A good question?", "Yes.", 0.0, False, "generic_answer"),
        ("A good question?", "I don't know!?", 0.0, False, "generic_answer"),
        ("A good question?", "..Maybe ", 0.0, False, "generic_answer"),
        (None, "x", 0.0, False, "missing"),
        ("A good question?", None, 0.0, False, "missing"),
        ("A good question?", " 　\n", 0.0, False, "empty"),
    ],
)
def test_scores(spark, question, answer, expected, valid, reason):
    df = spark.createDataFrame([(question, answer)], "question string, answer string")
    r = score.with_scores(df, F.col("question"), F.col("answer")).first()
    assert (r.quality_score, r.is_valid, r.reject_reason) == (pytest.approx(expected, abs=1e-12), valid, reason)


def test_word_count_follows_unicode_white_space(spark):
    rows = [("  a b\tc\n ", 3), ("", 0), (" a　b ", 2)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert df.filter(text.word_count(text.strip(F.col("t"))) != F.col("n")).count() == 0


@pytest.mark.parametrize(
    ("raw", "answer", "reason"),
    [
        ('```json\n{"question": "Why is it so here?", "answer": "Because."}\n```', "Because.", "low_score"),
        ('```\n{"question": "Why is it so here?", "answer": "Because."}\n```', "Because.", "low_score"),
        ('{"question": "Why is it so here?", "answer": "Be\ncau\tse."}', "Be\ncau\tse.", "low_score"),
        ('{"question": "Why is it so here?", "answer": "Be\\ncause."}', "Be\ncause.", "low_score"),
        ('{"question": "Why is it so here?", "answer": "a {b} c"}', "a {b} c", "low_score"),
        ('{"question": "Why?", "answer": "x"} trailing', None, "bad_json"),
        ("{'question': 'Why?', 'answer': 'x'}", None, "bad_json"),
        ('["question", "answer"]', None, "bad_json"),
        ("42", None, "bad_json"),
        ('{"question": "Why is it so here?", "answer": "x", "meta": {"a": [1, {"b": "}"}]}}', "x", "low_score"),
        ('{"question": "Why is it so here?", "answer": "x"} {}', None, "bad_json"),
        ('{"question": "Why is it so here?", "answer": "x", "meta": {"a": 1}', None, "bad_json"),
        ('{"question": "Why is it so here?"}', None, "missing"),
        ('{"question": "Why is it so here?", "answer": null}', None, "missing"),
        ('{"question": "a", "question": "Why is it so here?", "answer": "x"}', "x", "low_score"),
        ("", None, "no_response"),
        (None, None, "no_response"),
    ],
)
def test_replies(spark, raw, answer, reason):
    r = dataset.score_responses(spark.createDataFrame([(1, raw)], "draw_id long, raw string")).first()
    assert (r.answer, r.reject_reason) == (answer, reason)


def test_costs_and_rates(spark):
    rows = spark.createDataFrame([(12543, 8721, "ok")] + [(0, 0, "empty")] * 99 + [(None, None, "error")], "prompt_tokens long, completion_tokens long, status string")
    r = synth.cost_report(rows).first()
    assert (r.input_tokens, r.output_tokens, r.api_calls) == (12543, 8721, 100)
    assert (round(r.input_cost, 4), round(r.output_cost, 4), round(r.total_cost, 4), round(r.avg_cost_per_call, 6)) == (0.0050, 0.0140, 0.0190, 0.000190)
    marks = spark.createDataFrame([(True,)] * 19 + [(False,)] * 23, "is_valid boolean")
    assert round(dataset.acceptance(marks).first().acceptance_rate, 3) == 0.452
    none = dataset.quality_report(spark.createDataFrame([], "quality_score double")).first()
    assert (none.total_examples, none.avg_quality, none.min_quality) == (0, 0.0, None)


def test_lower_least_length_of_loose_thresholds(spark):
    assert spark.range(1).select(score.length_points(F.lit(10), ValidationConfig(0.3, 10))).first()[0] == 0.4
