"""Texts are stripped, split and parsed once a row, also under a filter on what comes of it."""

from pyspark.sql import functions as F

from pathloom.functions import score, text


def test_a_filter_on_scores_strips_no_text_again(spark):
    rows = spark.createDataFrame([("What is it?", " a thing ")], "question string, answer string")
    plan = score.with_scores(rows, F.col("question"), F.col("answer")).filter("is_valid")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.lower().count("trim(") <= 6 and plan.count("split(") == 1


def test_replies_are_cleaned_once(spark):
    rows = spark.createDataFrame([('```json\n{"question": "a\nb"}\n```',), ('{"question": "q"} x',), (None,)], "raw string")
    found = text.with_parsed(rows, text.unfenced(F.col("raw")), "qa")
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("trim(") == 1
    assert [r.qa and r.qa.question for r in found.collect()] == ["a\nb", None, None]
