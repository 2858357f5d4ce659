"""Training examples: parsing, selection, sinks and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pathloom.functions.score import with_scores
from pathloom.functions.text import unfenced, with_parsed
from pathloom.model import ValidationConfig


def score_responses(responses: DataFrame, config: ValidationConfig = ValidationConfig()) -> DataFrame:
    """draw_id, question, answer, difficulty, scores, is_valid and reject_reason of raw replies."""
    qa = with_parsed(responses.select("draw_id", "raw"), unfenced(F.col("raw")), "qa")
    rows = with_scores(qa.select("draw_id", "raw", F.col("qa").isNull().alias("_bad"), F.col("qa.question").alias("question"), F.col("qa.answer").alias("answer"), F.col("qa.difficulty").alias("difficulty")), F.col("question"), F.col("answer"), config)
    reason = F.when(F.coalesce(F.col("raw"), F.lit("")) == "", "no_response").when(F.col("_bad"), "bad_json").otherwise(F.col("reject_reason"))
    return rows.withColumn("reject_reason", reason).drop("raw", "_bad")


def messages(question: Column, answer: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def examples(rows: DataFrame) -> DataFrame:
    """draw_id, messages and quality_score of the valid rows; texts as they were, unstripped."""
    return rows.filter("is_valid").select("draw_id", messages(F.col("question"), F.col("answer")).alias("messages"), "quality_score")


def acceptance(rows: DataFrame) -> DataFrame:
    """One row: accepted, rejected and the rate of acceptance, 0 if there is nothing."""
    n = rows.agg(F.count_if("is_valid").alias("accepted"), F.count_if(~F.col("is_valid")).alias("rejected"))
    return n.select("accepted", "rejected", F.when(F.col("accepted") + F.col("rejected") == 0, 0.0).otherwise(F.col("accepted") / (F.col("accepted") + F.col("rejected"))).alias("acceptance_rate"))


def quality_report(found: DataFrame) -> DataFrame:
    """One row: count, average (0 if there is none), minimum and maximum of quality_score."""
    return found.agg(F.count(F.lit(1)).alias("total_examples"), F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"), F.min("quality_score").alias("min_quality"), F.max("quality_score").alias("max_quality"))


def _in_order(found: DataFrame) -> Iterator[Row]:
    return found.orderBy(*(c for c in ("tier", "draw_id") if c in found.columns)).toLocalIterator()


def write_jsonl(found: DataFrame, path: str) -> None:
    """JSON lines in one local file, without scores, row by row through the driver, as fine-tuning services take them."""
    with open(path, "w", encoding="utf-8") as out:
        for r in _in_order(found):
            out.write(json.dumps({"messages": [m.asDict() for m in r.messages]}, ensure_ascii=False) + "\n")


def write_jsonl_parts(found: DataFrame, path: str) -> None:
    """JSON lines in a folder of part files, without scores, written by the executors."""
    found.select("messages").write.mode("overwrite").json(path)


def write_json(found: DataFrame, path: str) -> None:
    """One pretty JSON array in a local file, with scores, row by row through the driver."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, r in enumerate(_in_order(found)):
            row = {"messages": [m.asDict() for m in r.messages], "quality_score": r.quality_score}
            out.write((",\n" if i else "\n") + json.dumps(row, ensure_ascii=False, indent=2))
        out.write("\n]\n")


def first_examples(found: DataFrame, n: int = 5) -> list[dict]:
    """The first examples for a look (their number is the feature)."""
    order = [c for c in ("tier", "draw_id") if c in found.columns]
    return [{"question": r.messages[0].content, "answer": r.messages[1].content, "quality_score": r.quality_score} for r in found.orderBy(*order).limit(n).collect()]
