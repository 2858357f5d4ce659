"""Scores of question-answer pairs: length, form of the question, substance of the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.text import once, strip, word_count
from pathloom.model import ValidationConfig

#: Answers that say nothing.
GENERIC = ("yes", "no", "i don't know", "not sure", "maybe")
#: How questions begin.
STARTS = ("what", "how", "why", "when", "where", "who", "which", "can", "is", "does", "do")


def _hard(question: Column, answer: Column, q: Column, a: Column) -> Column:
    return (
        F.when(question.isNull() | answer.isNull(), "missing")
        .when((q == "") | (a == ""), "empty")
        .when(F.length(q) < 10, "short_question")
        .when(F.btrim(F.lower(a), F.lit(".,!? ")).isin(*GENERIC), "generic_answer")
    )


def _format(q: Column) -> Column:
    return F.when(q.contains("?"), F.lit(0.3)).when(F.lower(q).rlike("^(?:" + "|".join(STARTS) + ")"), F.lit(0.2)).otherwise(F.lit(0.0))


def _substance(a: Column) -> Column:
    n = F.length(a)
    return F.when((n >= 50) & a.rlike("[.!?]"), F.lit(0.3)).when(n >= 30, F.lit(0.2)).when(n >= 20, F.lit(0.1)).otherwise(F.lit(0.0))


def length_points(words: Column, config: ValidationConfig) -> Column:
    return (
        F.when((words >= config.min_length) & (words <= config.max_length), F.lit(0.4))
        .when(words > config.max_length, F.lit(0.35))
        .when(words >= 10, F.lit(0.4) * (words / F.lit(config.min_length)))
        .otherwise(F.lit(0.0))
    )


def measured(df: DataFrame, question: Column, answer: Column) -> DataFrame:
    """df with what every threshold needs of a pair: _hard (why it is rejected at once, or null), _words, _fmt and _sub.

    Rows of their own, of one struct each, so that texts are stripped and split once however often the measures are used: the
    optimizer copies columns into a filter on them, once for every use, but takes no filter through a generator."""
    df = once(df, _q=strip(question), _a=strip(answer))
    q, a = F.col("_q"), F.col("_a")
    return once(df, _hard=_hard(question, answer, q, a), _words=word_count(a), _fmt=_format(q), _sub=_substance(a)).drop("_q", "_a")


def judged(config: ValidationConfig = ValidationConfig()) -> dict[str, Column]:
    """len_score, fmt_score, sub_score, quality_score, is_valid and reject_reason of measured rows, added up in this order."""
    hard, zero = F.col("_hard"), F.lit(0.0)
    ok = hard.isNull()
    parts = {"len_score": length_points(F.col("_words"), config), "fmt_score": F.col("_fmt"), "sub_score": F.col("_sub")}
    total = parts["len_score"] + parts["fmt_score"] + parts["sub_score"]
    return {k: F.when(ok, v).otherwise(zero) for k, v in parts.items()} | {
        "quality_score": F.when(ok, F.least(F.lit(1.0), total)).otherwise(zero),
        "is_valid": ok & (total >= config.quality_threshold),
        "reject_reason": F.coalesce(hard, F.when(total < config.quality_threshold, "low_score")),
    }


def with_scores(df: DataFrame, question: Column, answer: Column, config: ValidationConfig = ValidationConfig()) -> DataFrame:
    return measured(df, question, answer).withColumns(judged(config)).drop("_hard", "_words", "_fmt", "_sub")
