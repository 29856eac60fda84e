"""Scores of answers against gold answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .training_sets import completion_column, text_column

ANSWER = "(?is)<answer>(.*?)</answer>"


def normalized(text: Column) -> Column:
    """Lower case, trimmed, with single spaces."""
    return F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " ")


def final_answer(text: Column) -> Column:
    """The first marked answer, else the whole text, trimmed."""
    return strip(F.when(text.rlike(ANSWER), F.regexp_extract(text, ANSWER, 1)).otherwise(text))


def exact(prediction: Column, gold: Column) -> Column:
    """Both normalized."""
    return F.when((gold != "") & (prediction == gold), 2.0).otherwise(0.0)


def partial(prediction: Column, gold: Column) -> Column:
    """Both normalized: one inside the other."""
    return F.when((prediction != "") & (gold != "") & (gold.contains(prediction) | prediction.contains(gold)), 0.5).otherwise(0.0)


def form(completion: Column) -> Column:
    low = F.lower(completion)
    marked = lambda tag: low.contains(f"<{tag}>") & low.contains(f"</{tag}>")
    return F.when(marked("reasoning"), 0.25).otherwise(0.0) + F.when(marked("answer"), 0.75).otherwise(0.0)


def non_empty(completion: Column) -> Column:
    return F.when(strip(completion) != "", 0.25).otherwise(-0.25)


def score_table(df: DataFrame, completion: str, gold: str) -> DataFrame:
    """Add the four scores and their sum. Texts are normalized once, up front."""
    df = df.withColumn("_c", completion_column(df, completion))
    c = F.col("_c")
    ready = df.withColumns({"_p": normalized(final_answer(c)), "_g": normalized(text_column(df, gold))})
    scored = ready.withColumns({
        "format": form(c), "non_empty": non_empty(c),
        "partial": partial(F.col("_p"), F.col("_g")), "exact": exact(F.col("_p"), F.col("_g")),
    })
    total = F.col("format") + F.col("non_empty") + F.col("partial") + F.col("exact")
    return scored.withColumn("total", total).drop("_p", "_g")
