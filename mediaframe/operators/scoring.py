"""Scoring of answers against truth: movements, cuts, texts, sentences, repeats; per-run scores and their cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import cubic_y
from ..functions.scalars import cer, normalise
from .folds import fold, greedy_match


def match_by_time(truth: DataFrame, answers: DataFrame, by: list[str], within: float) -> DataFrame:
    """by, truth_key, answer_key: each truth, in its order of start, takes the nearest answer that is left within ``within``. Both have key and start_s."""
    rows = truth.select(*by, "key", "start_s", F.lit(0).alias("side")).unionByName(answers.select(*by, "key", "start_s", F.lit(1).alias("side")))

    def run(r):
        a, b = ([(k, t) for k, t, s in r if s == side] for side in (0, 1))
        return [(a[i][0], b[j][0]) for i, j in greedy_match([t for _, t in a], [t for _, t in b], within)]

    return fold(rows, by, ["side", "start_s", "key"], ["key", "start_s", "side"], run, "truth_key bigint, answer_key bigint")


def same_curve(a: tuple, b: tuple, points: float = 0.1, shape: float = 0.05) -> bool:
    """All control values within ``points``, or the curves within ``shape`` everywhere."""
    import numpy as np

    x = np.linspace(0, 1, 101)
    return all(abs(p - q) <= points for p, q in zip(a, b)) or float(np.abs(cubic_y(a, x) - cubic_y(b, x)).max()) <= shape


def text_present(truth: DataFrame, answers: DataFrame, by: list[str], near: float = 0.05) -> DataFrame:
    """Per truth text 1.0 if an answer holds it (normalised), 0.5 if one comes within ``near`` character errors, else 0. Answers of a slide are few."""
    a = answers.select(*by, F.col("text").alias("_a"))
    met = truth.join(a, by, "left")
    hit = F.coalesce(F.contains(normalise(F.col("_a")), normalise(F.col("text"))), F.lit(False))
    points = F.when(hit, 1.0).when(F.coalesce(cer(F.col("_a"), F.col("text")) <= near, F.lit(False)), 0.5).otherwise(0.0)
    return met.withColumn("_p", points).groupBy(*by, "key").agg(F.max("_p").alias("points"))


def sentence_times(truth: DataFrame, answers: DataFrame, by: list[str], within: float = 0.15) -> DataFrame:
    """Per truth sentence, whether an answer starts and ends within ``within`` seconds of it."""
    a = answers.select(*by, F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.floor(F.col("start_s")).alias("_b"))
    t = truth.withColumn("_b", F.explode(F.array(*(F.floor(F.col("start_s")) + d for d in (-1, 0, 1)))))
    ok = (F.abs(F.col("start_s") - F.col("_s")) <= within) & (F.abs(F.col("end_s") - F.col("_e")) <= within)
    return t.join(a, [*by, "_b"], "left").groupBy(*by, "key").agg(F.max(F.coalesce(ok, F.lit(False))).alias("found"))


def repeats(starts: DataFrame, by: list[str]) -> DataFrame:
    """Number of repeats and the median step between their starts (start_s)."""
    step = F.col("start_s") - F.lag("start_s").over(Window.partitionBy(*by).orderBy("start_s"))
    return starts.withColumn("_d", step).groupBy(*by).agg(F.count("*").alias("n"), F.percentile("_d", F.lit(0.5)).alias("period_s"))


def run_score(checks: DataFrame, by: list[str], check: str, false_positives: Column) -> DataFrame:
    """max(0, sum of the checks - false positives) over the number of checks."""
    got = checks.groupBy(*by).agg(F.sum(check).alias("_s"), F.count("*").alias("_n"), F.max(false_positives).alias("_f"))
    return got.select(*by, (F.greatest(F.lit(0.0), F.col("_s") - F.coalesce("_f", F.lit(0))) / F.col("_n")).alias("score"))


def gist(text: str, keywords: list[list[str]]) -> Column:
    """Share of keyword groups of which the text has one."""
    hits = [F.col(text).rlike("(?i)" + "|".join(group)).cast("double") for group in keywords]
    return sum(hits[1:], hits[0]) / len(hits)
