"""Scores on literal answers."""

from pyspark.sql import functions as F

from mediaframe.operators import scoring as S


def test_matching_and_scores(spark):
    truth = spark.createDataFrame([("r", 1, 1.0), ("r", 2, 1.05), ("r", 3, 9.0)], "run string, key bigint, start_s double")
    answers = spark.createDataFrame([("r", 7, 1.04), ("r", 8, 1.0), ("r", 9, 5.0)], "run string, key bigint, start_s double")
    got = {(r.truth_key, r.answer_key) for r in S.match_by_time(truth, answers, ["run"], 0.1).collect()}
    assert got == {(1, 8), (2, 7)}
    checks = spark.createDataFrame([("r", 1.0, 1), ("r", 0.5, 1), ("r", 1.0, 1), ("q", 0.0, 5)], "run string, c double, fp int")
    assert {r.run: r.score for r in S.run_score(checks, ["run"], "c", F.col("fp")).collect()} == {"r": 0.5, "q": 0.0}


def test_curves_texts_sentences(spark):
    assert S.same_curve((0.25, 0.1, 0.25, 1), (0.3, 0.15, 0.25, 1)) and not S.same_curve((0, 0, 1, 1), (0.9, 0, 0.9, 0.1))
    truth = spark.createDataFrame([(1, 1, "Hello World"), (1, 2, "The quick brown fox jumps"), (1, 3, "missing")], "slide int, key bigint, text string")
    answers = spark.createDataFrame([(1, "say hello, world!"), (1, "the quick brown fox jumpz")], "slide int, text string")
    assert {r.key: r.points for r in S.text_present(truth, answers, ["slide"]).collect()} == {1: 1.0, 2: 0.5, 3: 0.0}
    t = spark.createDataFrame([(1, 1, 0.95, 2.0), (1, 2, 5.0, 6.0)], "v int, key bigint, start_s double, end_s double")
    a = spark.createDataFrame([(1, 1.05, 2.1), (1, 5.0, 6.5)], "v int, start_s double, end_s double")
    assert {r.key: r.found for r in S.sentence_times(t, a, ["v"]).collect()} == {1: True, 2: False}
    r = S.repeats(a.withColumn("g", F.lit(1)), ["g"]).first()
    assert r.n == 2 and abs(r.period_s - 3.95) < 1e-9
    df = spark.createDataFrame([("A card carousel turns",)], "s string")
    assert df.select(S.gist("s", [["carousel", "slider"], ["sound"]])).first()[0] == 0.5
