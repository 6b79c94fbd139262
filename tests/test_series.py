"""Literal cases: boundaries, ties, empty and single rows."""

from pyspark.sql import functions as F

from mediaframe.functions import scalars as C
from mediaframe.operators import joins as J
from mediaframe.operators import series as S
from mediaframe.operators import text as T

EV = "v string, t bigint, id bigint, x double"


def test_equal_gap_stays_and_larger_gap_splits(spark):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 10, 2, 1.0), ("a", 21, 3, 1.0), ("b", 11, 4, 1.0)], EV)
    got = {r.id: r.session for r in S.gap_sessions(df, ["v"], "t", "id", 10).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}
    assert S.gap_sessions(df.where("false"), ["v"], "t", "id", 10).count() == 0


def test_specks_join_the_nearest_core_and_the_first_on_ties(spark):
    df = spark.createDataFrame([("a", 0, 1, 9.0), ("a", 20, 2, 9.0), ("a", 10, 3, 1.0), ("a", 13, 4, 1.0), ("a", 99, 5, 1.0), ("a", 105, 6, 1.0)], EV)
    got = {r.id: (r.kind, r.group) for r in S.attach_specks(df, ["v"], "t", "id", F.col("x") > 5, 10).collect()}
    assert got == {1: ("core", 0), 2: ("core", 1), 3: ("attached", 0), 4: ("attached", 1), 5: ("own", 0), 6: ("own", 0)}


def test_lower_quantile_against_sorting(spark):
    import random

    r = random.Random(3)
    values = [r.choice([1.0, 2.0, 5.0, 7.5, 9.0]) for _ in range(60)]
    df = spark.createDataFrame([("a", i, i, v) for i, v in enumerate(values)], EV)
    for q in (0.1, 0.5):
        got = {x.id: x.q for x in S.running_lower_quantile(df, ["v"], ["t", "id"], "x", q, 2, "q").collect()}
        for i in range(60):
            seen = sorted(values[1 : i + 3])
            assert got[i] == seen[int(q * (len(seen) - 1))]


def test_asof_takes_the_last_row_at_or_before(spark):
    a = spark.createDataFrame([("a", 5, 1, 0.0), ("a", 10, 2, 0.0), ("b", 1, 3, 0.0)], EV)
    b = spark.createDataFrame([("a", 5, 7, 1.0), ("a", 5, 8, 2.0), ("a", 9, 9, 3.0)], EV)
    got = {r.id: r.right_x for r in J.asof_backward(a, b, ["v"], "t", "id", ["x"]).collect()}
    assert got == {1: 2.0, 2: 3.0, 3: None}


def test_coverage_merges_and_clips(spark):
    q = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 50, 60), ("a", 3, 5, 5)], "v string, k bigint, start_us bigint, end_us bigint")
    s = spark.createDataFrame([("a", 2, 4), ("a", 3, 8), ("a", 58, 99)], "v string, start_us bigint, end_us bigint")
    got = {r.k: r.covered_us for r in J.coverage(q, s, ["v"], "k", 7).collect()}
    assert got == {1: 6, 2: 2, 3: 0}


def test_clock_and_times(spark):
    df = spark.createDataFrame([("1:02:03.5",), ("2:03",), ("7.25",), ("-1",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(C.parse_time(F.col("s"))).collect()] == [3723.5, 123.0, 7.25, None, None, None]
    assert spark.range(1).select(C.clock(F.lit(3723.46))).first()[0] == "1:02:03.5"
    assert spark.range(1).select(C.clock(F.lit(5.0))).first()[0] == "00:05.0"
    assert [r[0] for r in spark.createDataFrame([(1.5,), (-0.0001,), (2.0,)], "x double").select(C.css_number(F.col("x"))).collect()] == ["1.5", "0", "2"]


def test_links(spark):
    df = spark.createDataFrame([("https://youtu.be/abc_DEF-123",), ("https://www.youtube.com/watch?v=abc_DEF-123&t=1",), ("https://m.youtube.com/shorts/abc_DEF-123",), ("https://example.com/watch?v=abc_DEF-123",)], "u string")
    assert [r[0] for r in df.select(C.youtube_id(F.col("u"))).collect()] == ["abc_DEF-123"] * 3 + [None]
    assert df.select(C.deep_link(F.col("u"), F.lit(61.9))).first()[0].endswith("&t=61s")


def test_subtitles(spark):
    srt = "1\r\n00:00:00,483 --> 00:00:01,477\r\nOne\r\n\r\n2\r\n00:00:02,031 --> 00:00:05,109\r\n<i>Two</i>\r\n{\\an8}lines\r\n"
    vtt = "WEBVTT\n\n00:06.289 --> 00:09.851 align:start\nThree\n"
    df = spark.createDataFrame([("a", srt), ("b", vtt)], "path string, value string")
    got = [tuple(r) for r in T.subtitles(df).orderBy("path", "start_us").collect()]
    assert got == [("a", 483000, 1477000, "One"), ("a", 2031000, 5109000, "Two lines"), ("b", 6289000, 9851000, "Three")]


def test_fuzzy():
    assert T.fuzzy_ratio("Hello, World", "hello world!") == 1.0
    assert T.fuzzy_ratio("page 12", "page 13") == 0.0
    assert T.fuzzy_ratio("the quick brown fox", "the quick brown fax") > 0.8
    assert T.fuzzy_ratio("abc", "xyz") == 0.0


def test_hamming_pairs_find_planted_hashes(spark):
    h = spark.createDataFrame([(1, 0), (2, 0b1111), (3, 0b11111)], "id long, h long")
    got = h.alias("a").crossJoin(h.alias("b")).where("a.id < b.id").select("a.id", "b.id", C.hamming(F.col("a.h"), F.col("b.h"))).collect()
    assert {tuple(r) for r in got} == {(1, 2, 4), (1, 3, 5), (2, 3, 1)}
