"""Streams over Parquet files, run to the end of what is there, against the batch operators."""

from pyspark.sql import functions as F

from mediaframe.operators import folds as O
from mediaframe.operators import series as S
from mediaframe.streaming import series as X


def test_sessions_and_onsets_match_the_batch(spark, tmp_path):
    base = 1_700_000_000_000_000
    rows = [("a", base + t * 1_000_000, i, float(i % 7)) for i, t in enumerate([0, 5, 15, 40, 41, 100, 100000])] + [("b", base + 3_000_000, 90, 2.0), ("b", base + 100_000_000_000, 91, 1.0)]
    df = spark.createDataFrame(rows, "v string, t_us long, id long, x double").withColumn("ts", F.timestamp_micros("t_us"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        q.stop()
        return spark.table(name)

    got = {(r.v, r.n) for r in run(X.gap_sessions(stream, ["v"], "10 seconds", "1 second", "x"), "s1").collect()}
    batch = S.gap_sessions(df, ["v"], "t_us", "id", 10_000_000).groupBy("v", "session").agg(F.count("*").alias("n"), F.max("t_us").alias("z"))
    want = {(r.v, r.n) for r in batch.where(F.col("z") < base + 99_000_000_000).collect()}
    assert got == want
    kept = {(r.v, r.t_us, r.strength) for r in run(X.dedupe_onsets(stream, "v", 30_000_000, "1 second", "x"), "s2").collect()}
    whole = {("a", *o) for o in O.dedupe_onsets([(t, x) for v, t, _, x in rows if v == "a"], 30_000_000)} | {("b", *o) for o in O.dedupe_onsets([(t, x) for v, t, _, x in rows if v == "b"], 30_000_000)}
    assert kept <= whole and {o for o in whole if o[1] < base + 99_000_000_000} <= kept
