"""Text operators: sentences, fuzzy equality, persistent and recurring text, headlines, subtitles, text views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_letters, normalise

SENTENCE_END = r"[.?!。？！…]$"
TIMING = r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})"


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, line_no, line of every line that is not blank."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line")).where(F.trim("line") != "")


def words(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    out = df.select(*keys, F.posexplode(F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")).alias("word_no", "word"))
    return out.where("word <> ''")


def sentences(df: DataFrame, keys: list[str], order: str, word: str) -> DataFrame:
    """Words joined up to each that ends a sentence; what remains is a sentence too."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.sum(F.col(word).rlike(SENTENCE_END).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("sentence", F.coalesce(before, F.lit(0)))
    got = rows.groupBy(*keys, "sentence").agg(F.count("*").alias("n_words"), F.sort_array(F.collect_list(F.struct(order, word))).alias("_l"))
    return got.select(*keys, "sentence", "n_words", F.array_join(F.transform("_l", lambda x: x[word]), " ").alias("text"))


def fuzzy_ratio(a: str, b: str, changed: float | None = None, most: float = 0.005) -> float:
    """Matching-block ratio of normalised texts if it is 0.8 or more; 1.0 if equal, 0.0 if it is less, their digits differ or the picture changed. Two cheap upper bounds come first."""
    import re
    from difflib import SequenceMatcher

    norm = lambda s: re.sub(r"[\W_]+", "", s.casefold())
    x, y = norm(a), norm(b)
    if x == y:
        return 1.0
    if re.sub(r"\D", "", x) != re.sub(r"\D", "", y) or (changed is not None and changed >= most):
        return 0.0
    m = SequenceMatcher(None, x, y, autojunk=False)
    ratio = m.ratio() if m.real_quick_ratio() >= 0.8 and m.quick_ratio() >= 0.8 else 0.0
    return ratio if ratio >= 0.8 else 0.0


def fuzzy(a: Column, b: Column) -> Column:
    import pandas as pd

    def run(x, y):
        return pd.Series([None if p is None or q is None else fuzzy_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(a, b)


def persistent(df: DataFrame, by: list[str], sample: str, text: str, share: float = 0.5, least: int = 3) -> DataFrame:
    """Per group and normalised text: samples that show it, their share, and whether that makes it persistent."""
    total = df.groupBy(*by).agg(F.countDistinct(sample).alias("samples"))
    rows = df.select(*by, sample, normalise(F.col(text)).alias("norm")).where("norm <> ''").distinct()
    got = rows.groupBy(*by, "norm").agg(F.count("*").alias("n")).join(total, by)
    return got.withColumn("share", F.col("n") / F.col("samples")).withColumn("persistent", (F.col("share") >= share) & (F.col("n") >= least))


def recurring(df: DataFrame, scene: str, text: str, share: float = 0.25, least: int = 3) -> DataFrame:
    """Texts seen in at least max(least, ceil(share * scenes)) different scenes."""
    scenes = df.agg(F.countDistinct(scene).alias("scenes"))
    rows = df.select(scene, normalise(F.col(text)).alias("norm")).where("norm <> ''").groupBy("norm").agg(F.countDistinct(scene).alias("n"))
    return rows.join(F.broadcast(scenes)).where(F.col("n") >= F.greatest(F.lit(least), F.ceil(share * F.col("scenes")))).select("norm", "n")  # one row: the number of scenes


def scene_lines(df: DataFrame, by: list[str], text: str, order: list[Column], most: int = 12) -> DataFrame:
    """The first ``most`` lines of each scene in ``order``, equal normalised texts once (a top-k report)."""
    rows = df.withColumn("norm", normalise(F.col(text))).where("norm <> ''")
    once = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "norm").orderBy(*order))).where("_r = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most).drop("_r")


def headline(df: DataFrame, by: list[str], text: str, height: str, tie: str) -> DataFrame:
    """The tallest line with a letter; the first on ties."""
    return df.where(has_letters(F.col(text))).groupBy(*by).agg(F.max_by(text, F.struct(F.col(height), -F.col(tie))).alias("headline"))


def subtitles(files: DataFrame, name: str = "path", text: str = "value") -> DataFrame:
    """Cues of SRT or WebVTT texts: start_us, end_us, text, by file; markup gone, lines joined, sorted by start in the file."""
    block = F.explode(F.split(F.regexp_replace(text, "\r\n?", "\n"), r"\n[ \t]*\n+"))
    rows = files.select(name, block.alias("_b")).where(F.col("_b").rlike(TIMING))
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract("_b", TIMING, k), F.lit("")), F.lit("0")).cast("bigint")
    at = lambda k: (((part(k) * 60 + part(k + 1)) * 60 + part(k + 2)) * 1000 + part(k + 3)) * 1000
    body = F.regexp_replace(F.regexp_replace("_b", r"(?s)^.*?-->[^\n]*\n?", ""), r"<[^>]*>|\{\\[^}]*\}", "")
    return rows.select(name, at(1).alias("start_us"), at(5).alias("end_us"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("text")).where("text <> ''")


def say_rows(spans: DataFrame, stops: DataFrame, by: list[str], silence: int) -> DataFrame:
    """Sentences (start_us, end_us) joined until ``silence`` between them or a screen stop (t_us) between their starts."""
    line = spans.select(*by, F.col("start_us").alias("_o"), "start_us", "end_us", F.lit(0).alias("_stop")).unionByName(stops.select(*by, F.col("t_us").alias("_o"), F.lit(None).cast("bigint").alias("start_us"), F.lit(None).cast("bigint").alias("end_us"), F.lit(1).alias("_stop")))
    before = Window.partitionBy(*by).orderBy("_o", F.desc("_stop"), "end_us").rowsBetween(Window.unboundedPreceding, 0)
    rows = line.withColumn("_n", F.sum("_stop").over(before)).where("_stop = 0")
    w = Window.partitionBy(*by).orderBy("start_us", "end_us")
    breaks = (F.col("start_us") - F.lag("end_us").over(w) >= silence) | (F.col("_n") != F.lag("_n").over(w)) | F.lag("end_us").over(w).isNull()
    rows = rows.withColumn("_b", F.when(breaks, 1).otherwise(0)).withColumn("say", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy(*by, "say").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"))


def text_view(rows: DataFrame, start: int, end: int, pattern: str | None, kinds: list[str] | None, most: int) -> DataFrame:
    """The first ``most`` rows (kind, start_us, end_us, text) by time that overlap [start, end) and match; a zero-length row counts at its start."""
    out = rows.where((F.greatest(F.col("end_us"), F.col("start_us") + 1) > start) & (F.col("start_us") < end))
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if pattern:
        out = out.where(F.col("text").rlike(f"(?i){pattern}"))
    return out.orderBy("start_us", "kind", "text").limit(most)
