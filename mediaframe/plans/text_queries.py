"""Queries of the text operators over documents, conversations and benchmark, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import folds as O
from ..operators import text as T
from .base import EV, HOUR, MIN, events, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NORM = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
LINES = "ln AS (SELECT doc_id, source, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)), li AS (SELECT * FROM ln WHERE trim(line) <> '')"


@query(f"SELECT doc_id, length({NORM.format('text')}) AS n, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def text_norm(spark, d):
    norm = C.normalise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(norm).cast("bigint").alias("n"), F.md5(norm.cast("binary")).alias("norm_md5"))


@query(f"""WITH {LINES}, t AS (SELECT source, count(DISTINCT doc_id) AS samples FROM li GROUP BY source), r AS (SELECT DISTINCT source, doc_id, {NORM.format('line')} AS norm FROM li),
g AS (SELECT source, norm, count(*) AS n FROM r WHERE norm <> '' GROUP BY ALL)
SELECT source, md5(norm) AS norm_md5, n, round(n / samples, 6) AS share, (n / samples >= 0.05 AND n >= 3) AS persistent FROM g JOIN t USING (source) WHERE n >= 2""")
def persistent_text(spark, d):
    rows = T.lines(table(spark, d, "documents"), ["doc_id", "source"], "text")
    got = T.persistent(rows, ["source"], "doc_id", "line", 0.05)
    return got.where("n >= 2").select("source", F.md5(F.col("norm").cast("binary")).alias("norm_md5"), "n", F.round("share", 6).alias("share"), "persistent")


@query(f"""WITH {LINES}, g AS (SELECT {NORM.format('line')} AS norm, count(DISTINCT source) AS n FROM li GROUP BY 1) SELECT md5(norm) AS norm_md5, n FROM g WHERE norm <> '' AND n >= greatest(3, ceil(0.25 * (SELECT count(DISTINCT source) FROM li)))""")
def recurring_chrome(spark, d):
    rows = T.lines(table(spark, d, "documents"), ["doc_id", "source"], "text")
    return T.recurring(rows, "source", "line").select(F.md5(F.col("norm").cast("binary")).alias("norm_md5"), "n")


@query(f"""WITH {LINES}, n AS (SELECT *, {NORM.format('line')} AS norm FROM li), o AS (SELECT *, row_number() OVER (PARTITION BY source, norm ORDER BY length(line) DESC, doc_id, line_no) AS r FROM n WHERE norm <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(line) DESC, doc_id, line_no) AS rank FROM o WHERE r = 1)
SELECT source, rank, doc_id, md5(norm) AS norm_md5 FROM k WHERE rank <= 12""")
def text_dedupe(spark, d):
    rows = T.lines(table(spark, d, "documents"), ["doc_id", "source"], "text")
    got = T.scene_lines(rows, ["source"], "line", [F.length("line").desc(), F.col("doc_id"), F.col("line_no")])
    return got.select("source", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.md5(F.col("norm").cast("binary")).alias("norm_md5"))


@query(f"""WITH {LINES} SELECT doc_id, md5(arg_max(line, struct_pack(a := length(line), b := -line_no))) AS headline_md5 FROM li WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]') GROUP BY doc_id""")
def headline(spark, d):
    rows = T.lines(table(spark, d, "documents"), ["doc_id"], "text").withColumn("height", F.length("line"))
    return T.headline(rows, ["doc_id"], "line", "height", "line_no").select("doc_id", F.md5(F.col("headline").cast("binary")).alias("headline_md5"))


ASCII = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH o AS (SELECT item_id, {ASCII.format('text')} AS a, lead({ASCII.format('text')}) OVER (ORDER BY item_id) AS b FROM benchmark) SELECT item_id, round(levenshtein(a, b) / greatest(1, length(b)), 6) AS cer FROM o WHERE b IS NOT NULL""")
def cer(spark, d):
    w = Window.partitionBy(F.lit(0)).orderBy("item_id")  # the test items: a small table
    rows = table(spark, d, "benchmark").withColumn("after", F.lead("text").over(w)).where("after is not null")
    return rows.select("item_id", F.round(C.cer(F.col("text"), F.col("after"), True), 6).alias("cer"))


@query()
def fuzzy_ratio(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return rows.select("conv_id", "turn", F.round(T.fuzzy(F.col("before"), F.col("text")), 6).alias("ratio"))


WORDS = r"ww AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS word_no, unnest(l) AS word FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS l FROM conversations)), w AS (SELECT * FROM ww WHERE word <> '')"


@query(f"""WITH {WORDS}, s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.?!。？！…]$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
SELECT conv_id, turn, CAST(s AS BIGINT) AS sentence, count(*) AS n_words, md5(string_agg(word, ' ' ORDER BY word_no)) AS text_md5 FROM s GROUP BY ALL""")
def sentences(spark, d):
    rows = T.words(table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return T.sentences(rows, ["conv_id", "turn"], "word_no", "word").select("conv_id", "turn", F.col("sentence").cast("bigint").alias("sentence"), "n_words", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH RECURSIVE {WORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY word_no) AS i, word_no * 300000 AS s, word_no * 300000 + 250000 AS e FROM w),
f AS (SELECT o.*, s AS c0, regexp_matches(word, '[.?!。？！…]$') AS closed FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN f.closed OR o.e - f.c0 > 7000000 THEN o.s ELSE f.c0 END, regexp_matches(o.word, '[.?!。？！…]$') FROM f JOIN o ON o.conv_id = f.conv_id AND o.turn = f.turn AND o.i = f.i + 1)
SELECT conv_id, turn, c0 AS start_us, max(e) AS end_us, md5(string_agg(word, ' ' ORDER BY i)) AS text_md5 FROM f GROUP BY ALL""")
def cues(spark, d):
    import re

    ends = re.compile("[.?!。？！…]$")
    rows = T.words(table(spark, d, "conversations"), ["conv_id", "turn"], "text").withColumns({"s": (F.col("word_no") * 300000).cast("bigint"), "e": (F.col("word_no") * 300000 + 250000).cast("bigint")})
    got = O.fold(rows, ["conv_id", "turn"], ["word_no"], ["s", "e", "word"], lambda r: O.cues(r, 7_000_000, lambda w: bool(ends.search(w))), "start_us bigint, end_us bigint, text string")
    return got.select("conv_id", "turn", "start_us", "end_us", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {EV}, sp AS (SELECT user_id, t_us AS start_us, t_us + k * {MIN} AS end_us FROM ev WHERE event_type <> 'view'), st AS (SELECT user_id, t_us FROM ev WHERE event_type = 'view' AND value >= 60),
o AS (SELECT sp.*, (SELECT count(*) FROM st WHERE st.user_id = sp.user_id AND st.t_us <= sp.start_us) AS n FROM sp),
b AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER w < {24 * HOUR} AND n = lag(n) OVER w THEN 0 ELSE 1 END AS nw FROM o WINDOW w AS (PARTITION BY user_id ORDER BY start_us, end_us)),
g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS say FROM b)
SELECT user_id, say, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM g GROUP BY user_id, say""")
def say_rows(spark, d):
    ev = events(spark, d)
    spans = ev.where("event_type <> 'view'").select("user_id", F.col("t_us").alias("start_us"), (F.col("t_us") + F.col("k") * MIN).alias("end_us"))
    got = T.say_rows(spans, ev.where("event_type = 'view' and value >= 60").select("user_id", "t_us"), ["user_id"], 24 * HOUR)
    return got.withColumn("say", F.col("say").cast("bigint"))


@query("""WITH r AS (SELECT CASE WHEN role = 'user' THEN 'say' ELSE 'ocr' END AS kind, turn * 10000000 AS start_us, turn * 10000000 + length(text) AS end_us, conv_id, text FROM conversations)
SELECT kind, start_us, conv_id, length(text) AS n FROM r WHERE greatest(end_us, start_us + 1) > 15000000 AND start_us < 60000000 AND regexp_matches(text, '(?i)tion') ORDER BY start_us, kind, text LIMIT 200""")
def text_view(spark, d):
    rows = table(spark, d, "conversations").select(F.when(F.col("role") == "user", "say").otherwise("ocr").alias("kind"), (F.col("turn") * 10_000_000).alias("start_us"), (F.col("turn") * 10_000_000 + F.length("text")).alias("end_us"), "conv_id", "text")
    got = T.text_view(rows, 15_000_000, 60_000_000, "tion", ["say", "ocr"], 200)
    return got.select("kind", "start_us", "conv_id", F.length("text").cast("bigint").alias("n"))


@query()
def text_events(spark, d):
    """Turns are samples, their lines recognised rows; texts tracked across samples by fuzzy score."""
    rows = T.lines(table(spark, d, "conversations"), ["conv_id", "turn"], "text").withColumn("conf", F.lit(0.9))

    def run(r):
        return O.text_events(r, T.fuzzy_ratio, r[-1][0] + 1)

    return O.fold(rows, ["conv_id"], ["turn", "line_no"], ["turn", "line_no", "line", "conf"], run, "first bigint, last bigint, text string")


@query(r"""SELECT page_id, regexp_matches(url, '^https') AS secure, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def escape_urls(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("url").rlike("^https").alias("secure"), C.escape_html(F.col("url")).alias("escaped"))
