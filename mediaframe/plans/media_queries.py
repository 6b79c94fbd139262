"""Queries of motion events, views, scores, picture and sound kernels and scalar functions, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as C
from ..operators import media as K
from ..operators import motion as M
from ..operators import scoring as R
from ..operators import text as T
from ..operators import view as V
from ..sources import sinks
from .base import EV, HOUR, MIN, events, table
from .state_queries import FRAMES, USER, frames_of, of, span_sql, spans_of

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Motion events


@query(f"""WITH {EV}, e AS (SELECT user_id, event_id, t_us AS first_us, t_us + k * {MIN} AS last_us FROM ev WHERE event_type = 'click'),
w AS (SELECT e.*, (SELECT max(t_us) FROM ev f WHERE f.user_id = e.user_id AND f.t_us < first_us) AS rest, (SELECT max(t_us) FROM ev f WHERE f.user_id = e.user_id AND f.t_us <= last_us + {HOUR}) AS end_us FROM e)
SELECT event_id, CASE WHEN rest >= first_us - {6 * HOUR} THEN rest ELSE first_us END AS start_us, end_us FROM w""")
def event_windows(spark, d):
    rows = of(spark, d, "click").select("user_id", "event_id", F.col("t_us").alias("first_us"), (F.col("t_us") + F.col("k") * MIN).alias("last_us"))
    frames = frames_of(spark, d).withColumnRenamed("frame", "frame_index").select("user_id", "t_us", "frame_index")
    return M.event_windows(rows, frames, USER, HOUR, 6 * HOUR).select("event_id", "start_us", "end_us")


@query(f"""WITH {EV}, u AS (SELECT user_id, min(k * 10) AS a, min(k * 5) AS b, max(k * 10 + event_id % 200) AS c, max(k * 5 + event_id % 100) AS e FROM ev WHERE event_type = 'view' GROUP BY user_id),
m AS (SELECT *, greatest(24.0, 0.1 * (c - a)) AS mx, greatest(24.0, 0.1 * (e - b)) AS my FROM u),
o AS (SELECT user_id, CAST(floor(greatest(0.0, a - mx) / 2) * 2 AS INTEGER) AS x0, CAST(floor(greatest(0.0, b - my) / 2) * 2 AS INTEGER) AS y0, CAST(floor(least(1920.0, c + mx + 1) / 2) * 2 AS INTEGER) AS x1, CAST(floor(least(1080.0, e + my + 1) / 2) * 2 AS INTEGER) AS y1 FROM m)
SELECT *, round(least(1.0, 1280 / greatest(x1 - x0, y1 - y0)), 6) AS scale FROM o""")
def work_crop(spark, d):
    k, n = F.col("k"), F.col("event_id")
    boxes = of(spark, d, "view").select("user_id", (k * 10).alias("x0"), (k * 5).alias("y0"), (k * 10 + n % 200).alias("x1"), (k * 5 + n % 100).alias("y1"))
    return M.work_crop(boxes, USER, 1920, 1080).withColumn("scale", F.round("scale", 6))


KIND = "CASE WHEN k % 11 = 0 THEN 'scroll' WHEN k % 3 = 0 THEN 'instant' ELSE 'move' END"


@query(f"WITH {EV}, e AS (SELECT *, {KIND} AS kind FROM ev) SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind = 'scroll' DESC, value DESC, event_id) AS r FROM e WHERE kind <> 'instant') WHERE r = 1")
def main_element(spark, d):
    rows = events(spark, d).select("user_id", F.expr(KIND).alias("kind"), F.col("value").alias("area"), F.col("event_id").alias("n"))
    return M.main_element(rows, USER).select("user_id", F.col("n").alias("event_id"))


@query(f"""WITH {EV}, m AS (SELECT event_id, value / 50 AS travel, k / 2000.0 AS scale, k / 40.0 AS edge, k / 100.0 AS turn, value / 60 AS corner, k % 10 / 20.0 AS fade, k % 8 / 10.0 AS rest FROM ev),
l AS (SELECT *, array_to_string(list_filter([CASE WHEN travel >= 1 THEN 'translate' END, CASE WHEN scale >= 0.01 AND edge >= 1 THEN 'scale' END, CASE WHEN turn >= 0.5 AND corner >= 1 THEN 'rotate' END, CASE WHEN fade >= 0.1 THEN 'opacity' END], lambda x: x IS NOT NULL), '+') AS kinds FROM m)
SELECT event_id, CASE WHEN kinds <> '' THEN kinds WHEN rest < 0.25 THEN 'colour' ELSE 'energy' END AS kinds FROM l""")
def channel_kinds(spark, d):
    k, v = F.col("k"), F.col("value")
    kinds = M.channel_kind(v / 50, k / 2000, k / 40, k / 100, v / 60, k % 10 / 20, k % 8 / 10)
    return events(spark, d).select("event_id", F.array_join(kinds, "+").alias("kinds"))


PROGRESS = f"""{FRAMES}, pr AS (SELECT user_id, frame // 8 AS part, t_us, sum(energy) OVER (PARTITION BY user_id, frame // 8 ORDER BY frame ROWS UNBOUNDED PRECEDING) / sum(energy) OVER (PARTITION BY user_id, frame // 8) AS p FROM fr)"""


def progress_of(spark, d):
    rows = frames_of(spark, d).withColumn("part", F.floor(F.col("frame") / 8))
    w = Window.partitionBy("user_id", "part")
    return rows.select("user_id", "part", "t_us", M.share(F.sum("energy").over(w.orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)), F.sum("energy").over(w)).alias("p"))


@query(f"""WITH {EV}, {PROGRESS}, g AS (SELECT user_id, part, max(t_us) FILTER (p <= 0.02) AS l0, max(t_us) FILTER (p <= 0.1) AS l1, min(t_us) FILTER (p >= 0.98) AS h0, min(t_us) FILTER (p >= 0.9) AS h1 FROM pr GROUP BY ALL)
SELECT user_id, part, coalesce(h0 - l0 <= {24 * HOUR} OR h1 - l1 <= {12 * HOUR}, false) AS instant FROM g""")
def instant_changes(spark, d):
    return M.instant(progress_of(spark, d), ["user_id", "part"], "t_us", "p", F.lit(12 * HOUR))


@query(f"""WITH {EV}, {PROGRESS} SELECT DISTINCT user_id, part, t_us FROM (SELECT user_id, part, g, min(t_us) AS t_us FROM pr JOIN (SELECT (i + 0.5::DOUBLE) / 5 AS g FROM range(5) t(i)) ON p >= g GROUP BY ALL)""")
def progress_picks(spark, d):
    return M.progress_picks(progress_of(spark, d), ["user_id", "part"], "t_us", "p", 5)


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k % 13 = 0 OR k % 4 = 0 THEN 'low' WHEN k / 100.0 >= 0.8 AND value / 10000 < 0.01 AND value <= 0.2 * (k * 4) THEN 'high' ELSE 'medium' END AS confidence FROM ev""")
def confidence(spark, d):
    k, v = F.col("k"), F.col("value")
    got = M.confidence(k / F.lit(100.0), v / 10000, F.lit(0.0), v, k * 4, k % 4 != 0, k % 13 == 0)
    return events(spark, d).select("event_id", got.alias("confidence"))


@query(f"""WITH {EV}, r AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS step FROM ev WHERE k % 4 <> 0) SELECT user_id, median(step) AS period_us, round(median(value), 6) AS travel, arg_min(event_id, struct_pack(a := t_us, b := event_id)) AS lead, count(*) AS members FROM r GROUP BY user_id""")
def repeat_summary(spark, d):
    rows = events(spark, d).select("user_id", F.col("event_id").alias("n"), F.col("t_us").alias("start_us"), F.col("value").alias("travel"), (F.col("k") % 4 != 0).alias("inlier"))
    return M.repeat_summary(rows, USER).withColumn("travel", F.round("travel", 6))


@query(f"""WITH {EV}, s AS (SELECT *, value - 50 AS step, k / 100.0 AS response, sum(value - 50) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS pos, (t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us)) / 1e6 AS dt FROM ev)
SELECT user_id, round(arg_max(pos, t_us) - arg_min(pos, t_us), 4) AS travel, round(max(abs(step) / dt) FILTER (response >= 0.3), 6) AS peak_speed, min(response) FILTER (abs(step) >= 0.5) AS least_response, round(avg(CASE WHEN response < 0.3 THEN 1.0 ELSE 0.0 END) FILTER (abs(step) >= 0.5), 6) AS unreliable FROM s GROUP BY user_id""")
def scroll_block(spark, d):
    step = F.col("value") - 50
    pos = F.sum(step).over(Window.partitionBy("user_id").orderBy("t_us").rowsBetween(Window.unboundedPreceding, 0))
    rows = events(spark, d).select("user_id", "t_us", step.alias("step"), pos.alias("pos"), (F.col("k") / F.lit(100.0)).alias("response"))
    got = M.scroll_block(rows, USER, "t_us", "pos", "step", "response")
    return got.select("user_id", F.round("travel", 4).alias("travel"), F.round("peak_speed", 6).alias("peak_speed"), "least_response", F.round("unreliable", 6).alias("unreliable"))


@query(f"""WITH {EV}, {FRAMES}, a AS (SELECT * FROM fr WHERE frame % 10 <> 3), b AS (SELECT user_id, frame, t_us + frame % 5 * 40 AS t_us FROM fr WHERE frame % 11 <> 4)
SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) FILTER (a.t_us IS NULL OR b.t_us IS NULL OR abs(a.t_us - b.t_us) > 100) AS bad, count(*) AS frames FROM a FULL JOIN b ON a.user_id = b.user_id AND a.frame = b.frame GROUP BY 1""")
def time_check(spark, d):
    rows = frames_of(spark, d).withColumnRenamed("frame", "frame_index")
    late = rows.where("frame_index % 11 <> 4").withColumn("t_us", F.col("t_us") + F.col("frame_index") % 5 * 40)
    return M.time_check(rows.where("frame_index % 10 <> 3"), late, USER)


@query(f"""WITH {EV} SELECT event_id, (row_number() OVER w - 1) // 16 AS sheet, (row_number() OVER w - 1) % 16 AS cell FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)""")
def sheet_cells(spark, d):
    got = M.sheets(events(spark, d), USER, ["t_us", "event_id"])
    return got.select("event_id", F.col("sheet").cast("bigint").alias("sheet"), F.col("cell").cast("bigint").alias("cell"))


# Views


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 ELSE least(30, 6 + CAST(floor(2 * (o_totalprice / 20) / 600) AS BIGINT)) END AS scenes FROM orders")
def scene_limit(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.scene_limit(F.col("o_totalprice") / 20, F.col("o_custkey") % 4).cast("bigint").alias("scenes"))


@query(f"""WITH {EV}, {span_sql('tx', 'click', 30)}, {span_sql('sp', 'view', 40)}, j AS (SELECT tx.event_id AS text_id, sp.event_id AS span_id, least(tx.end_us, sp.end_us) - greatest(tx.start_us, sp.start_us) AS shown_us, tx.end_us - tx.start_us AS n FROM tx JOIN sp ON sp.user_id = tx.user_id AND tx.start_us < sp.end_us AND sp.start_us < tx.end_us)
SELECT text_id, span_id, shown_us FROM j WHERE shown_us >= least({HOUR}, n / 2)""")
def text_in_span(spark, d):
    cut = lambda kind, m: spans_of(spark, d, kind, m).select("user_id", "event_id", "start_us", "end_us")
    got = V.text_in_span(cut("click", 30), cut("view", 40), USER, 12 * HOUR, HOUR)
    return got.select(F.col("event_id").alias("text_id"), F.col("s_event_id").alias("span_id"), "shown_us")


@query(f"WITH {EV} SELECT user_id, arg_min(event_type, struct_pack(a := k, b := event_id)) AS source FROM ev WHERE value < 40 GROUP BY user_id")
def first_source(spark, d):
    rows = events(spark, d).select("user_id", "event_type", F.struct("k", "event_id").alias("priority"), (F.col("value") >= 40).alias("failed"))
    return V.first_source(rows, USER, "event_type", "priority", "failed")


@query(f"WITH {EV} SELECT DISTINCT user_id, k FROM ev a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM ev b WHERE b.user_id = a.user_id AND b.k = a.k AND b.event_type <> 'view' AND b.value < 40)")
def resume_plan(spark, d):
    done = events(spark, d).where("event_type <> 'view'").select("user_id", "k", (F.col("value") >= 40).alias("failed"))
    return V.resume_plan(of(spark, d, "view").select("user_id", "k").distinct(), done, ["user_id", "k"], "failed")


@query(f"""WITH {EV}, a AS (SELECT user_id, k FROM ev WHERE event_type = 'view'), b AS (SELECT user_id, k FROM ev WHERE event_type = 'click') SELECT user_id, k FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def stale_rows(spark, d):
    return V.stale(of(spark, d, "view").select("user_id", "k"), of(spark, d, "click").select("user_id", "k"))


@query("SELECT page_id, octet_length(encode(html)) AS bytes FROM pages WHERE page_id % 97 < 30 AND page_id % 5 <> 0")
def age_purge(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("bytes"), (F.col("page_id") % 97).alias("used"), (F.col("page_id") % 5 != 0).alias("free"))
    return V.expired(rows, "used", "free", 30).select("page_id", "bytes")


@query("""WITH l AS (SELECT lang, count(*) AS entries, sum(octet_length(encode(text))) AS bytes, max(doc_id) AS used FROM documents GROUP BY lang) SELECT lang, entries, CAST(bytes AS BIGINT) AS bytes, used FROM l""")
def cache_listing(spark, d):
    rows = table(spark, d, "documents").withColumn("bytes", F.octet_length("text"))
    return V.listing(rows, ["lang"], "bytes", "doc_id")


# Scores


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, list(struct_pack(i := j, id := event_id, t := t_us / 1e6) ORDER BY j) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us / 1e6, event_id) AS j FROM ev WHERE event_type = 'error') GROUP BY user_id),
o AS (SELECT c.user_id, c.event_id, c.t_us / 1e6 AS t, coalesce(r.r, []) AS r, row_number() OVER (PARTITION BY c.user_id ORDER BY c.t_us / 1e6, c.event_id) AS i FROM ev c LEFT JOIN r ON r.user_id = c.user_id WHERE c.event_type = 'signup'),
z AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST([] AS BIGINT[]) AS used FROM o WHERE i = 1 UNION ALL SELECT user_id, i, event_id, hit.id, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.i) END FROM
(SELECT o.user_id, o.i, o.event_id, z.used, list_sort(list_transform(list_filter(o.r, lambda x: abs(x.t - o.t) <= 86400 AND NOT list_contains(z.used, x.i)), lambda x: struct_pack(d := abs(x.t - o.t), i := x.i, id := x.id)))[1] AS hit FROM z JOIN o ON o.user_id = z.user_id AND o.i = z.i + 1) y)
SELECT user_id, a AS truth_key, b AS answer_key FROM z WHERE b IS NOT NULL""")
def match_by_time(spark, d):
    side = lambda kind: of(spark, d, kind).select("user_id", F.col("event_id").alias("key"), (F.col("t_us") / 1e6).alias("start_s"))
    return R.match_by_time(side("signup"), side("error"), USER, 86400)


@query(f"""WITH {EV}, t AS (SELECT user_id, event_id AS key, t_us / 1e6 AS s, t_us / 1e6 + k AS e FROM ev WHERE event_type = 'signup'), a AS (SELECT user_id, t_us / 1e6 + event_id % 3 * 0.1 AS s, t_us / 1e6 + k + event_id % 5 * 0.05 AS e FROM ev WHERE event_type = 'signup')
SELECT t.key, bool_or(coalesce(abs(t.s - a.s) <= 0.15 AND abs(t.e - a.e) <= 0.15, false)) AS found FROM t LEFT JOIN a ON a.user_id = t.user_id AND abs(a.s - t.s) < 2 GROUP BY t.key""")
def sentence_times(spark, d):
    at = F.col("t_us") / 1e6
    truth = of(spark, d, "signup").select("user_id", F.col("event_id").alias("key"), at.alias("start_s"), (at + F.col("k")).alias("end_s"))
    answers = of(spark, d, "signup").select("user_id", (at + F.col("event_id") % 3 * 0.1).alias("start_s"), (at + F.col("k") + F.col("event_id") % 5 * 0.05).alias("end_s"))
    return R.sentence_times(truth, answers, USER).select("key", "found")


@query(f"WITH {EV}, s AS (SELECT user_id, event_type, t_us - lag(t_us) OVER (PARTITION BY user_id, event_type ORDER BY t_us) AS step FROM ev) SELECT user_id, event_type, count(*) AS n, median(step) AS period FROM s GROUP BY ALL")
def repeat_steps(spark, d):
    rows = events(spark, d).select("user_id", "event_type", F.col("t_us").alias("start_s"))
    return R.repeats(rows, ["user_id", "event_type"]).withColumnRenamed("period_s", "period")


@query(f"WITH {EV} SELECT user_id, round(greatest(0.0, sum(k / 100.0) - max(k % 4)) / count(*), 6) AS score FROM ev GROUP BY user_id")
def run_scores(spark, d):
    rows = events(spark, d).withColumn("point", F.col("k") / F.lit(100.0))
    return R.run_score(rows, USER, "point", F.col("k") % 4).withColumn("score", F.round("score", 6))


@query("""SELECT doc_id, (CASE WHEN regexp_matches(text, '(?i)tion|ment') THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?i)schaft') THEN 1.0 ELSE 0.0 END + CASE WHEN regexp_matches(text, '(?i)eau|eux') THEN 1.0 ELSE 0.0 END) / 3 AS share FROM documents""")
def gist_share(spark, d):
    return table(spark, d, "documents").select("doc_id", R.gist("text", [["tion", "ment"], ["schaft"], ["eau", "eux"]]).alias("share"))


NORM = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""WITH t AS (SELECT item_id % 4 AS slide, item_id AS key, left(text, 40) AS text FROM benchmark), a AS (SELECT item_id % 4 AS slide, CASE WHEN item_id % 3 = 0 THEN left(text, 60) WHEN item_id % 3 = 1 THEN left(text, 38) ELSE 'nothing' END AS text FROM benchmark)
SELECT key, max(CASE WHEN contains({NORM.format('a.text')}, {NORM.format('t.text')}) THEN 1.0 WHEN levenshtein({NORM.format('a.text')}, {NORM.format('t.text')}) / greatest(1, length({NORM.format('t.text')})) <= 0.1 THEN 0.5 ELSE 0.0 END) AS points FROM t LEFT JOIN a USING (slide) GROUP BY key""")
def text_points(spark, d):
    rows = table(spark, d, "benchmark").withColumn("slide", F.col("item_id") % 4)
    answers = rows.select("slide", F.when(F.col("item_id") % 3 == 0, F.left("text", F.lit(60))).when(F.col("item_id") % 3 == 1, F.left("text", F.lit(38))).otherwise("nothing").alias("text"))
    return R.text_present(rows.select("slide", F.col("item_id").alias("key"), F.left("text", F.lit(40)).alias("text")), answers, ["slide"], 0.1).select("key", "points")


# Pictures and sound: an embedding is a frame of 8 x 8 grey pixels of its label's video, or 64 samples of its sound.

PIXELS = "px AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, list_transform(embedding, lambda x: CAST(floor(least(255, greatest(0, (CAST(x AS DOUBLE) + 0.5) * 255))) AS BIGINT)) AS p FROM embeddings), fp AS (SELECT *, lag(p) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM px)"


def pixel_frames(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("video_id"), F.col("embedding").cast("array<double>").alias("e"))
    byte = F.transform("e", lambda x: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (x + 0.5) * 255))).cast("int"))
    index = (F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1).cast("bigint")
    pixels = F.unhex(F.array_join(F.transform(byte, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return rows.select("vec_id", "video_id", index.alias("frame_index"), (index * 40_000).alias("t_us"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("channels"), pixels.alias("pixels"))


def named(spark, d, got):
    return got.join(pixel_frames(spark, d).select("vec_id", "video_id", "frame_index"), ["video_id", "frame_index"])


@query(f"""WITH {PIXELS}, df AS (SELECT vec_id, CASE WHEN q IS NULL THEN list_transform(p, lambda x: 0) ELSE list_transform(range(1, 65), lambda j: abs(p[j] - q[j])) END AS df FROM fp)
SELECT vec_id, CAST(len(list_filter(df, lambda x: x > 20)) AS INTEGER) AS changed, CAST(list_max(df) AS INTEGER) AS maxd, CAST(coalesce(list_sum(list_filter(df, lambda x: x > 20)), 0) AS DOUBLE) AS energy FROM df""")
def motion_rows(spark, d):
    return named(spark, d, K.motion_features(pixel_frames(spark, d), 20)).select("vec_id", "changed", "maxd", "energy")


def blur_matrix(n: int = 8, sigma: float = 1.2, radius: int = 2) -> np.ndarray:
    """The blur of a line of ``n`` pixels as a matrix, mirrored at the ends."""
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    m = np.zeros((n, n))
    for i in range(n):
        for o, w in zip(range(-radius, radius + 1), k / k.sum()):
            j = abs(i + o)
            m[i, j if j < n else 2 * (n - 1) - j] += w
    return m


BLUR = "bm(i, k, w) AS (VALUES " + ", ".join(f"({i}, {k}, {w!r}::DOUBLE)" for i, row in enumerate(blur_matrix().tolist()) for k, w in enumerate(row) if w) + ")"


@query(f"""WITH {PIXELS}, {BLUR}, u AS (SELECT vec_id, label, unnest(range(64)) AS n, unnest(p) AS v FROM px), a AS (SELECT vec_id, label, bm.i AS r, n % 8 AS c, sum(w * v) AS v FROM u JOIN bm ON bm.k = n // 8 GROUP BY ALL),
b AS (SELECT vec_id, label, r, bm.i AS c, sum(w * v) AS v FROM a JOIN bm ON bm.k = a.c GROUP BY ALL), l AS (SELECT *, v - lag(v) OVER (PARTITION BY label, r, c ORDER BY vec_id) AS dv FROM b)
SELECT vec_id, round(avg(CASE WHEN abs(dv) > 20 THEN 1.0 ELSE 0.0 END), 6) AS frac, round(coalesce(avg(abs(dv)), 0), 6) AS mad FROM l GROUP BY vec_id""")
def frame_features(spark, d):
    got = named(spark, d, K.frame_features(pixel_frames(spark, d), 20))
    return got.select("vec_id", F.round("frac", 6).alias("frac"), F.round("mad", 6).alias("mad"))


@query(f"""WITH {PIXELS}, u AS (SELECT label, i, unnest(range(64)) AS pixel, unnest(list_transform(range(1, 65), lambda j: abs(p[j] - q[j]))) AS v FROM fp WHERE q IS NOT NULL) SELECT label, pixel, round(sum(v * i * 40000) / sum(v), 4) AS t_us FROM u GROUP BY ALL HAVING sum(v) > 0""")
def time_centroids(spark, d):
    got = K.time_centroids(pixel_frames(spark, d))
    return got.select(F.col("video_id").cast("int").alias("label"), F.col("pixel").cast("bigint").alias("pixel"), F.round("t_us", 4).alias("t_us"))


@query(f"WITH {PIXELS} SELECT vec_id, list_aggregate(p, 'quantile_cont', 0.95) < 190 AS dark FROM px")
def near_black(spark, d):
    return K.dark_frames(pixel_frames(spark, d), 190).join(pixel_frames(spark, d).select("vec_id", "video_id", "frame_index"), ["video_id", "frame_index"]).select("vec_id", "dark")


@query("""WITH o AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, lag(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
s AS (SELECT *, vec_id % 3 / 10.0 AS x, vec_id % 5 / 10.0 AS y FROM o WHERE b IS NOT NULL), g AS (SELECT vec_id, list_filter(range(64), lambda i: i % 8 >= floor(x * 8) AND i % 8 < ceil((x + 0.5) * 8) AND i // 8 >= floor(y * 8) AND i // 8 < ceil((y + 0.4) * 8)) AS inside, a, b FROM s)
SELECT vec_id, round(len(list_filter(inside, lambda i: abs(a[i + 1] - b[i + 1]) > 0.1)) / len(inside), 4) AS ink FROM g""")
def ink_change(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))
    rows = rows.withColumn("b", F.lag("a").over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    box = (F.col("vec_id") % 3 / F.lit(10.0), F.col("vec_id") % 5 / F.lit(10.0), F.lit(0.5), F.lit(0.4))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), C.ink_change(F.col("a"), F.col("b"), 8, 8, box, 0.1).alias("ink"))


SOUND = "sd AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS s0, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings)"


def sound_rows(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return rows.select(F.col("label").cast("string").alias("video_id"), n.cast("bigint").alias("chunk"), (n * 64).cast("bigint").alias("start_sample"), "samples")


@query(f"WITH {SOUND}, u AS (SELECT label, s0 + unnest(range(64)) AS n, unnest(s) AS x FROM sd) SELECT label, n // 24 AS hop, round(sum(x * x), 9) AS energy, count(*) AS n FROM u GROUP BY label, n // 24")
def hop_energies(spark, d):
    got = K.hop_energy(sound_rows(spark, d), 24)
    return got.select(F.col("video_id").cast("int").alias("label"), F.col("hop").cast("bigint").alias("hop"), F.round("energy", 9).alias("energy"), F.col("n").cast("bigint").alias("n"))


@query(f"""WITH {SOUND}, u AS (SELECT label, s0 + unnest(range(64)) AS n, unnest(s) AS x FROM sd), m AS (SELECT label, max(n) + 1 AS size FROM u GROUP BY label), f AS (SELECT m.label, i FROM m, range(0, 10000) t(i) WHERE i * 8 + 32 <= size),
w AS (SELECT f.label, f.i, k, sqrt(pow(sum(x * h * cos(2 * pi() * k * j / 32)), 2) + pow(sum(x * h * sin(2 * pi() * k * j / 32)), 2)) AS a FROM f JOIN (SELECT j, 0.5 - 0.5 * cos(2 * pi() * j / 31) AS h FROM range(32) t(j)) j ON true JOIN u ON u.label = f.label AND u.n = f.i * 8 + j.j JOIN range(17) t(k) ON true GROUP BY ALL),
s AS (SELECT *, ln(1 + 100 * a) AS v, ln(1 + 100 * a) - lag(ln(1 + 100 * a)) OVER (PARTITION BY label, k ORDER BY i) AS dv FROM w)
SELECT label, i AS frame, round(sum(greatest(coalesce(dv, 0), 0)), 5) AS flux FROM s GROUP BY ALL""")
def spectral_flux(spark, d):
    got = K.flux(sound_rows(spark, d), 32, 8)
    return got.select(F.col("video_id").cast("int").alias("label"), "frame", F.round("flux", 5).alias("flux"))


# Scalars


@query(r"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN (o_custkey % 50) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') WHEN 1 THEN '1:02:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '.5' WHEN 2 THEN CAST(o_custkey AS VARCHAR) WHEN 3 THEN '-5' WHEN 4 THEN 'x:10' ELSE o_custkey || '.25' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(s, '([0-9]+:)?[0-9]{1,2}:[0-9]{1,2}(\.[0-9]+)?') THEN TRY_CAST(split_part(s, ':', -1) AS DOUBLE) + 60 * TRY_CAST(split_part(s, ':', -2) AS DOUBLE) + 3600 * coalesce(TRY_CAST(nullif(split_part(s, ':', -3), '') AS DOUBLE), 0) WHEN regexp_full_match(s, '[0-9]+(\.[0-9]+)?') THEN TRY_CAST(s AS DOUBLE) END AS seconds FROM t""")
def parse_times(spark, d):
    two = F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat((F.col("o_custkey") % 50).cast("string"), F.lit(":"), two)).when(k == 1, F.concat(F.lit("1:02:"), two, F.lit(".5"))).when(k == 2, F.col("o_custkey").cast("string")).when(k == 3, "-5").when(k == 4, "x:10").otherwise(F.concat(F.col("o_custkey"), F.lit(".25")))
    return table(spark, d, "orders").select("o_orderkey", C.parse_time(text).alias("seconds"))


@query(r"""WITH n AS (SELECT l_orderkey, l_linenumber, printf('%.3f', (l_quantity - 25) / 8) AS t FROM lineitem), z AS (SELECT *, regexp_replace(regexp_replace(t, '(\.[0-9]*?)0+$', '\1'), '\.$', '') AS s FROM n) SELECT l_orderkey, l_linenumber, CASE WHEN s = '-0' THEN '0' ELSE s END AS css FROM z""")
def css_numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.css_number((F.col("l_quantity") - 25) / 8).alias("css"))


URLS = """CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=abc_DEF-' || page_id || '&list=x' WHEN 1 THEN 'https://youtu.be/zyx987' || page_id WHEN 2 THEN 'https://m.youtube.com/shorts/qwerty' || page_id || '?f=1' WHEN 3 THEN 'https://music.youtube.com/embed/longid' || page_id ELSE 'https://example.com/watch?v=abcdefg' END"""


@query(rf"""WITH u AS (SELECT page_id, {URLS} AS u FROM pages), i AS (SELECT page_id, CASE page_id % 5 WHEN 4 THEN NULL WHEN 0 THEN regexp_extract(u, 'v=([^&]+)', 1) ELSE regexp_extract(u, '/([\w-]+)(\?.*)?$', 1) END AS id FROM u)
SELECT page_id, id, CASE WHEN id IS NOT NULL THEN 'https://www.youtube.com/watch?v=' || id || '&t=' || CAST(floor(page_id * 1.5) AS BIGINT) || 's' END AS link FROM i""")
def video_links(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.expr(URLS).alias("u"))
    return rows.select("page_id", C.youtube_id(F.col("u")).alias("id"), C.deep_link(F.col("u"), F.col("page_id") * F.lit(1.5)).alias("link"))


@query(r"""SELECT p_partkey, regexp_replace(p_name || ' *' || p_type || '*_(' || p_size || ')', '([\\`*_{}\[\]()#+!|<>-])', '\\\1', 'g') AS md, CASE WHEN length(p_name || p_type) <= 20 THEN p_name || p_type ELSE rtrim(left(p_name || p_type, 17)) || '...' END AS clip FROM part""")
def escape_and_clip(spark, d):
    name = F.concat("p_name", F.lit(" *"), "p_type", F.lit("*_("), "p_size", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", C.escape_markdown(name).alias("md"), C.clip(F.concat("p_name", "p_type"), 20).alias("clip"))


@query("SELECT l_orderkey, round(10 * log10(sum(l_quantity * l_quantity) / count(*) + 1e-12), 6) AS db FROM lineitem GROUP BY l_orderkey")
def decibels(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("e"), F.count("*").alias("n"))
    return rows.select("l_orderkey", F.round(C.decibel(F.col("e"), F.col("n")), 6).alias("db"))


ANCHORS = [(0, 0, 60, 60), (40, 10, 90, 70), (20, 30, 120, 50)]


@query("WITH b AS (SELECT p_partkey, p_partkey % 97 AS x0, p_size AS y0, p_partkey % 97 + 10 + p_size AS x1, p_size + 20 AS y1 FROM part), an(u0, v0, u1, v1) AS (VALUES " + ", ".join(map(str, ANCHORS)) + "), i AS (SELECT *, greatest(least(x1, u1) - greatest(x0, u0), 0) * greatest(least(y1, v1) - greatest(y0, v0), 0) AS m FROM b, an) SELECT p_partkey, bool_or(m / ((x1 - x0) * (y1 - y0) + (u1 - u0) * (v1 - v0) - m) >= 0.25) AS hit, min(floor(x0 / 2) * 2) AS left, min(least(100, floor((x1 + 1) / 2) * 2)) AS right FROM i GROUP BY p_partkey")
def iou_any(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    box = F.struct((k % 97).alias("x0"), s.alias("y0"), (k % 97 + 10 + s).alias("x1"), (s + 20).alias("y1"))
    anchors = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(a, ("x0", "y0", "x1", "y1")))) for a in ANCHORS))
    even = C.clip_even(box, 100, 100)
    return table(spark, d, "part").select("p_partkey", C.iou_any(box, anchors, 0.25).alias("hit"), even["x0"].cast("double").alias("left"), even["x1"].cast("double").alias("right"))


LAB = "CASE WHEN {0} > 0.04045 THEN pow(({0} + 0.055) / 1.055, 2.4) ELSE {0} / 12.92 END"
ROOT = "CASE WHEN {0} > 0.008856451679035631 THEN pow({0}, 1.0 / 3) ELSE {0} * 7.787037037037037 + 16.0 / 116 END"


@query(f"""WITH c AS (SELECT p_partkey, 1 AS side, p_partkey % 256 / 255.0::DOUBLE AS r, p_partkey * 7 % 256 / 255.0::DOUBLE AS g, p_size * 5 / 255.0::DOUBLE AS b FROM part UNION ALL SELECT p_partkey, 2, p_partkey * 3 % 256 / 255.0::DOUBLE, p_size * 4 / 255.0::DOUBLE, p_partkey * 11 % 256 / 255.0::DOUBLE FROM part),
l AS (SELECT p_partkey, side, {LAB.format('r')} AS r, {LAB.format('g')} AS g, {LAB.format('b')} AS b FROM c), x AS (SELECT p_partkey, side, (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b AS y, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883 AS z FROM l),
f AS (SELECT p_partkey, side, {ROOT.format('x')} AS x, {ROOT.format('y')} AS y, {ROOT.format('z')} AS z FROM x), q AS (SELECT p_partkey, side, 116 * y - 16 AS l, 500 * (x - y) AS a, 200 * (y - z) AS b FROM f)
SELECT p.p_partkey, round(sqrt(pow(p.l - q.l, 2) + pow(p.a - q.a, 2) + pow(p.b - q.b, 2)), 5) AS delta FROM q p JOIN q ON p.p_partkey = q.p_partkey AND p.side = 1 AND q.side = 2""")
def colour_difference(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    rgb = lambda *v: F.struct(*((x % 256).alias(n) for x, n in zip(v, "rgb")))
    return table(spark, d, "part").select("p_partkey", F.round(C.colour_difference(rgb(k, k * 7, s * 5), rgb(k * 3, s * 4, k * 11)), 5).alias("delta"))


@query(r"""SELECT conv_id, turn * 2500000 AS start_us, turn * 2500000 + 1700000 AS end_us, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''""")
def subtitle_cues(spark, d):
    """Turns written as SubRip text by conversation, and read again."""
    cues = table(spark, d, "conversations").select("conv_id", (F.col("turn") * 2_500_000).alias("start_us"), (F.col("turn") * 2_500_000 + 1_700_000).alias("end_us"), "text")
    files = sinks.srt(cues, ["conv_id"])
    return T.subtitles(files, "conv_id", "value").select("conv_id", "start_us", "end_us", F.length("text").cast("bigint").alias("n"))


@query(f"""WITH {EV}, c AS (SELECT user_id, t_us / 1e6 AS s, t_us / 1e6 + k * 60 AS e, event_id FROM ev WHERE event_type = 'view') SELECT event_id, round(greatest(s, 1704326400), 3) AS start_s, round(least(e, 1705000000), 3) AS end_s FROM c WHERE least(e, 1705000000) > greatest(s, 1704326400)""")
def chapter_spans(spark, d):
    from ..sources import side

    rows = of(spark, d, "view").select(F.col("user_id").alias("id"), F.struct((F.col("t_us") / 1e6).alias("start_time"), (F.col("t_us") / 1e6 + F.col("k") * 60).alias("end_time"), F.col("event_id").cast("string").alias("title")).alias("c"))
    infos = rows.groupBy("id").agg(F.collect_list("c").alias("chapters"))
    return side.chapters(infos, 1704326400.0, 1705000000.0).select(F.col("title").cast("bigint").alias("event_id"), F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"))
