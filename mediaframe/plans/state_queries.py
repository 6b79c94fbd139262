"""Queries of screen states, speech filters, event notes and choices, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import series as S
from ..operators import states as X
from ..operators import text as T
from .base import EV, HOUR, MIN, events, table

QUERIES, SQL = {}, {}
USER = ["user_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def of(spark, d, kind: str):
    return events(spark, d).where(F.col("event_type") == kind)


def spans_of(spark, d, kind: str, minutes: int):
    """Events of a kind as spans of k * ``minutes``."""
    return of(spark, d, kind).select("user_id", "event_id", F.col("t_us").alias("start_us"), (F.col("t_us") + F.col("k") * minutes * MIN).alias("end_us"), "k", "value")


def span_sql(name: str, kind: str, minutes: int) -> str:
    return f"{name} AS (SELECT user_id, event_id, t_us AS start_us, t_us + k * {minutes * MIN} AS end_us, k, value FROM ev WHERE event_type = '{kind}')"


def merged_sql(name: str, source: str) -> str:
    """Overlapping or touching spans of ``source`` as one, per user."""
    return f"""{name}_o AS (SELECT user_id, start_us, end_us, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM {source}),
{name}_g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM {name}_o),
{name} AS (SELECT user_id, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_g GROUP BY user_id, g)"""


@query(f"""WITH {EV}, kf AS (SELECT event_id, user_id, t_us, k % 3 <> 0 AS settled, t_us - k * {MIN} AS s, k * {10 * MIN} AS h FROM ev WHERE event_type = 'view'), ch AS (SELECT user_id, t_us FROM ev WHERE event_type = 'click'),
b AS (SELECT kf.*, (SELECT max(c.t_us) FROM ch c WHERE c.user_id = kf.user_id AND c.t_us <= kf.t_us) AS lc, lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us) AS prev FROM kf),
g AS (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN lc > prev THEN lc ELSE t_us END AS beg FROM b), n AS (SELECT *, lead(beg) OVER (PARTITION BY user_id ORDER BY t_us) AS nx FROM g)
SELECT event_id, CASE WHEN settled THEN least(greatest(s, coalesce(beg, s)), t_us) END AS shown_us, CASE WHEN settled THEN greatest(0, least(s + h, coalesce(nx, s + h)) - greatest(s, coalesce(beg, s))) END AS hold_us FROM n""")
def state_holds(spark, d):
    keys = of(spark, d, "view").select("event_id", "user_id", "t_us", (F.col("k") % 3 != 0).alias("settled"), (F.col("t_us") - F.col("k") * MIN).alias("span_us"), (F.col("k") * 10 * MIN).alias("held_us"))
    return X.state_holds(keys, of(spark, d, "click").select("user_id", "t_us"), USER).select("event_id", "shown_us", "hold_us")


@query(f"""WITH {EV}, e AS (SELECT user_id, max(t_us) + {HOUR} AS stop FROM ev GROUP BY user_id), ch AS (SELECT user_id, t_us, coalesce(lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us), stop) AS u FROM ev JOIN e USING (user_id) WHERE event_type = 'click'),
f AS (SELECT ch.*, (SELECT min(x.t_us) FROM ev x WHERE x.user_id = ch.user_id AND x.event_type = 'purchase' AND x.k >= 24 AND x.t_us > ch.t_us AND x.t_us < ch.u) AS ct FROM ch WHERE u - t_us >= {12 * HOUR} AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.user_id = ch.user_id AND x.event_type = 'view' AND x.t_us > ch.t_us AND x.t_us < ch.u)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY u - t_us DESC, t_us) AS i FROM f WHERE ct IS NOT NULL)
SELECT r.user_id, c.event_id AS cell, r.t_us AS change_us, r.ct AS t_us FROM r JOIN ev c ON c.user_id = r.user_id AND c.t_us = r.ct AND c.event_type = 'purchase' WHERE i <= 5""")
def detail_candidates(spark, d):
    stop = events(spark, d).groupBy("user_id").agg((F.max("t_us") + HOUR).alias("stop_us"))
    changes = of(spark, d, "click").select("user_id", "t_us").join(stop, "user_id")
    cells = of(spark, d, "purchase").select("user_id", F.col("event_id").alias("cell"), "t_us", (F.col("k") * 30 * MIN).alias("hold_us"))
    return X.detail_candidates(changes, of(spark, d, "view").select("user_id", "t_us"), cells, USER, "stop_us", 12 * HOUR, 5)


TEXTS = f"tx AS (SELECT event_id, user_id, k, t_us AS first_us, t_us + k * {MIN} AS last_us, t_us + k * {MIN} + {HOUR} AS end_us FROM ev WHERE event_type = 'signup')"


@query(f"""WITH {EV}, {TEXTS}, kf AS (SELECT user_id, t_us, min(s) AS s FROM (SELECT user_id, first_us AS t_us, first_us - k * {20 * MIN} AS s FROM tx WHERE k % 2 = 0 UNION ALL SELECT user_id, end_us, end_us - k * {2 * MIN} FROM tx WHERE k % 3 = 0) GROUP BY ALL),
j AS (SELECT tx.*, a.s AS fs, b.s AS es, (SELECT max(v.t_us) FROM ev v WHERE v.user_id = tx.user_id AND v.event_type = 'view' AND v.t_us < tx.first_us) AS seen FROM tx LEFT JOIN kf a ON a.user_id = tx.user_id AND a.t_us = tx.first_us LEFT JOIN kf b ON b.user_id = tx.user_id AND b.t_us = tx.end_us)
SELECT event_id, CASE WHEN fs < first_us AND (seen IS NULL OR seen < fs) THEN fs ELSE first_us END AS first_us, CASE WHEN last_us < es AND es < end_us THEN es ELSE end_us END AS end_us FROM j""")
def text_dating(spark, d):
    texts = of(spark, d, "signup").select("event_id", "user_id", "k", F.col("t_us").alias("first_us"), (F.col("t_us") + F.col("k") * MIN).alias("last_us"), (F.col("t_us") + F.col("k") * MIN + HOUR).alias("end_us"))
    a = texts.where("k % 2 = 0").select("user_id", F.col("first_us").alias("t_us"), (F.col("first_us") - F.col("k") * 20 * MIN).alias("shown_us"))
    b = texts.where("k % 3 = 0").select("user_id", F.col("end_us").alias("t_us"), (F.col("end_us") - F.col("k") * 2 * MIN).alias("shown_us"))
    return X.date_texts(texts, a.unionByName(b), of(spark, d, "view").select("user_id", "t_us"), USER).select("event_id", "first_us", "end_us")


@query(f"""WITH {EV}, n AS (SELECT *, coalesce(lead(t_us) OVER (PARTITION BY user_id ORDER BY t_us), t_us) AS nx FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us) AS i FROM n WHERE k % 5 <> 0),
f AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY t_us) <= 3 THEN 0 ELSE 1 END AS nw FROM r WHERE value >= 50), g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS g FROM f),
q AS (SELECT user_id, g, count(*) AS rows, min(t_us) AS start_us, max(nx) AS end_us FROM g GROUP BY ALL)
SELECT user_id, rows, start_us, end_us FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rows DESC, g) AS z FROM q) WHERE z = 1""")
def visual_span(spark, d):
    return X.longest_run(events(spark, d), USER, "t_us", F.col("value") >= 50, F.col("k") % 5 != 0)


@query(f"""WITH {EV}, {span_sql('sg', 'purchase', 10)}, {span_sql('ac', 'view', 8)}, {merged_sql('m', 'ac')},
wd AS (SELECT user_id, event_id, start_us, start_us + k * {4 * MIN} AS end_us FROM sg WHERE event_id % 4 <> 0 UNION ALL SELECT user_id, event_id, start_us + k * {5 * MIN}, start_us + k * {9 * MIN} FROM sg WHERE event_id % 4 <> 0 UNION ALL SELECT user_id, event_id, start_us, end_us FROM sg WHERE event_id % 4 = 0),
h AS (SELECT wd.event_id, sum(least(wd.end_us, m.end_us) - greatest(wd.start_us, m.start_us)) AS h FROM wd JOIN m ON m.user_id = wd.user_id AND wd.start_us < m.end_us AND m.start_us < wd.end_us GROUP BY ALL), z AS (SELECT event_id, sum(end_us - start_us) AS z FROM wd GROUP BY ALL)
SELECT z.event_id FROM z LEFT JOIN h USING (event_id) WHERE CASE WHEN z > 0 THEN coalesce(h, 0) >= 0.5 * z ELSE coalesce(h, 0) > 0 END""")
def audible_segments(spark, d):
    segments = spans_of(spark, d, "purchase", 10)
    spoken = segments.where("event_id % 4 <> 0")
    at = lambda m: F.col("start_us") + F.col("k") * m * MIN
    words = spoken.select("user_id", "event_id", "start_us", at(4).alias("end_us")).unionByName(spoken.select("user_id", "event_id", at(5).alias("start_us"), at(9).alias("end_us")))
    return X.audible(segments, words, spans_of(spark, d, "view", 8), USER, "event_id", 6 * HOUR).select("event_id")


@query(f"""WITH {EV}, {span_sql('ac', 'view', 3)}, {span_sql('sp', 'click', 30)}, {merged_sql('m', 'sp')}, c AS (SELECT ac.event_id, sum(least(ac.end_us, m.end_us) - greatest(ac.start_us, m.start_us)) AS c FROM ac JOIN m ON m.user_id = ac.user_id AND ac.start_us < m.end_us AND m.start_us < ac.end_us GROUP BY ALL)
SELECT event_id, CASE WHEN coalesce(c, 0) >= 0.5 * (end_us - start_us) THEN 'speech' WHEN k >= 50 THEN 'sound' ELSE 'blip' END AS kind FROM ac LEFT JOIN c USING (event_id)""")
def activity_kinds(spark, d):
    activity = spans_of(spark, d, "view", 3).withColumn("kind", F.when(F.col("k") >= 50, "sound").otherwise("blip"))
    return X.label_activity(activity, spans_of(spark, d, "click", 30), USER, "event_id", 6 * HOUR).select("event_id", "kind")


@query(r"""WITH c AS (SELECT conv_id, turn, turn * 10000000 AS start_us, turn * 10000000 + 100000 * length(text) AS end_us, text FROM conversations)
SELECT conv_id, turn, length(text) AS n FROM c WHERE end_us > 15000000 AND start_us < 42000000 AND regexp_matches(text, '[\p{L}\p{N}]')""")
def section_cues(spark, d):
    cues = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 10_000_000).alias("start_us"), (F.col("turn") * 10_000_000 + 100_000 * F.length("text")).alias("end_us"), "text")
    return X.section(cues, 15_000_000, 42_000_000).select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))


KIND = "CASE WHEN value >= 90 THEN 'cut' WHEN value >= 60 THEN 'transition' WHEN value >= 30 THEN 'update' ELSE 'activity' END"


@query(f"""WITH {EV}, mo AS (SELECT event_id, user_id, t_us AS f, t_us + k * {MIN} AS l, k % 10 = 0 AS inst FROM ev WHERE event_type = 'click'), {span_sql('vi', 'view', 10)},
j AS (SELECT mo.*, (SELECT arg_min({KIND}, struct_pack(a := start_us, b := end_us)) FROM vi WHERE vi.user_id = mo.user_id AND vi.start_us <= mo.l AND mo.f < vi.end_us AND vi.start_us < vi.end_us) AS visual FROM mo)
SELECT event_id, visual, coalesce(visual IN ('cut', 'transition') OR (visual IS NOT NULL AND inst), false) AS scene, coalesce(visual IS NOT NULL AND (visual <> 'activity' OR inst), false) AS explained FROM j""")
def scene_changes(spark, d):
    motion = of(spark, d, "click").select("event_id", "user_id", F.col("t_us").alias("first_us"), (F.col("t_us") + F.col("k") * MIN).alias("last_us"), (F.col("k") % 10 == 0).alias("instant"))
    visual = spans_of(spark, d, "view", 10).where("start_us < end_us").withColumn("kind", F.expr(KIND))
    got = X.covering_event(motion, visual, USER, "event_id", 6 * HOUR)
    return got.select("event_id", "visual", X.scene_change(F.col("visual"), F.col("instant")).alias("scene"), F.coalesce(X.explained(F.col("visual"), F.col("instant")), F.lit(False)).alias("explained"))


@query(f"WITH {EV}, {span_sql('e', 'click', 5)} SELECT event_id, EXISTS (SELECT 1 FROM ev v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.t_us >= e.start_us AND v.t_us <= e.end_us + {HOUR}) AS leads FROM e")
def leads_to_keyframe(spark, d):
    keys = of(spark, d, "view").select("user_id", F.col("t_us").alias("shown_us"))
    return X.leads_to_keyframe(spans_of(spark, d, "click", 5), keys, USER, HOUR).select("event_id", "leads")


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 2000 > 120 THEN 'content' WHEN o_orderkey % 7 = 0 OR o_custkey % 100 / 100.0 < 0.2 THEN 'motion' ELSE 'both' END AS mode FROM orders")
def auto_mode(spark, d):
    activity = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 100 / F.lit(100.0))
    return table(spark, d, "orders").select("o_orderkey", X.auto_mode(F.col("o_totalprice") / 2000, activity).alias("mode"))


FRAMES = "fr AS (SELECT user_id, event_id, t_us, value AS energy, row_number() OVER (PARTITION BY user_id ORDER BY t_us) - 1 AS frame FROM ev)"


def frames_of(spark, d):
    return events(spark, d).select("user_id", "event_id", "t_us", F.col("value").alias("energy"), (F.row_number().over(Window.partitionBy("user_id").orderBy("t_us")) - 1).cast("bigint").alias("frame"))


@query(f"""WITH {EV}, {FRAMES}, e AS (SELECT user_id, event_id AS key, frame AS first, least(frame + event_id % 6, max(frame) OVER (PARTITION BY user_id)) AS last FROM fr WHERE frame < 3 OR frame % 7 = 0 OR frame >= (SELECT max(frame) FROM fr f2 WHERE f2.user_id = fr.user_id) - 4),
st AS (SELECT *, lead(t_us) OVER (PARTITION BY user_id ORDER BY frame) - t_us AS step FROM fr), sh AS (SELECT user_id, median(step) AS dt, arg_min(step, frame) AS f0, max(step) AS most, max(frame) AS fin, arg_max(energy, frame) AS le FROM st GROUP BY user_id),
p AS (SELECT e.user_id, e.key, max(energy) AS peak FROM e JOIN fr ON fr.user_id = e.user_id AND frame BETWEEN first AND last GROUP BY ALL)
SELECT e.key, e.first <= 1 AND NOT coalesce(f0 > 1.5 * dt, false) AS cut_start, e.last >= fin AND NOT coalesce(most > 1.5 * dt AND le < 0.05 * peak, false) AS cut_end FROM e JOIN sh USING (user_id) JOIN p USING (user_id, key)""")
def cut_by_range(spark, d):
    frames = frames_of(spark, d)
    last = F.max("frame").over(Window.partitionBy("user_id"))
    rows = frames.withColumn("fin", last).where("frame < 3 or frame % 7 = 0 or frame >= fin - 4")
    cut = rows.select("user_id", F.col("event_id").alias("key"), F.col("frame").alias("first"), F.least(F.col("frame") + F.col("event_id") % 6, F.col("fin")).alias("last"))
    return X.cut_by_range(cut, frames, USER).select("key", "cut_start", "cut_end")


@query(f"""WITH {EV}, {FRAMES}, l AS (SELECT user_id, regr_slope(energy, frame) AS a, regr_intercept(energy, frame) AS b FROM fr GROUP BY user_id) SELECT user_id, round(max(a), 5) AS slope, round(max(abs(energy - a * frame - b)), 5) AS residual FROM fr JOIN l USING (user_id) GROUP BY user_id""")
def line_residual(spark, d):
    return X.line_residual(frames_of(spark, d), USER, "frame", "energy").select("user_id", F.round("slope", 5).alias("slope"), F.round("residual", 5).alias("residual"))


@query(f"""WITH {EV}, c AS (SELECT user_id, event_type, k % 3 AS m, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, event_type, m, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type, m) AS r FROM c) WHERE r = 1""")
def most_common(spark, d):
    return X.most_common(events(spark, d).withColumn("m", F.col("k") % 3), USER, ["event_type", "m"])


@query(f"""WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS i FROM ev) SELECT user_id, count(*) AS n, string_agg(CAST(t_us AS VARCHAR), ',' ORDER BY t_us) FILTER (i <= 20) AS times FROM o GROUP BY user_id""")
def first_times(spark, d):
    got = X.first_times(events(spark, d), USER, "t_us", "event_id")
    return got.select("user_id", "n", F.array_join(F.col("times").cast("array<string>"), ",").alias("times"))


@query(f"""WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1 AND n >= 3) SELECT event_id FROM ev JOIN m USING (user_id, event_type)""")
def loop_group(spark, d):
    return X.loop_group(events(spark, d), USER, "event_id", "event_type").select("event_id")


@query(f"""WITH {EV}, {span_sql('s', 'view', 20)} SELECT user_id, round(sum(end_us - start_us) / {float(30 * 24 * HOUR)}, 3) AS ratio, round(sum(end_us - start_us) / {float(15 * 24 * HOUR)}, 9) AS share FROM s GROUP BY user_id""")
def activity_ratio(spark, d):
    spans = spans_of(spark, d, "view", 20)
    return X.activity_ratio(spans, USER, 0, 30 * 24 * HOUR).join(X.speech_share(spans, USER, 0, 15 * 24 * HOUR), "user_id").withColumn("share", F.round("share", 9))


@query(f"""WITH {EV} SELECT user_id, event_type, arg_max(event_id, struct_pack(a := k, b := -t_us)) AS event_id FROM ev GROUP BY ALL""")
def best_line(spark, d):
    return X.best_line(events(spark, d), ["user_id", "event_type"], "k", "t_us", ["event_id"])


@query(f"""WITH {EV} SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM ev) WHERE rank <= 24""")
def top_peaks(spark, d):
    got = X.top_rows(events(spark, d), ["event_type"], [F.desc("value"), F.col("event_id")], 24)
    return got.select("event_type", "event_id", F.col("rank").cast("bigint").alias("rank"))


WORDS = r"ww AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS word_no, unnest(l) AS word FROM (SELECT conv_id, turn, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS l FROM conversations)), w AS (SELECT * FROM ww WHERE word <> '')"


@query(f"""WITH {WORDS}, s AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.?!。？！…]$') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
g AS (SELECT conv_id, turn, CAST(s AS BIGINT) AS sentence, length(string_agg(word, ' ' ORDER BY word_no)) AS n FROM s GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn ORDER BY sentence ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY conv_id, turn ORDER BY sentence) AS i FROM g)
SELECT conv_id, turn, sentence, n FROM c WHERE i = 1 OR total <= 120""")
def first_sentences(spark, d):
    rows = T.sentences(T.words(table(spark, d, "conversations"), ["conv_id", "turn"], "text"), ["conv_id", "turn"], "word_no", "word")
    return X.first_sentences(rows, ["conv_id", "turn"], "sentence", "text", 120).select("conv_id", "turn", F.col("sentence").cast("bigint").alias("sentence"), F.length("text").cast("bigint").alias("n"))


@query(f"""WITH {EV}, f AS (SELECT user_id, event_type, arg_min(k % 2 = 0, t_us) AS hit FROM ev GROUP BY ALL), c AS (SELECT user_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM f GROUP BY user_id)
SELECT *, CASE WHEN misses = 0 THEN 'hit' WHEN hits = 0 THEN 'miss' ELSE 'partial hit' END AS state FROM c""")
def stage_status(spark, d):
    return X.stage_status(events(spark, d).withColumn("hit", F.col("k") % 2 == 0), USER, "event_type", "t_us", "hit")


@query(f"""WITH {EV}, p AS (SELECT user_id, 1 AS priority, value AS o, 'zoom ' || event_id AS text FROM ev WHERE event_type = 'click' AND value < 10 UNION ALL SELECT user_id, 2, 0.0, 'sheet ' || event_id FROM ev WHERE event_type = 'view' AND k < 5 UNION ALL SELECT user_id, 3, CAST(k AS DOUBLE), 'frame ' || event_id FROM ev WHERE event_type = 'error' AND k < 20)
SELECT user_id, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, o, text) AS rank FROM p) WHERE rank <= 4""")
def next_steps(spark, d):
    part = lambda kind, where, n, order, word: of(spark, d, kind).where(where).select("user_id", F.lit(n).alias("priority"), F.col(order).cast("double").alias("order") if order else F.lit(0.0).alias("order"), F.concat(F.lit(f"{word} "), "event_id").alias("text"))
    parts = [part("click", "value < 10", 1, "value", "zoom"), part("view", "k < 5", 2, None, "sheet"), part("error", "k < 20", 3, "k", "frame")]
    return X.next_steps(parts, USER).select("user_id", F.col("rank").cast("bigint").alias("rank"), "text")


@query(f"""WITH {EV}, l AS (SELECT user_id, list_sort(list(DISTINCT 'M' || k)) AS l FROM ev WHERE event_type = 'view' GROUP BY user_id) SELECT user_id, array_to_string(l[:4], ', ') || CASE WHEN len(l) > 4 THEN ' +' || (len(l) - 4) ELSE '' END AS cell FROM l""")
def listed_names(spark, d):
    rows = of(spark, d, "view").groupBy("user_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("M"), "k"))).alias("l"))
    return rows.select("user_id", X.listed(F.col("l")).alias("cell"))


@query(f"""WITH {EV}, sc AS (SELECT DISTINCT user_id, k FROM ev WHERE event_type = 'view'), cp AS (SELECT user_id, k, max(CASE WHEN trim(repeat('x', CAST(event_id % 4 AS INTEGER))) = '' THEN 0 ELSE 1 END) AS filled FROM ev WHERE event_type <> 'view' GROUP BY ALL)
SELECT coalesce(sc.user_id, cp.user_id) AS user_id, coalesce(sc.k, cp.k) AS k, CASE WHEN sc.k IS NULL THEN 'unknown' ELSE 'missing' END AS problem FROM sc FULL JOIN cp ON cp.user_id = sc.user_id AND cp.k = sc.k WHERE sc.k IS NULL OR coalesce(filled, 0) = 0""")
def caption_problems(spark, d):
    captions = events(spark, d).where("event_type <> 'view'").select("user_id", "k", F.expr("repeat('x', cast(event_id % 4 as int))").alias("caption"))
    return X.caption_problems(of(spark, d, "view"), captions, USER, "k", "caption")


@query(f"""WITH {EV}, g AS (SELECT user_id, count(*) AS n, min(t_us) AS a, max(t_us) AS z FROM ev WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, round(CASE WHEN user_id % 3 = 0 THEN 30000 / 1001 WHEN n >= 2 THEN (n - 1) * 1e6 / (z - a) END, 3) AS fps FROM g""")
def frame_rate(spark, d):
    rows = of(spark, d, "view").groupBy("user_id").agg(F.count("*").alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("z"))
    rate = F.when(F.col("user_id") % 3 == 0, "30000/1001").when(F.col("user_id") % 3 == 1, "0/0")
    return rows.select("user_id", X.average_rate(rate, F.col("n"), F.col("a"), F.col("z")).alias("fps"))


@query(f"""WITH {EV}, {span_sql('s', 'click', 10)} SELECT event_id FROM s WHERE event_id IN (3, 5, 1201, 77777) OR (start_us < 1704412800000000 AND end_us > 1704326400000000) OR (start_us < 1705017600000000 AND end_us > 1705010000000000)""")
def event_selection(spark, d):
    got = X.select_events(spans_of(spark, d, "click", 10), USER, "event_id", [3, 5, 1201, 77777], [(1704326400000000, 1704412800000000), (1705010000000000, 1705017600000000)])
    return got.select("event_id")


@query(f"""WITH {EV}, {span_sql('w', 'signup', 10)} SELECT ev.event_id, min(w.event_id) AS "window" FROM ev JOIN w ON w.user_id = ev.user_id AND ev.t_us BETWEEN w.start_us - 100 AND w.end_us + 100 GROUP BY ALL""")
def frame_windows(spark, d):
    windows = spans_of(spark, d, "signup", 10).select("user_id", F.col("event_id").alias("number"), "start_us", "end_us")
    return X.first_window(events(spark, d).select("user_id", "event_id", "t_us"), windows, USER, "event_id", 6 * HOUR).select("event_id", "window")


NORM = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""WITH ln AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), b AS (SELECT *, (doc_id * 37 + n * 11) % 100 / 100.0 AS conf, (n % 10) / 10.0 AS x FROM ln WHERE trim(line) <> '')
SELECT doc_id, n AS line_no, round((100 + x * 640) / 1920, 6) AS x, round((50 + 0.25 * 360) / 1080, 6) AS y, round(0.5 * 640 / 1920, 6) AS w FROM b WHERE conf >= 0.3 AND length({NORM.format('line')}) >= 2""")
def frame_boxes(spark, d):
    lines = T.lines(table(spark, d, "documents"), ["doc_id"], "text").withColumn("line_no", F.col("line_no").cast("bigint"))
    rows = lines.select("doc_id", "line_no", F.col("line").alias("text"), ((F.col("doc_id") * 37 + F.col("line_no") * 11) % 100 / F.lit(100.0)).alias("conf"), (F.col("line_no") % 10 / F.lit(10.0)).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("w"), F.lit(0.1).alias("h"))
    got = X.frame_boxes(rows, (100, 50, 640, 360), 1920, 1080)
    return got.select("doc_id", "line_no", *(F.round(c, 6).alias(c) for c in ("x", "y", "w")))


@query(f"""WITH {EV}, {span_sql('s', 'view', 10)}, m AS (SELECT s.event_id, string_agg(DISTINCT CAST(c.k AS VARCHAR), ',' ORDER BY CAST(c.k AS VARCHAR)) AS m FROM s JOIN ev c ON c.user_id = s.user_id AND c.event_type = 'click' AND c.t_us >= s.start_us AND c.t_us < s.end_us GROUP BY ALL) SELECT event_id, coalesce(m, '') AS texts FROM s LEFT JOIN m USING (event_id)""")
def cell_texts(spark, d):
    spans = spans_of(spark, d, "view", 10)
    clicks = of(spark, d, "click").select("user_id", F.col("t_us").alias("start_us"), (F.col("t_us") + 1).alias("end_us"), F.col("k").cast("string").alias("text"))
    met = J.overlapping(spans.select("user_id", "event_id", "start_us", "end_us"), clicks, USER, 6 * HOUR, "c").select("user_id", "event_id", F.col("c_text").alias("text"))
    return X.with_members(spans, met, USER, "event_id", "text").select("event_id", F.array_join("texts", ",").alias("texts"))


@query(f"""WITH {EV}, p AS (SELECT user_id, event_id, t_us // 100000000 * 100000000 + event_id % 40 AS t FROM ev), a AS (SELECT *, CAST(round_even(t / 100.0, 0) AS BIGINT) AS key FROM p) SELECT x.event_id AS a, y.event_id AS b FROM a x JOIN a y ON x.key = y.key AND x.user_id <> y.user_id AND x.event_id < y.event_id""")
def equal_times(spark, d):
    """Events of different users whose times, put to 100 s and spread by under 50 us, have the same 0.1 ms key."""
    rows = events(spark, d).select("user_id", "event_id", (F.floor(F.col("t_us") / 100_000_000) * 100_000_000 + F.col("event_id") % 40).alias("t"))
    keyed = rows.select("user_id", "event_id", J.time_key(F.col("t")).alias("key"))
    other = keyed.select(F.col("user_id").alias("user"), F.col("event_id").alias("b"), "key")
    return keyed.join(other, "key").where("user_id <> user and event_id < b").select(F.col("event_id").alias("a"), "b")


@query(f"""WITH {EV}, g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) <= {24 * HOUR} THEN 0 ELSE 1 END AS nw FROM ev), s AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session FROM g)
SELECT user_id, session, min(k) AS x0, min(k % 7) AS y0, max(k + event_id % 50) AS x1, max(k % 7 + 5) AS y1 FROM s GROUP BY ALL""")
def session_boxes(spark, d):
    box = F.struct(F.col("k").alias("x0"), (F.col("k") % 7).alias("y0"), (F.col("k") + F.col("event_id") % 50).alias("x1"), (F.col("k") % 7 + 5).alias("y1"))
    rows = S.gap_sessions(events(spark, d).withColumn("box", box), USER, "t_us", "event_id", 24 * HOUR).withColumn("session", F.col("session").cast("bigint"))
    return S.session_boxes(rows, USER, "box").select("user_id", "session", "box.*")
