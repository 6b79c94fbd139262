"""Queries of the series kernel and the time joins over ``events``, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import series as S
from .base import EV, HOUR, MIN, events

GAP = 6 * HOUR
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SESSIONS = f"""{EV}, b AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER w <= {GAP} THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS session FROM b),
g AS (SELECT user_id, CAST(session AS BIGINT) AS session, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n, max(value) AS peak, max(k) AS blob FROM s GROUP BY ALL)"""


@query(f"WITH {SESSIONS} SELECT * FROM g")
def gap_sessions(spark, d):
    return S.session_summary(S.gap_sessions(events(spark, d), ["user_id"], "t_us", "event_id", GAP), ["user_id"], "t_us", "value", "k")


@query(f"""WITH {SESSIONS} SELECT user_id, session, CASE WHEN peak < 16 OR (peak < 32 AND blob < 0.002 * 20000) THEN 'noise' WHEN peak < 32 THEN 'subtle' WHEN blob < 0.0005 * 20000 THEN 'micro' ELSE 'motion' END AS class FROM g""")
def session_class(spark, d):
    return gap_sessions(spark, d).select("user_id", "session", S.event_class(F.col("peak"), F.col("blob"), 20000).alias("class"))


@query(f"""WITH {SESSIONS}, c AS (SELECT user_id, CASE WHEN peak < 16 OR (peak < 32 AND blob < 40) THEN 'noise' WHEN peak < 32 THEN 'subtle' WHEN blob < 10 THEN 'micro' ELSE 'motion' END AS class, first_us FROM g)
SELECT class, count(*) AS n, min(first_us) AS earliest_us FROM c GROUP BY class""")
def class_counts(spark, d):
    g = gap_sessions(spark, d)
    return g.groupBy(S.event_class(F.col("peak"), F.col("blob"), 20000).alias("class")).agg(F.count("*").alias("n"), F.min("first_us").alias("earliest_us"))


@query(f"""WITH {EV}, st AS (SELECT * FROM ev WHERE value >= 32),
cb AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) <= {GAP} THEN 0 ELSE 1 END AS nw FROM st),
cs AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS c FROM cb),
ex AS (SELECT user_id, c, min(t_us) AS a, max(t_us) AS z FROM cs GROUP BY ALL),
fa AS (SELECT e.*, x.c, row_number() OVER (PARTITION BY e.event_id ORDER BY greatest(0, e.t_us - x.z, x.a - e.t_us), x.c) AS r, greatest(0, e.t_us - x.z, x.a - e.t_us) AS dist FROM ev e JOIN ex x ON x.user_id = e.user_id WHERE e.value < 32),
att AS (SELECT event_id, c FROM fa WHERE r = 1 AND dist <= {GAP}),
ow AS (SELECT * FROM ev WHERE value < 32 AND event_id NOT IN (SELECT event_id FROM att)),
ob AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us, event_id) <= {GAP} THEN 0 ELSE 1 END AS nw FROM ow),
os AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS c FROM ob)
SELECT event_id, 'core' AS kind, CAST(c AS BIGINT) AS "group" FROM cs UNION ALL SELECT event_id, 'attached', CAST(c AS BIGINT) FROM att UNION ALL SELECT event_id, 'own', CAST(c AS BIGINT) FROM os""")
def attach_specks(spark, d):
    return S.attach_specks(events(spark, d), ["user_id"], "t_us", "event_id", F.col("value") >= 32, GAP).select("event_id", "kind", F.col("group").cast("bigint").alias("group"))


STILL = f"""{EV}, o AS (SELECT *, row_number() OVER w AS i, lag(t_us) OVER w AS prev, lead(t_us) OVER w AS nxt FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
q AS (SELECT *, list_sort(list(CASE WHEN i > 1 THEN value END) FILTER (WHERE i > 1) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 3 FOLLOWING)) AS l FROM o),
f AS (SELECT *, l[CAST(floor(0.1 * (len(l) - 1)) AS BIGINT) + 1] AS fl FROM q),
s AS (SELECT *, (i = 1 OR (k < 70 AND value < 30 + 2 * coalesce(fl, 0))) AS still FROM f)"""


@query(f"WITH {STILL} SELECT event_id, fl AS floor, still FROM s")
def still_active(spark, d):
    return _still(spark, d).select("event_id", "floor", "still")


def _still(spark, d):
    return S.still_rows(events(spark, d), ["user_id"], ["t_us", "event_id"], "k", "value", 70, 30.0, 2.0, 3)


RUNS = f"""{STILL}, rb AS (SELECT *, CASE WHEN still = lag(still) OVER (PARTITION BY user_id ORDER BY t_us, event_id) THEN 0 ELSE 1 END AS nw FROM s),
rr AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM rb)"""


@query(f"""WITH {RUNS}, g AS (SELECT user_id, run, min(coalesce(prev, t_us)) AS start_us, count(*) AS n, max(t_us) AS last_us, CASE WHEN bool_or(nxt IS NULL) THEN NULL ELSE max(nxt) END AS nx FROM rr WHERE still GROUP BY user_id, run)
SELECT user_id, run, n, start_us, coalesce(nx, last_us + {MIN}) - start_us AS hold_us FROM g""")
def still_active_runs(spark, d):
    return S.still_runs(_still(spark, d), ["user_id"], "t_us", "event_id", MIN).withColumn("run", F.col("run").cast("bigint"))


@query(f"""WITH {EV}, c AS (SELECT *, t_us // {6 * HOUR} AS cell, row_number() OVER (PARTITION BY user_id, t_us // {6 * HOUR}, event_type ORDER BY value, t_us, event_id) AS r FROM ev),
x AS (SELECT *, row_number() OVER (PARTITION BY user_id, cell ORDER BY (k >= 20) DESC, k DESC, value, t_us, event_id) AS r2 FROM c WHERE r = 1)
SELECT user_id, cell, event_id, value, k FROM x WHERE r2 = 1""")
def cell_winner(spark, d):
    return S.cell_winner(events(spark, d), ["user_id"], "t_us", "event_id", "event_type", "value", "k", 6 * HOUR, 20).select("user_id", F.col("cell").cast("bigint").alias("cell"), "event_id", "value", "k")


VISUAL = f"""{EV}, p AS (SELECT *, value >= 20 AS act, lag(value) OVER w AS pre, CASE WHEN (value >= 20) = lag(value >= 20) OVER w THEN 0 ELSE 1 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t_us, event_id)),
r AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS run FROM p),
g AS (SELECT user_id, run, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS n, first(pre ORDER BY t_us, event_id) AS pre, last(value ORDER BY t_us, event_id) AS post FROM r WHERE act GROUP BY user_id, run),
v AS (SELECT *, abs(post - coalesce(pre, 0)) AS e2e, abs(post - lag(pre) OVER (PARTITION BY user_id ORDER BY first_us)) AS reverts FROM g)"""


@query(f"""WITH {VISUAL} SELECT user_id, run, first_us, last_us, n, round(e2e, 6) AS e2e, round(reverts, 6) AS reverts, CASE WHEN e2e >= 60 AND n = 1 THEN 'cut' WHEN e2e >= 60 THEN 'transition' WHEN e2e >= 25 THEN 'update' ELSE 'activity' END AS kind FROM v""")
def visual_event_kind(spark, d):
    out = visual(spark, d)
    return out.select("user_id", F.col("run").cast("bigint").alias("run"), "first_us", "last_us", "n", F.round("e2e", 6).alias("e2e"), F.round("reverts", 6).alias("reverts"), "kind")


def visual(spark, d):
    return S.visual_events(events(spark, d).withColumn("active", F.col("value") >= 20), ["user_id"], "t_us", "event_id", "active", "value", 60, 25)


@query(f"""WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_us, event_id) AS i FROM ev),
m AS (SELECT *, median(CASE WHEN i > 1 THEN value END) OVER (PARTITION BY event_type ORDER BY t_us RANGE BETWEEN {30 * MIN} PRECEDING AND {30 * MIN} FOLLOWING EXCLUDE CURRENT ROW) AS med FROM o)
SELECT event_id, round(med, 6) AS median FROM m WHERE i > 1 AND value >= 60 AND value >= 3 * greatest(coalesce(med, 0), 2)""")
def robust_cuts(spark, d):
    return S.robust_cuts(events(spark, d).select("event_type", "t_us", "event_id", "value"), ["event_type"], "t_us", "event_id", "value", 60, 3, 2, 30 * MIN).select("event_id", F.round("median", 6).alias("median"))


@query(f"""WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t_us, event_id) AS i FROM ev),
m AS (SELECT *, median(CASE WHEN i > 1 THEN value END) OVER (PARTITION BY event_type ORDER BY t_us RANGE BETWEEN {300 * MIN} PRECEDING AND {300 * MIN} FOLLOWING) AS med, max(value) OVER (PARTITION BY event_type ORDER BY t_us RANGE BETWEEN {30 * MIN} PRECEDING AND {30 * MIN} FOLLOWING) AS top FROM o)
SELECT event_id, round(med, 6) AS median FROM m WHERE value >= 10 AND value >= top AND value >= 2.5 * coalesce(med, 0) + 0.1""")
def adaptive_peaks(spark, d):
    return S.adaptive_peaks(events(spark, d).select("event_type", "t_us", "event_id", "value"), ["event_type"], "t_us", "event_id", "value", 10, 2.5, 0.1, 30 * MIN, 300 * MIN).select("event_id", F.round("median", 6).alias("median"))


@query(f"""WITH {EV}, o AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY t_us, event_id) AS before FROM ev) SELECT event_id, before FROM o WHERE before IS NOT NULL AND value >= 40 AND value >= 3 * greatest(before, 1)""")
def flash_peaks(spark, d):
    return S.flash_peaks(events(spark, d), ["event_type"], "t_us", "event_id", "value", 40, 3, 1.0).select("event_id", "before")


@query(f"""WITH {EV}, o AS (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY t_us RANGE BETWEEN {30 * MIN} PRECEDING AND {30 * MIN} FOLLOWING) AS top FROM ev) SELECT event_id FROM o WHERE value >= 20 AND value >= top""")
def change_steps(spark, d):
    return S.change_steps(events(spark, d), ["event_type"], "t_us", "value", 20, 30 * MIN).select("event_id")


@query(f"""WITH {EV}, st AS (SELECT user_id, min(t_us) AS t_us, max(t_us) + {MIN} AS end_us FROM ev GROUP BY user_id),
p AS (SELECT user_id, t_us FROM ev WHERE value >= 100 UNION SELECT user_id, t_us FROM st)
SELECT p.user_id, row_number() OVER w AS shot, p.t_us AS start_us, coalesce(lead(p.t_us) OVER w, st.end_us) AS end_us FROM p JOIN st USING (user_id) WINDOW w AS (PARTITION BY p.user_id ORDER BY p.t_us)""")
def shots(spark, d):
    ev = events(spark, d)
    start = ev.groupBy("user_id").agg(F.min("t_us").alias("t_us"), (F.max("t_us") + MIN).alias("end_us"))
    return S.spans_between(ev.where("value >= 100"), ["user_id"], "t_us", start, "end_us").withColumn("shot", F.col("shot").cast("bigint"))


@query(f"""WITH {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT event_id FROM o WHERE n <= 12 OR r IN (SELECT CAST(round_even(i * (o.n - 1) / 11.0, 0) AS BIGINT) FROM range(12) t(i))""")
def thin_linspace(spark, d):
    return S.thin(events(spark, d), ["user_id"], "t_us", "event_id", 12).select("event_id")


@query(f"""WITH {EV}, s AS (SELECT user_id, event_type, t_us - lag(t_us) OVER (PARTITION BY user_id, event_type ORDER BY t_us, event_id) AS d FROM ev)
SELECT user_id, event_type, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(d) / avg(d) < 0.8 THEN round(median(d), 3) END AS period FROM s GROUP BY ALL""")
def loop_period(spark, d):
    return S.loop_period(events(spark, d), ["user_id", "event_type"], "t_us", "event_id", 3, 0.8).withColumn("period", F.round("period", 3))


@query(f"""WITH {EV} SELECT event_type, t_us // {HOUR} AS bin, count(*) AS n, round(10 * log10(sum(value * value) / count(*) + 1e-12), 6) AS level_db FROM ev GROUP BY ALL""")
def level_per_bin(spark, d):
    return S.level_per_bin(events(spark, d), ["event_type"], "t_us", "value", HOUR).select("event_type", F.col("bin").cast("bigint").alias("bin"), "n", F.round("level_db", 6).alias("level_db"))


@query(f"""WITH {EV}, h AS (SELECT event_type, t_us // {HOUR} AS bin, sum(value * value) AS e FROM ev GROUP BY ALL),
w AS (SELECT *, sum(e) OVER z AS e3, count(*) OVER z AS c FROM h WINDOW z AS (PARTITION BY event_type ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
b AS (SELECT *, 10 * log10(e3 / 3 + 1e-12) AS db FROM w WHERE c = 3),
f AS (SELECT *, quantile_cont(db, 0.1) OVER (PARTITION BY event_type) AS fl FROM b),
a AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY event_type ORDER BY bin) - 3 < 2 THEN 0 ELSE 1 END AS nw FROM f WHERE db > fl + 4 AND db > -60),
s AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY bin ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM a)
SELECT event_type, CAST(segment AS BIGINT) AS segment, min(bin) AS start_bin, max(bin) + 3 AS end_bin FROM s GROUP BY ALL HAVING max(bin) + 3 - min(bin) >= 4""")
def activity_segments(spark, d):
    ev = events(spark, d)
    hourly = ev.groupBy("event_type", F.floor(F.col("t_us") / HOUR).alias("bin")).agg(F.sum(F.col("value") * F.col("value")).alias("e"))
    out = S.activity_segments(hourly, ["event_type"], "bin", "e", 3, 4, -60, 2, 4)
    return out.select("event_type", *(F.col(c).cast("bigint").alias(c) for c in ("segment", "start_bin", "end_bin")))


@query(f"""WITH {EV}, a AS (SELECT *, row_number() OVER w AS i, lead(value) OVER w AS nx, max(value) OVER (PARTITION BY event_type ORDER BY t_us, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS top, list(value) OVER (PARTITION BY event_type ORDER BY t_us, event_id ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS l FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY t_us, event_id)),
m AS (SELECT *, list_median(l) AS med FROM a), d AS (SELECT *, list_median(list_transform(l, lambda x: abs(x - med))) AS mad FROM m)
SELECT event_id, round(med, 6) AS median, round(mad, 6) AS mad FROM d WHERE i > 1 AND nx IS NOT NULL AND value > 1 AND value >= top AND value > med + 4 * 1.4826 * mad""")
def onset_mad(spark, d):
    return S.onsets(events(spark, d), ["event_type"], "t_us", "event_id", "value", 20, 5, 4, 1.0).select("event_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


SPAN = f"sp AS (SELECT event_id, user_id, event_type, t_us AS start_us, t_us + 1 + k * {3 * MIN} AS end_us FROM ev)"


def spans(spark, d):
    """Each event as a span of 3 minutes per unit of ``k``, and 1 microsecond."""
    return events(spark, d).select("event_id", "user_id", "event_type", F.col("t_us").alias("start_us"), (F.col("t_us") + 1 + F.col("k") * 3 * MIN).alias("end_us"))


MERGED = f"""{EV}, {SPAN}, mk AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY event_type ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM sp WHERE event_type <> 'view'),
mg AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM mk),
me AS (SELECT event_type, min(start_us) AS start_us, max(end_us) AS end_us FROM mg GROUP BY event_type, g)"""


@query(f"WITH {MERGED} SELECT * FROM me")
def merge_spans(spark, d):
    return J.merge_spans(spans(spark, d).where("event_type <> 'view'"), ["event_type"])


@query(f"""WITH {EV}, {SPAN}, mk AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM sp WHERE event_type = 'view'),
mg AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM mk),
me AS (SELECT user_id, min(start_us) AS a, max(end_us) AS z FROM mg GROUP BY user_id, g)
SELECT q.user_id, q.event_id, CAST(coalesce(sum(CASE WHEN me.a IS NULL THEN 0 ELSE least(q.end_us, me.z) - greatest(q.start_us, me.a) END), 0) AS BIGINT) AS covered_us FROM sp q LEFT JOIN me ON me.user_id = q.user_id AND me.a < q.end_us AND q.start_us < me.z WHERE q.event_type = 'click' GROUP BY ALL""")
def interval_coverage(spark, d):
    sp = spans(spark, d)
    return J.coverage(sp.where("event_type = 'click'"), sp.where("event_type = 'view'").select("user_id", "start_us", "end_us"), ["user_id"], "event_id", 12 * HOUR)


@query(f"""WITH {EV}, l AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'click')
SELECT l.event_id, r.event_id AS right_event_id, r.value AS right_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t_us >= r.t_us""")
def asof_backward(spark, d):
    ev = events(spark, d)
    got = J.asof_backward(ev.where("event_type = 'purchase'"), ev.where("event_type = 'click'"), ["user_id"], "t_us", "event_id", ["event_id", "value"])
    return got.select("event_id", "right_event_id", "right_value")


PAIRS = f"""{EV}, pr AS (SELECT a.event_id AS a_key, b.event_id AS b_key, a.t_us AS a_t, b.t_us AS b_t, abs(a.t_us - b.t_us) AS dd FROM ev a JOIN ev b ON a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.t_us - b.t_us) <= {15 * MIN}),
rk AS (SELECT *, row_number() OVER (PARTITION BY a_key ORDER BY dd, b_t, b_key) AS ra, row_number() OVER (PARTITION BY b_key ORDER BY dd, a_t, a_key) AS rb FROM pr),
mn AS (SELECT a_key, b_key, b_t - a_t AS offset_us FROM rk WHERE ra = 1 AND rb = 1)"""


def _pairs(spark, d):
    ev = events(spark, d).withColumn("one", F.lit(1))
    return J.mutual_nearest(ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'"), ["one"], "t_us", "event_id", 15 * MIN)


@query(f"WITH {PAIRS} SELECT * FROM mn")
def mutual_nearest(spark, d):
    return _pairs(spark, d).drop("one")


@query(f"WITH {PAIRS} SELECT count(*) AS pairs, round(quantile_cont(offset_us, 0.5), 3) AS median, round(quantile_cont(offset_us, 0.1), 3) AS p10, round(quantile_cont(offset_us, 0.9), 3) AS p90 FROM mn")
def sync_offsets(spark, d):
    return J.offset_stats(_pairs(spark, d), "offset_us").select("pairs", *(F.round(c, 3).alias(c) for c in ("median", "p10", "p90")))


@query(f"""WITH {EV}, pr AS (SELECT b.t_us - a.t_us AS dd, b.value AS w FROM ev a JOIN ev b ON a.event_type = 'click' AND b.event_type = 'purchase' AND abs(a.t_us - b.t_us) <= {20 * MIN}),
lg AS (SELECT l.lag_us, sum(w * exp(-(dd - l.lag_us) * 1.0 * (dd - l.lag_us) / (4.0 * {MIN} * {MIN}))) AS score FROM pr, (SELECT -{15 * MIN} + i * {MIN} AS lag_us FROM range(31) t(i)) l GROUP BY ALL)
SELECT lag_us, round(score, 6) AS score FROM lg ORDER BY round(score, 9) DESC, lag_us LIMIT 1""")
def xcorr_lag(spark, d):
    ev = events(spark, d).withColumn("one", F.lit(1))
    got = J.xcorr(ev.where("event_type = 'click'"), ev.where("event_type = 'purchase'"), ["one"], "t_us", "event_id", "value", 15 * MIN, MIN, float(MIN), 20 * MIN)
    return got.select(F.col("lag_us").cast("bigint").alias("lag_us"), F.round("score", 6).alias("score"))


@query(f"""WITH {MERGED} SELECT e.event_id, EXISTS (SELECT 1 FROM me WHERE me.event_type = 'error' AND me.start_us <= e.t_us AND e.t_us < me.end_us) AS inside FROM ev e WHERE e.event_type = 'signup'""")
def containment(spark, d):
    held = J.merge_spans(spans(spark, d).where("event_type = 'error'"), ["event_type"]).select(F.lit(1).alias("one"), "start_us", "end_us")
    got = J.contained(events(spark, d).where("event_type = 'signup'").withColumn("one", F.lit(1)), held, ["one"], "t_us", "event_id", 24 * HOUR)
    return got.select("event_id", "inside")


@query(f"""WITH {EV}, {SPAN}, j AS (SELECT a.user_id, a.event_id, b.event_id AS b_event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY b.start_us, b.event_id) AS r FROM sp a JOIN sp b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view' AND a.start_us < b.end_us AND b.start_us < a.end_us)
SELECT user_id, event_id, b_event_id FROM j WHERE r = 1""")
def overlap_first(spark, d):
    sp = spans(spark, d)
    return J.first_overlap(sp.where("event_type = 'error'"), sp.where("event_type = 'view'"), ["user_id"], "event_id", 12 * HOUR)


@query(f"""WITH {EV}, {SPAN}, w AS (SELECT * FROM sp WHERE event_type = 'click'), g AS (SELECT user_id, start_us AS seg FROM sp WHERE event_type = 'view')
SELECT w.event_id, greatest(w.start_us, coalesce(g.seg, w.start_us)) AS clamped_us FROM w ASOF LEFT JOIN g ON w.user_id = g.user_id AND w.end_us - {20 * MIN} >= g.seg""")
def start_clamp(spark, d):
    sp = spans(spark, d)
    got = J.start_clamp(sp.where("event_type = 'click'"), sp.where("event_type = 'view'"), ["user_id"], "event_id", 20 * MIN)
    return got.select("event_id", "clamped_us")


@query(f"""WITH {EV}, r AS (SELECT DISTINCT event_type, k AS n FROM ev WHERE value >= 150), g AS (SELECT *, n - row_number() OVER (PARTITION BY event_type ORDER BY n) AS g FROM r),
s AS (SELECT event_type, min(n) AS a, max(n) AS z FROM g GROUP BY event_type, g)
SELECT event_type, string_agg(CASE WHEN a = z THEN printf('M%02d', a) ELSE printf('M%02d-M%02d', a, z) END, ', ' ORDER BY a) AS ranges FROM s GROUP BY event_type""")
def id_ranges(spark, d):
    return S.id_ranges(events(spark, d).where("value >= 150"), ["event_type"], "k")


@query(f"""WITH {EV} SELECT user_id, t_us // 100000000 AS key, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1""")
def time_key_join(spark, d):
    """Rows that share a rounded time key (here 100 s) with another row of their video."""
    ev = events(spark, d)
    return ev.groupBy("user_id", F.floor(F.col("t_us") / 100_000_000).cast("bigint").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
