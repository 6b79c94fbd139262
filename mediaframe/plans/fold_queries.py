"""Queries of the anchored folds; recursive SQL where it is practical."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds as O
from .base import EV, HOUR, MIN, events, table
from .series_queries import VISUAL, visual

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def recursive(by: str, where: str, state: str, first: str, step: str) -> str:
    """A fold as recursion over row numbers: ``state`` names, their first values, their next values."""
    return f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY t_us, event_id) AS i FROM ev WHERE {where}),
f AS (SELECT o.*, {first} FROM o WHERE i = 1 UNION ALL SELECT o.*, {step} FROM f JOIN o ON o.{by} = f.{by} AND o.i = f.i + 1)"""


@query(recursive("user_id", "true", "", "t_us AS kept", f"CASE WHEN o.t_us - f.kept < {12 * HOUR} THEN f.kept ELSE o.t_us END") + " SELECT user_id, kept AS t_us, max(value) AS strength FROM f GROUP BY ALL")
def onset_dedupe(spark, d):
    return O.fold(events(spark, d), ["user_id"], ["t_us", "event_id"], ["t_us", "value"], lambda rows: O.dedupe_onsets(rows, 12 * HOUR), "t_us bigint, strength double")


GROUPS = recursive("user_id", "true", "", "t_us AS ft, k AS fk, CAST(0 AS BIGINT) AS g", "CASE WHEN abs(o.t_us - f.ft) > {0} {1} THEN o.t_us ELSE f.ft END, CASE WHEN abs(o.t_us - f.ft) > {0} {1} THEN o.k ELSE f.fk END, CASE WHEN abs(o.t_us - f.ft) > {0} {1} THEN f.g + 1 ELSE f.g END")


@query(GROUPS.format(24 * HOUR, f"OR abs(o.k - f.fk) > 2 * {24 * HOUR}") + ' SELECT event_id, g AS "group" FROM f')
def timing_groups(spark, d):
    return O.fold(events(spark, d), ["user_id"], ["t_us", "event_id"], ["event_id", "t_us", "k"], lambda rows: O.timing_groups(rows, 24 * HOUR), "event_id bigint, group bigint").drop("user_id")


@query(GROUPS.format(12 * HOUR, "") + ' SELECT event_id, g AS "group" FROM f')
def start_clusters(spark, d):
    return O.fold(events(spark, d), ["user_id"], ["t_us", "event_id"], ["event_id", "t_us", "k"], lambda rows: O.timing_groups(rows, 12 * HOUR, False), "event_id bigint, group bigint").drop("user_id")


@query(GROUPS.format(12 * HOUR, "") + """, c AS (SELECT user_id, g, median(t_us) AS t50, min(k) AS x FROM f GROUP BY ALL), s AS (SELECT *, t50 - lag(t50) OVER (PARTITION BY user_id ORDER BY g) AS step FROM c)
SELECT user_id, count(*) AS n, round(median(step), 3) AS step, CASE WHEN coalesce(stddev_pop(x), 0) < 1e-9 OR coalesce(stddev_pop(t50), 0) < 1e-9 THEN 0.0 ELSE round(corr(x, t50), 6) END AS along FROM s GROUP BY user_id HAVING count(*) >= 3""")
def stagger_steps(spark, d):
    rows = start_clusters(spark, d).join(events(spark, d), "event_id")
    c = rows.groupBy("user_id", "group").agg(F.median("t_us").alias("t50"), F.min("k").alias("x"))
    s = c.withColumn("step", F.col("t50") - F.lag("t50").over(Window.partitionBy("user_id").orderBy("group")))
    flat = (F.coalesce(F.stddev_pop("x"), F.lit(0.0)) < 1e-9) | (F.coalesce(F.stddev_pop("t50"), F.lit(0.0)) < 1e-9)
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.median("step"), 3).alias("step"), F.when(flat, 0.0).otherwise(F.round(F.corr("x", "t50"), 6)).alias("along")).where("n >= 3")


SNAP = f"CASE WHEN {{0}}.k % 3 = 0 THEN {{0}}.t_us + ({{0}}.k - 50) * {MIN} END"


@query(recursive("event_type", "value >= 30", "", f"coalesce({SNAP.format('o')}, t_us) AS last, true AS ok", f"CASE WHEN o.t_us - f.last < {10 * HOUR} THEN f.last WHEN {SNAP.format('o')} > f.last THEN {SNAP.format('o')} ELSE o.t_us END, o.t_us - f.last >= {10 * HOUR}") + " SELECT event_type, last AS t_us FROM f WHERE ok")
def timeline_blocks(spark, d):
    rows = events(spark, d).where("value >= 30").withColumn("snap", F.when(F.col("k") % 3 == 0, F.col("t_us") + (F.col("k") - 50) * MIN))
    return O.fold(rows, ["event_type"], ["t_us", "event_id"], ["t_us", "snap"], lambda r: O.blocks(r, 10 * HOUR), "t_us bigint")


@query(recursive("user_id", "true", "", "CASE WHEN event_type = 'view' THEN NULL ELSE t_us END AS ft, CAST(0 AS BIGINT) AS line", f"CASE WHEN o.event_type = 'view' THEN NULL WHEN f.ft IS NULL OR o.t_us - f.ft >= {24 * HOUR} THEN o.t_us ELSE f.ft END, CASE WHEN o.event_type = 'view' OR f.ft IS NULL OR o.t_us - f.ft >= {24 * HOUR} THEN f.line + 1 ELSE f.line END") + " SELECT event_id, line FROM f")
def minor_lines(spark, d):
    minor = {"click", "purchase", "signup", "error"}
    return O.fold(events(spark, d), ["user_id"], ["t_us", "event_id"], ["event_id", "t_us", "event_type"], lambda rows: O.minor_lines(rows, 24 * HOUR, minor), "event_id bigint, line bigint").drop("user_id")


KINDS = "CASE WHEN e2e >= 60 AND n = 1 THEN 'cut' WHEN e2e >= 60 THEN 'transition' WHEN e2e >= 25 THEN 'update' ELSE 'activity' END"


@query(f"""WITH RECURSIVE {VISUAL}, k AS (SELECT user_id, run, first_us, last_us, post, round(reverts, 6) AS reverts, {KINDS} AS kind FROM v),
o AS (SELECT *, row_number() OVER w AS i, lead(first_us) OVER w AS ns, lead(last_us) OVER w AS nl, lead(post) OVER w AS np, lead(reverts) OVER w AS nr FROM k WINDOW w AS (PARTITION BY user_id ORDER BY first_us, run)),
c AS (SELECT *, coalesce(kind <> 'activity' AND ns - last_us <= {36 * HOUR} AND nr < 5, false) AS pair FROM o),
f AS (SELECT *, pair AS takes, false AS gone FROM c WHERE i = 1 UNION ALL SELECT c.*, c.pair AND NOT f.takes, f.takes FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT user_id, first_us, CASE WHEN takes THEN nl ELSE last_us END AS last_us, CASE WHEN takes THEN 'transient' ELSE kind END AS kind, CASE WHEN takes THEN greatest(post, np) ELSE post END AS peak FROM f WHERE NOT gone""")
def transient_merge(spark, d):
    rows = visual(spark, d).withColumn("reverts", F.round("reverts", 6))

    def run(r):
        return O.transients([(a, b, k, p, None if v != v else v) for a, b, k, p, v in r], 36 * HOUR, 5.0)

    return O.fold(rows, ["user_id"], ["first_us", "run"], ["first_us", "last_us", "kind", "post", "reverts"], run, "first_us bigint, last_us bigint, kind string, peak double")


def thumbs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("thumb"))


def far(a, b) -> float:
    return float(np.abs(np.asarray(a) - np.asarray(b)).mean())


def changed(a, b, least: float = 0.1) -> float:
    return float((np.abs(np.asarray(a) - np.asarray(b)) > least).mean())


@query("""WITH RECURSIVE o AS (SELECT vec_id, label, embedding AS th, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
f AS (SELECT *, th AS kept, true AS ok FROM o WHERE i = 1 UNION ALL SELECT o.*, CASE WHEN list_sum(list_transform(range(1, 65), lambda q: CASE WHEN abs(CAST(o.th[q] AS DOUBLE) - CAST(f.kept[q] AS DOUBLE)) > 0.1 THEN 1 ELSE 0 END)) >= 32 THEN o.th ELSE f.kept END, list_sum(list_transform(range(1, 65), lambda q: CASE WHEN abs(CAST(o.th[q] AS DOUBLE) - CAST(f.kept[q] AS DOUBLE)) > 0.1 THEN 1 ELSE 0 END)) >= 32 FROM f JOIN o ON o.label = f.label AND o.i = f.i + 1)
SELECT label, vec_id FROM f WHERE ok""")
def sample_plan(spark, d):
    return O.fold(thumbs(spark, d), ["label"], ["vec_id"], ["vec_id", "thumb"], lambda rows: O.chosen(rows, changed, 0.5), "vec_id bigint")


DIFF = "list_avg(list_transform(range(1, 65), lambda q: CASE WHEN abs(CAST({a}[q] AS DOUBLE) - CAST({b}[q] AS DOUBLE)) > {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))"


@query(f"""WITH RECURSIVE o AS (SELECT vec_id, vec_id * {MIN} AS t, CAST(vec_id // 100 AS INTEGER) AS video, label AS shot, vec_id % 3 = 0 AS settled, vec_id % 7 = 0 AS peak, embedding AS th, row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id) AS i FROM embeddings),
f AS (SELECT video, i, vec_id, t AS kt, shot AS ks, th AS kth, false AS ps, 'first' AS reason FROM o WHERE i = 1 UNION ALL
SELECT video, i, vec_id, CASE WHEN reason IS NULL THEN kt ELSE t END, CASE WHEN reason IS NULL THEN ks ELSE shot END, CASE WHEN reason IS NULL THEN kth ELSE th END, reason IS NULL AND ps, reason FROM
(SELECT video, i, vec_id, t, shot, th, kt, ks, kth, ps, CASE WHEN shot <> ks THEN 'shot' WHEN ch >= 0.5 AND (settled OR t - kt >= {3 * MIN}) THEN 'change' WHEN settled AND ps AND ch >= 0.2 THEN 'peak' END AS reason FROM
(SELECT o.*, f.kt, f.ks, f.kth, f.ps OR o.peak AS ps, {DIFF.format(a='o.th', b='f.kth', c='0.1')} AS ch FROM f JOIN o ON o.video = f.video AND o.i = f.i + 1) x) y)
SELECT video, vec_id, reason FROM f WHERE reason IS NOT NULL""")
def keyframe_walk(spark, d):
    rows = thumbs(spark, d).select("vec_id", (F.col("vec_id") * MIN).alias("t_us"), F.lit(0).alias("video"), F.col("label").alias("shot"), (F.col("vec_id") % 3 == 0).alias("settled"), (F.col("vec_id") % 7 == 0).alias("peak"), "thumb")
    rows = rows.withColumn("video", F.floor(F.col("vec_id") / 100).cast("int"))
    return O.fold(rows, ["video"], ["vec_id"], ["vec_id", "t_us", "shot", "settled", "peak", "thumb"], lambda r: O.keyframes(r, changed, 0.5, 0.2, 3 * MIN), "vec_id bigint, reason string")


NEAR = """nt AS (SELECT e.vec_id, b.label, list_transform(range(1, 65), lambda i: CAST(b.embedding[i] AS DOUBLE) + CASE WHEN i = e.vec_id % 64 + 1 THEN 0.02::DOUBLE * (e.vec_id % 4) ELSE 0.0::DOUBLE END) AS th FROM embeddings e JOIN embeddings b ON b.vec_id = e.vec_id - e.vec_id % 4),
nh AS (SELECT *, CAST(list_sum(list_transform(list_filter(range(0, 63), lambda i: i % 8 < 7), lambda i: CASE WHEN th[i + 2] > th[i + 1] THEN 1::BIGINT << CAST(i - i // 8 AS INT) ELSE 0 END)) AS BIGINT) AS h FROM nt)"""


def near_thumbs(spark, d):
    """Pictures in fours: each the first of its four with one pixel raised by a fiftieth for each place."""
    base = thumbs(spark, d)
    own = base.select("vec_id", (F.col("vec_id") - F.col("vec_id") % 4).alias("first"))
    met = own.join(base.withColumnsRenamed({"vec_id": "first"}), "first")
    raised = F.transform("thumb", lambda x, i: x + F.when(i == F.col("vec_id") % 64, F.lit(0.02) * (F.col("vec_id") % 4)).otherwise(F.lit(0.0)))
    return met.select("vec_id", "label", raised.alias("thumb"))


@query(f"""WITH RECURSIVE {NEAR}, pr AS (SELECT b.vec_id, list(a.vec_id) AS l FROM nh a JOIN nh b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 4 AND {DIFF.format(a='a.th', b='b.th', c='0.1')} < 0.05 AND {DIFF.format(a='a.th', b='b.th', c='0.05')} < 0.002 GROUP BY b.vec_id),
o AS (SELECT nh.vec_id, label, coalesce(l, []) AS l, row_number() OVER (PARTITION BY label ORDER BY nh.vec_id) AS i FROM nh LEFT JOIN pr USING (vec_id)),
f AS (SELECT label, i, vec_id, [vec_id] AS origs, CAST(NULL AS BIGINT) AS hit FROM o WHERE i = 1 UNION ALL SELECT label, i, vec_id, CASE WHEN hit IS NULL THEN list_append(origs, vec_id) ELSE origs END, hit FROM
(SELECT o.*, f.origs, list_min(list_filter(o.l, lambda x: list_contains(f.origs, x))) AS hit FROM f JOIN o ON o.label = f.label AND o.i = f.i + 1) z)
SELECT label, vec_id, coalesce(hit, -1) AS original FROM f""")
def same_as(spark, d):
    """Repeats by hash distance, and pictures that match at both scales."""

    def run(rows):
        got = O.repeats_by_hash(rows, lambda x: O.difference_bits(x, 8), 4, lambda a, b: changed(a, b) < 0.05 and changed(a, b, 0.05) < 0.002)
        return [(k, -1 if h is None else h) for k, h in got]

    return O.fold(near_thumbs(spark, d), ["label"], ["vec_id"], ["vec_id", "thumb"], run, "vec_id bigint, original bigint")


@query()
def budget_drop(spark, d):
    rows = thumbs(spark, d).withColumn("free", F.col("vec_id") % 5 != 0)
    return O.fold(rows, ["label"], ["vec_id"], ["vec_id", "free", "thumb"], lambda r: O.budget(r, 12, far), "vec_id bigint")


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS i FROM ev),
f AS (SELECT user_id, i, event_id, event_type AS ty, [value] AS l, 0 AS run FROM o WHERE i = 1 UNION ALL SELECT user_id, i, event_id, event_type, CASE WHEN same THEN list_append(l, value) ELSE [value] END, run + CASE WHEN same THEN 0 ELSE 1 END FROM
(SELECT o.*, f.l, f.run, o.event_type = f.ty AND abs(o.value - list_median(f.l)) <= 0.8::DOUBLE * list_median(f.l) AS same FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) z),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS n FROM f)
SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY run) - 1 AS run FROM k WHERE n >= 2""")
def repeat_runs(spark, d):
    return O.fold(events(spark, d), ["user_id"], ["t_us", "event_id"], ["event_id", "event_type", "value"], lambda rows: O.repeat_runs(rows, 0.8, 2), "event_id bigint, run bigint")


@query()
def scene_merge(spark, d):
    rows = events(spark, d).where("value >= 100")
    w = Window.partitionBy("user_id").orderBy("t_us", "event_id")
    spans = rows.select("user_id", "event_id", F.col("t_us").alias("start_us"), F.lead("t_us").over(w).alias("end_us"), F.when(F.col("value") >= 150, 2).otherwise(1).alias("strength")).where("end_us is not null")
    return O.fold(spans, ["user_id"], ["start_us", "event_id"], ["start_us", "end_us", "strength"], lambda r: O.scene_merge(r, 6), "start_us bigint, end_us bigint, strength bigint")


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT user_id, list(struct_pack(i := j, id := event_id, t := t_us) ORDER BY j) AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS j FROM ev WHERE event_type = 'purchase') GROUP BY user_id),
o AS (SELECT c.user_id, c.event_id, c.t_us, r.r, row_number() OVER (PARTITION BY c.user_id ORDER BY c.t_us, c.event_id) AS i FROM ev c JOIN r ON r.user_id = c.user_id WHERE c.event_type = 'click'),
z AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a_id, CAST(NULL AS BIGINT) AS b_id, CAST([] AS BIGINT[]) AS used FROM o WHERE i = 1 UNION ALL SELECT user_id, i, event_id, hit.id, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.i) END FROM
(SELECT o.user_id, o.i, o.event_id, z.used, list_sort(list_transform(list_filter(o.r, lambda x: abs(x.t - o.t_us) <= {24 * HOUR} AND NOT list_contains(z.used, x.i)), lambda x: struct_pack(d := abs(x.t - o.t_us), i := x.i, id := x.id)))[1] AS hit FROM z JOIN o ON o.user_id = z.user_id AND o.i = z.i + 1) y)
SELECT user_id, a_id, b_id FROM z WHERE b_id IS NOT NULL""")
def cut_match(spark, d):
    """Clicks of each user matched one to one with purchases within a day, in their order."""
    rows = events(spark, d).where("event_type in ('click', 'purchase')")

    def run(r):
        a, b = ([x for x in r if x[2] == k] for k in ("click", "purchase"))
        return [(a[i][0], b[j][0]) for i, j in O.greedy_match([x[1] for x in a], [x[1] for x in b], 24 * HOUR)]

    return O.fold(rows, ["user_id"], ["t_us", "event_id"], ["event_id", "t_us", "event_type"], run, "a_id bigint, b_id bigint")


@query(f"""WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_us, event_id) AS i FROM ev),
f AS (SELECT user_id, i, event_id, event_id AS kept_id, [struct_pack(id := event_id, s := t_us, d := k)] AS kept FROM o WHERE i = 1 UNION ALL SELECT user_id, i, event_id, coalesce(hit.id, event_id), CASE WHEN hit IS NULL THEN list_append(kept, struct_pack(id := event_id, s := t_us, d := k)) ELSE kept END FROM
(SELECT o.*, f.kept, list_filter(f.kept, lambda x: abs(x.s - o.t_us) <= {24 * HOUR} AND abs(x.d - o.k) <= 10)[1] AS hit FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1) z)
SELECT user_id, event_id, kept_id FROM f""")
def merge_near_items(spark, d):
    return O.fold(events(spark, d), ["user_id"], ["t_us", "event_id"], ["event_id", "t_us", "k"], lambda r: O.merge_near(r, 24 * HOUR, 10), "event_id bigint, kept_id bigint")
