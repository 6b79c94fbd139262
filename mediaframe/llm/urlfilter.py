"""URL rules through Bloom filter cascades: exact membership of rule keys without joins, in DataFrame operations alone.

A rule (host, path) has the key ``host + path``; a URL's candidate keys are its host's suffixes by labels
with its path's prefixes, for the (labels, path length) shapes that the rules have. Level 0 of a cascade
encodes the listed keys; level 1 the keys of the corpus that level 0 admits wrongly; level 2 the listed keys that level 1
admits; and so on until a level admits nothing wrongly. Over that complete key universe the answer
is exact. One cascade holds the block rules, one the allow rules.

Level 0 is sized by how many candidate keys the corpus has: of r listed among s others it admits about r / sqrt(2) wrongly, and every
later level half of what it must refuse, so a cascade takes about r * (1.44 * log2(s / r) + 4) bits however large the corpus is, and
that many at most reach the driver. They travel inside the plan as one array literal a level, bound once for all
candidate keys of a row; a level of over ``MOST_WORDS`` 64-bit words (several million rules) raises.

Edge cases: a null URL, or one without ``://``, has empty host and path; rules with null or empty host are
ignored; of several fitting rules the longest key wins, then the longer host; a key listed both ways
blocks; without rules everything gets the default verdict; repeated rows keep their rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

MOST_WORDS = 1 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


class Level:
    def __init__(self, keys: DataFrame, size: int, number: int, rate: float):
        """A Bloom filter of ``size`` distinct ``key``s that admits others at ``rate``; at most one row per 64-bit word reaches the driver."""
        self.number, self.hashes = number, max(1, round(-math.log2(rate)))
        self.words = max(1, math.ceil(size * -math.log(rate) / math.log(2) ** 2 / 64))
        if self.words > MOST_WORDS:
            raise ValueError("too many rules for one cascade")
        got = keys.select(F.explode(self.places(F.col("key"))).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()
        bits = [0] * self.words
        for w, b in got:
            bits[w] = b
        # One string, folded to one array literal when the plan is made.
        self.bits = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")

    def places(self, key: Column) -> Column:
        return F.array(*(F.pmod(F.xxhash64(key, F.lit(self.number << 8 | i)), F.lit(self.words * 64)).cast("long") for i in range(self.hashes)))

    def admits(self, key: Column) -> Column:
        return F.forall(self.places(key), lambda p: F.get(self.bits, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)


class Cascade:
    def __init__(self, listed: DataFrame, universe: DataFrame, queried: int, most: int = 64):
        """``listed`` and ``universe``: a string ``key``; ``queried``: rows of ``universe``. Keys of either side that a level admits wrongly make the next level."""
        listed = written(listed.select("key").distinct(), "listed")
        size = listed.count()
        self.levels = [Level(listed, size, 0, min(0.5, size / (math.sqrt(2) * max(queried, 1))) if size else 0.5)]
        wrong = universe.where(self.levels[0].admits(F.col("key"))).select("key").distinct().join(listed, "key", "left_anti")
        kept, other = listed, written(wrong, "admitted")  # what the last level held, and what it admits wrongly
        while size := other.count():
            if len(self.levels) == most:
                raise ValueError("the cascade does not end")
            level = Level(other, size, len(self.levels), 0.5)
            self.levels.append(level)
            kept, other = other, written(kept.where(level.admits(F.col("key"))), "admitted")

    def contains(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            answer = F.when(self.levels[k].admits(key), answer).otherwise(F.lit(k % 2 == 1))
        return answer


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the winning key, else null) and verdict. ``rules``: host, path, verdict (block or allow).

    Output columns replace input columns of the same name; any other input column stays, whatever its name.
    """
    rules = rules.where(F.length("host") > 0).select(F.concat("host", F.coalesce("path", F.lit(""))).alias("key"), "verdict", F.size(F.split("host", r"\.")).alias("labels"), F.length(F.coalesce("path", F.lit(""))).alias("long")).distinct()
    rules = written(rules, "rules")
    shapes = sorted(tuple(r) for r in rules.select("labels", "long").distinct().collect())  # few: pairs of small numbers
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_path(F.col(f"`{url_col}`"))
    out = pages.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("own"), host.alias("host"), path.alias("path"))

    def key(labels: int, long: int) -> Column:
        fits = (F.size(F.split("host", r"\.")) >= labels) & (F.length("path") >= long) & (F.col("host") != "")
        return F.when(fits, F.struct(F.concat(F.substring_index("host", ".", -labels), F.substring("path", 1, long)).alias("key"), F.lit(long).alias("long")))

    names = [F.col(f"own.`{c}`").alias(c) for c in own]
    if not shapes:
        return out.select(*names, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = F.filter(F.array(*(key(a, b) for a, b in shapes)), lambda k: k.isNotNull())
    universe = out.select(F.explode(keys).alias("k")).select("k.key")
    queried = universe.count()
    block, allow = (Cascade(rules.where(F.col("verdict") == v), universe, queried) for v in ("block", "allow"))

    def judged(k: Column) -> Column:
        verdict = F.when(block.contains(k["key"]), "block").when(allow.contains(k["key"]), "allow")
        return F.struct(F.length(k["key"]).alias("a"), (F.length(k["key"]) - k["long"]).alias("b"), k["key"].alias("key"), verdict.alias("verdict"))

    best = F.array_max(F.filter(F.transform(keys, judged), lambda x: x["verdict"].isNotNull()))
    out = out.withColumn("best", best)
    return out.select(*names, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op6_url_rules(spark, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS t(host, path, verdict)")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, r FROM rest),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM cut),
fits AS (
  SELECT page_id, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""
