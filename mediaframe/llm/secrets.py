"""Secret scanning with a random forest that removes false positives, in DataFrame expressions alone.

Candidates are runs of 16 or more characters of keys and hashes (a name before an equals sign is apart from its value),
quoted values of 4 or more characters after a secret's name, and shorter runs of 4 or more that are assigned to such a
name or glued to any name by an equals sign. The words around are the 40 characters on each side in the whole text. Features: length, shares of
character kinds, transitions between kinds, distinct characters, cover by common word pieces, path
and URL signs, and the words around. The forest is trained in the JVM on labelled findings
(generated from fixed templates: keys in several notations against hashes, identifiers, paths, prose and
placeholders; what the extractor itself finds in them is learned) and its trees become one SQL expression, so scoring is a projection: no shuffle, no Python.

Edge cases: null and empty texts have no candidates and stay as they are; candidates are numbered by
position; repeated rows give repeated findings; a text with many secrets is handled in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts, whole_row, written

AROUND = 40
# Word pieces and neighbouring words.
PIECES = "tion|ment|ing|the|and|ent|ion|her|for|tha|ter|ers|ate|est|all|ver|ich|sch|ein|der|die|und|che|les|que|ado|nte|con|par|ous|ous|able|over|ness|pre|pro|com|app|user|data|test|name|file|value|your|here|example"
SECRET_WORDS = "token|secret|passw|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|bearer|credential|signing"
RUN = "A-Za-z0-9+/_\\-"
LONG = f"(?<![{RUN}])(?:[{RUN}]{{16,}}+(?:={{1,2}}(?![{RUN}=]))?|[{RUN}]{{15}}=(?![{RUN}=])|[{RUN}]{{14}}==(?![{RUN}=]))"
NAMED = f"(?i:{SECRET_WORDS})[A-Za-z0-9_-]{{0,24}}[\"'`]?\\s{{0,2}}[=:]>?\\s{{0,2}}"
QUOTED = f"(?<=[\"'`])(?<={NAMED}[\"'`])[^\\s\"'`]{{4,}}+(?=[\"'`])"
SHORT = f"(?<![{RUN}])(?<=[=:>]\\s{{0,2}})(?:(?<=[{RUN}]=)|(?<={NAMED}))[{RUN}]{{4,15}}+(?![{RUN}])"
CANDIDATE = f"(?:{QUOTED}|{LONG}|{SHORT})"
OTHER_WORDS = "sha-?[0-9]+|md5|commit|checksum|digest|hash|uuid|guid|version|build|isbn|order|tracking|invoice|phone|card|revision|etag|file|path|url|href"


def features(found: Column, before: Column, after: Column) -> dict[str, Column]:
    size = F.length(found).cast("double")
    low, near = F.lower(found), F.lower(before)

    def share(pattern: str) -> Column:
        return (size - F.length(F.regexp_replace(found, pattern, ""))) / size

    return {
        "length": size,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[^A-Za-z0-9]"),
        "hex": (~found.rlike("[^0-9a-fA-F]")).cast("double"),
        "transitions": F.length(F.regexp_replace(found, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")) / size,
        "distinct": F.size(F.array_distinct(F.split(found, ""))) / size,
        "dictionary": (size - F.length(F.regexp_replace(low, PIECES, ""))) / size,
        "vowels": (size - F.length(F.regexp_replace(low, "[aeiou]", ""))) / size,
        "path": (found.rlike("^/|/.*/") | before.rlike("[/.@:]$") & ~before.rlike(":$")).cast("double"),
        "secret_word": near.rlike(f"({SECRET_WORDS})[^\\n]{{0,16}}$").cast("double"),
        "other_word": near.rlike(f"\\b({OTHER_WORDS})\\b[^\\n]{{0,8}}$").cast("double"),
        "assigned": before.rlike("[=:]>?\\s*[\"'`]?$").cast("double"),
        "name": after.rlike("^[\"'`]?\\s?[=:]").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled findings (found, before, after, label): what the extractor finds in ``n`` texts from templates and hashes of their number.

    A finding within the template's value, or around it, has its label; others, as a long key name, are no secrets."""
    a, b = "sha1(cast(id as string))", "sha2(concat('k', id), 256)"
    mixed = f"substring(translate(base64(unhex({b})), '+/=', 'xYz'), 1, cast(20 + id % 21 as int))"
    word = "element_at(array('tion','ver','ing','stand','ment','haus','eau','cion','ble','under','schaft','queen','ther','able','onder','lich'), cast(1 + pmod(xxhash64(id, {0}), 16) as int))"
    prose = "concat(" + ", ".join(word.format(k) for k in range(6)) + ")"
    kinds = [  # found, before, after, label
        (a, "concat(' token = ', '\"')", "'\" '", 1),
        (f"upper({a})", "'!! TOKEN = \"'", "'\"!! '", 1),
        (mixed, "concat('api_key: ', if(id % 3 = 0, '\"', ''))", "if(id % 3 = 0, '\"', ' ')", 1),
        (f"concat('AKIA', upper(substring({mixed}, 1, 16)))", "'aws_access_key_id='", "' '", 1),
        (f"concat('ghp_', {mixed})", "'git clone with '", "' and'", 1),
        (mixed, "'Authorization: Bearer '", "' '", 1),
        (f"substring({mixed}, 1, 18)", "'password = \"'", "'\"'", 1),
        (f"substring({b}, 1, 32)", "'client_secret=\\''", "'\\' '", 1),
        (f"concat('sk_live_', {mixed})", "'key \"'", "'\"'", 1),
        (a, "concat(element_at(array('AWS_SECRET_ACCESS_KEY', 'client_secret_value', 'GITHUB_API_TOKEN_PRODUCTION'), cast(1 + id % 3 as int)), if(id % 2 = 0, ' = \"', ': '))", "if(id % 2 = 0, '\" ', ' ')", 1),
        (mixed, "concat(element_at(array('AWS_SECRET_ACCESS_KEY', 'client_secret_value', 'database_password_primary'), cast(1 + id % 3 as int)), if(id % 2 = 0, '=', ' = '))", "' '", 1),
        (f"substring({mixed}, 1, cast(6 + id % 10 as int))", "concat(element_at(array('password', 'db_password', 'auth_token'), cast(1 + id % 3 as int)), if(id % 2 = 0, ' = \"', ': '))", "if(id % 2 = 0, '\" ', ' ')", 1),
        (f"substring(concat(substring({mixed}, 1, 5), '!@', substring({mixed}, 6)), 1, cast(8 + id % 8 as int))", "'password = \"'", "'\" '", 1),
        (b, "concat(element_at(array('RELEASE_FILE_CHECKSUM', 'artifact_build_digest'), cast(1 + id % 2 as int)), if(id % 2 = 0, ' = \"', ': '))", "if(id % 2 = 0, '\" ', ' ')", 0),
        (word.format(11), "concat('the ', element_at(array('token', 'secret', 'password', 'credential'), cast(1 + id % 4 as int)), ': ')", "' and'", 0),
        (f"concat({word.format(12)}, {word.format(13)})", "concat('the ', element_at(array('token', 'secret', 'password', 'auth'), cast(1 + id % 4 as int)), ' = \"')", "'\" was'", 0),
        (f"concat({word.format(14)}, {word.format(15)})", "'https://example.com/?page='", "' '", 0),
        (a, "'fixed in commit '", "' by'", 0),
        (b, "'sha256: '", "' '", 0),
        (f"substring({b}, 1, 32)", "'md5 checksum = \"'", "'\"'", 0),
        (f"concat_ws('-', substring({a}, 1, 8), substring({a}, 9, 4), substring({a}, 13, 4), substring({a}, 17, 12))", "'uuid '", "' was'", 0),
        (prose, "'and the '", "' of'", 0),
        (f"upper({prose})", "'AND THE '", "' OF'", 0),
        (f"upper({prose})", "'TOKEN!! AND!! THE!! '", "'!! OF'", 0),
        (f"upper(substring({prose}, 1, 17))", "'LA!! '", "'!! DE!!'", 0),
        (f"initcap({prose})", "'is. '", "' and'", 0),
        (f"concat({prose}, '-', {prose})", "'see the '", "', which'", 0),
        (f"concat('/usr/', {word.format(7)}, '/', {prose})", "'in file '", "' is'", 0),
        (f"concat({word.format(8)}, '/', {prose}, '/', {word.format(9)})", "'https://example.com/'", "' '", 0),
        ("cast(1000000000000000 + pmod(xxhash64(id), 8999999999999999) as string)", "'card '", "' '", 0),
        ("cast(1000000000000000 + pmod(xxhash64(id), 8999999999999999) as string)", "'of the '", "' and'", 0),
        ("repeat(substring('-=_xX', cast(1 + id % 5 as int), 1), cast(16 + id % 30 as int))", "'token: '", "' '", 0),
        ("element_at(array('your-token-here-please', 'example_api_key_value', 'replace_with_your_secret', 'test_password_example'), cast(1 + id % 4 as int))", "'token = \"'", "'\"'", 0),
        (f"concat('get', initcap({word.format(3)}), initcap({word.format(4)}), 'ForUserName')", "'call '", "'('", 0),
        (f"concat('token_', {word.format(5)}, '_', {prose})", "'the column '", "' holds'", 0),
    ]
    pick = lambda k: "CASE pmod(id, {0}) ".format(len(kinds)) + " ".join(f"WHEN {i} THEN {x[k]}" for i, x in enumerate(kinds)) + " END"
    rows = spark.range(0, n, 1, 1).selectExpr(f"{pick(0)} AS value", f"{pick(1)} AS before", f"{pick(2)} AS after", f"cast({pick(3)} as double) AS label")
    gaps, found = parts(F.concat("before", "value", "after"))
    rows = rows.select("value", "label", gaps.alias("gaps"), found.alias("cands"))
    flat = rows.select("value", "label", F.explode(F.transform("cands", lambda c, i: F.struct(c.alias("found"), *(x.alias(k) for k, x in zip(("before", "after"), around(F.col("gaps"), F.col("cands"), i)))))).alias("hit"))
    same = F.col("value").contains(F.col("hit.found")) | F.col("hit.found").contains(F.col("value"))
    return flat.select("hit.found", "hit.before", "hit.after", F.when(same, F.col("label")).otherwise(0.0).alias("label"))


def forest(findings: DataFrame, trees: int = 12, depth: int = 5) -> tuple[list[str], list]:
    """Feature names and the trees (feature, threshold, left, right) or leaf probability, trained on ``findings``."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    own = features(F.col("found"), F.col("before"), F.col("after"))
    names = list(own)
    # The few thousand findings and their features are written, as training reads them again for every level of the trees.
    rows = written(written(findings, "findings").select("label", *(c.alias(n) for n, c in own.items())), "findings-features")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11).fit(VectorAssembler(inputCols=names, outputCol="x").transform(rows))

    def walk(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / max(sum(stats), 1e-12)
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return names, [walk(t._call_java("rootNode")) for t in model.trees]


def score(names: list[str], trees: list, own: Column) -> Column:
    """Mean probability of the trees; ``own``: a struct with the features."""

    def case(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        k, threshold, left, right = node
        return F.when(own[names[k]] <= threshold, case(left)).otherwise(case(right))

    return sum((case(t) for t in trees[1:]), case(trees[0])) / len(trees)


def parts(text: Column) -> tuple[Column, Column]:
    """What lies between the candidates (one more than they are), and the candidates."""
    return F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def around(gaps: Column, found: Column, i: Column) -> tuple[Column, Column]:
    """The AROUND characters before and after candidate ``i`` in the whole text."""
    # A candidate has 4 characters or more and a gap within the text 1, so this many steps cover AROUND characters.
    steps = -(-AROUND // 5)
    at = lambda a, k: F.coalesce(F.get(a, i + F.lit(k)), F.lit(""))
    own, next_ = at(gaps, 0), at(gaps, 1)
    back = F.concat(*(x for k in range(steps, 0, -1) for x in (at(gaps, -k), at(found, -k))), own)
    on = F.concat(next_, *(x for k in range(1, steps + 1) for x in (at(found, k), at(gaps, k + 1))))
    before = F.when(F.length(own) >= AROUND, F.right(own, F.lit(AROUND))).otherwise(F.right(back, F.lit(AROUND)))
    after = F.when(F.length(next_) >= AROUND, F.left(next_, F.lit(AROUND))).otherwise(F.left(on, F.lit(AROUND)))
    return before, after


def scored(gaps: Column, found: Column, model: tuple[list[str], list]) -> Column:
    """array<struct<found, before, score>> of the candidates."""
    names, trees = model

    def one(c: Column, i: Column) -> Column:
        # Bound by a lambda, the words around are built once, not for every feature.
        before, after = around(gaps, found, i)
        return F.get(F.transform(F.array(F.struct(before.alias("b"), after.alias("a"))), lambda x: with_features(c, x["b"], x["a"])), F.lit(0))

    def with_features(c: Column, before: Column, after: Column) -> Column:
        return F.struct(c.alias("found"), before.alias("before"), F.struct(*(x.alias(n) for n, x in features(c, before, after).items())).alias("own"))

    with_own = F.transform(found, one)
    return F.transform(with_own, lambda x: F.struct(x["found"].alias("found"), x["before"].alias("before"), score(names, trees, x["own"]).alias("score")))


def findings(docs: DataFrame, model: tuple[list[str], list], limit: float = 0.5) -> DataFrame:
    """One row per candidate of ``docs`` (doc_id, text): doc_id, number, start (characters before it), length, found, before, score, secret."""
    names, trees = model
    gaps, found = parts(F.col("text"))
    rows = docs.where(F.col("text").rlike(CANDIDATE)).select("doc_id", gaps.alias("gaps"), found.alias("cands"))

    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    block = 256
    sizes = F.zip_with(F.slice("gaps", F.lit(1), F.size("cands")), "cands", lambda g, c: F.length(g) + F.length(c))
    blocks = lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / block).cast("int")), lambda b: total(F.slice(n, b * block + F.lit(1), F.lit(block))))

    def hits(x: Column) -> Column:
        def hit(c: Column, i: Column) -> Column:
            before, after = around(F.col("gaps"), F.col("cands"), i)
            # The sizes of whole blocks of candidates before this one, then of those in its own block: no sum over all before.
            start = total(F.slice(x["blocks"], F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(x["sizes"], i - i % block + F.lit(1), i % block)) + F.length(F.get("gaps", i))
            return F.struct(i.alias("number"), start.cast("long").alias("start"), c.alias("found"), before.alias("before"), after.alias("after"))

        return F.transform("cands", hit)

    # Bound by lambdas, the sizes and their sums are computed once a text.
    bound = F.transform(F.transform(F.array(sizes), lambda n: F.struct(n.alias("sizes"), blocks(n).alias("blocks"))), hits)
    rows = rows.select("doc_id", F.get(bound, F.lit(0)).alias("hits"))
    # An outer explode: for an inner one the optimizer would filter on the array's size, and build the array twice.
    flat = rows.select("doc_id", F.explode_outer("hits").alias("hit")).where("hit is not null").select("doc_id", "hit.*")
    own = F.struct(*(c.alias(n) for n, c in features(F.col("found"), F.col("before"), F.col("after")).items()))
    # Bound by a lambda, the features are computed once; as a plain column they would be copied into every split of the trees.
    out = flat.withColumn("score", F.get(F.transform(F.array(own), lambda x: score(names, trees, x)), F.lit(0)))
    return out.select("doc_id", "number", "start", F.length("found").cast("long").alias("length"), "found", "before", "score", (F.col("score") >= limit).alias("secret"))


def redact(docs: DataFrame, model: tuple[list[str], list], limit: float = 0.5, text_col: str = "text", length_col: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; other rows, and false positives, stay as they are. ``length_col``, if there, follows the new text."""
    text = F.col(f"row.`{text_col}`")
    gaps, found = parts(text)
    has = text.rlike(CANDIDATE)
    out = docs.select(whole_row(docs).alias("row")).withColumns({"gaps": F.when(has, gaps), "cands": F.when(has, found)})
    out = out.withColumn("hits", scored(F.col("gaps"), F.col("cands"), model))
    any_ = F.coalesce(F.exists("hits", lambda h: h["score"] >= limit), F.lit(False))
    kept = F.transform("hits", lambda h: F.when(h["score"] >= limit, mark).otherwise(h["found"]))
    again = F.concat(F.get("gaps", F.lit(0)), F.array_join(F.zip_with(kept, F.slice("gaps", F.lit(2), F.greatest(F.size("gaps") - F.lit(1), F.lit(0))), lambda c, g: F.concat(c, g)), ""))
    new = {text_col: F.when(any_, again).otherwise(text)}
    if length_col in docs.columns:
        new[length_col] = F.when(any_, F.length(again).cast(docs.schema[length_col].dataType)).otherwise(F.col(f"row.`{length_col}`"))
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def trained(spark: SparkSession) -> tuple[list[str], list]:
    return forest(labelled_findings(spark))


def op8_secret_forest(spark, sf_dir: str) -> DataFrame:
    """Every candidate with its score and verdict; the candidate itself as a hash."""
    got = findings(texts(table(spark, sf_dir, "documents")), trained(spark))
    return got.select("doc_id", "number", "start", "length", F.sha2(F.col("found").cast("binary"), 256).alias("found_sha256"), F.round("score", 9).alias("score"), "secret")
