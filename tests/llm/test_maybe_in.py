"""The bitmap before a join keeps every wanted key and drops nearly all others."""

from mediaframe.llm.common import maybe_in


def test_no_wanted_key_is_lost(spark):
    rows = spark.range(20_000).selectExpr("if(id = 7, null, id - 500) AS doc_id", "concat('t', id) AS text")
    wanted = rows.where("doc_id % 10 = 3 or doc_id is null").select("doc_id").distinct()
    got = maybe_in(rows, "doc_id", wanted)
    assert got.columns == rows.columns and got.exceptAll(rows).count() == 0
    assert got.join(wanted, got.doc_id.eqNullSafe(wanted.doc_id), "left_semi").count() == wanted.count()
    assert wanted.count() <= got.count() < 2_100
    assert maybe_in(rows, "doc_id", wanted, 1 << 15).where("doc_id % 10 = 3").count() == wanted.count() - 1  # crowded, and still none lost
    assert maybe_in(rows, "doc_id", wanted.limit(0)).count() == 0
