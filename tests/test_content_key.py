"""Keys of texts longer than the first and last MiB."""

import hashlib


def test_long_texts_have_keys(spark, tmp_path):
    from mediaframe.plans.queries import queries

    mib = 1 << 20
    texts = ["", "short", "a" * mib, "é" + "b" * mib, "x" * mib + "middle" + "y" * mib]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha1(b).hexdigest()
    want = {i: sha((str(len(b)) + sha(b[:mib]) + sha(b[-mib:])).encode())[:16] for i, b in enumerate(t.encode() for t in texts)}
    assert {r.doc_id: r.key for r in queries()["content_key"](spark, str(tmp_path)).collect()} == want
