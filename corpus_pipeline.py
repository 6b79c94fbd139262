"""The corpus pipeline: documents in, packed sequences out, each stage a table of its own.

Stages, in order: language ID (texts that it rejects go), SimHash near-duplicates (found by vantage-point trees over wide
fingerprints, linked at a Jaccard similarity of five-word shingles of 0.8 or more; the document with the smallest id of each component stays), benchmark decontamination (hit spans are cut, mostly copied texts go),
secret scans (secrets are replaced by a mark) and retrieval packing. All but the last return the
columns of ``documents``.

Edge cases: a null, empty or letterless text has no language and goes with the first stage; a null id stays null and ranks after
all ids among near-duplicates; of rows with equal id and text one stays; a text that decontamination empties goes; very long texts are
handled whole; other columns of any name keep their values; an empty table gives empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.llm import decontam, jaccard, langid, packing, secrets
from mediaframe.llm.common import table, texts, whole_row, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    got = langid.predict(docs.select(whole_row(docs).alias("row"), F.col("text").alias("text")), model)
    return got.where(~F.col("lang_rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays, once if its row repeats. A null id ranks after all ids, as a document of its own text."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    key = F.coalesce("doc_id", mark.bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))
    keyed = docs.select(whole_row(docs).alias("row"), key.alias("key"), mark.alias("mark"), F.col("text").alias("text"))
    kept = jaccard.near_duplicates(texts(keyed, "key")).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key", "mark"]).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.trained(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(texts(docs), packing.word_tokenizer())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

# Centroids, vantage-point trees, forests and retrieval have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
