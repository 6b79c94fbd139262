"""What the operators share: the shared folder, written tables, column helpers.

Executors may be lost at any time and share no local disk with each other or with the driver, so
whatever outlives a stage goes to the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path (URI) below ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mediaframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and its path."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    return stored(df, tag)[0]


def remove(uri: str) -> None:
    """Delete a table that ``stored`` wrote and that nothing reads any more."""
    fs, path = filesystem(uri)
    fs.delete_dir(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow's file system and path for a URI or a plain path; runs on executors too."""
    import pyarrow.fs as pafs

    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes) -> None:
    """Write a file under another name, then move it into place: attempts that die leave no half file under ``uri``."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}.tmp") as out:
        out.write(data)
    fs.move(tmp, path)


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows of ``df`` whose ``key`` is, or by its hash may be, among those of ``wanted`` (null among nulls), so that a join with ``wanted`` shuffles little else.

    A bitmap of ``bits`` (2 MB) goes to the executors, whatever the number of keys; the more keys, the more rows pass that the exact join then drops.
    """
    size = F.lit(bits)
    held = wanted.select(F.pmod(F.xxhash64(key), size).alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    rows = df.withColumn("_h", F.pmod(F.xxhash64(key), size)).withColumns({"_bucket": F.bitmap_bucket_number("_h"), "_at": F.bitmap_bit_position("_h")})
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(held), "_bucket").where(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1).select(*df.columns)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``text`` alone (null text: empty); whatever else the table has cannot clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def id_crc(col: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def slices(batch, column: int, most: int = 2_000_000, rows: int = 1 << 30):
    """Parts of an Arrow batch with about ``most`` bytes of text in ``column`` and at most ``rows`` rows each; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that helper columns beside it cannot clash with any of them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))
