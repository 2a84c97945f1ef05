"""Shared plumbing: table access, shared-folder materialisation, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space of the word definition, as a Java/RE2 character class body.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast only when its counted rows stay below this.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only where none is set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='geoloom-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``parts``: at most so many files, for results known to be small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._geoloom_path = path
    return back


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_geoloom_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def attach(big: DataFrame, small: DataFrame, key: str, rows: int, how: str = "inner", salts: int = 32) -> DataFrame:
    """Join ``small`` (one row a key, ``rows`` of them by count) to ``big`` by a null-safe key.

    Up to BROADCAST_ROWS rows it is broadcast.  Beyond that both sides are
    dealt by (key, salt), so that a key with a third of all rows is spread
    over ``salts`` tasks.
    """
    right = small.withColumnRenamed(key, "__key")
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(right), big[key].eqNullSafe(right["__key"]), how).drop("__key")
    left = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns[:1]), F.lit(salts)).cast("int"))
    right = right.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = left[key].eqNullSafe(right["__key"]) & (left["__salt"] == right["__slot"])
    return left.join(right, on, how).drop("__key", "__salt", "__slot")


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """Only the columns that an operator reads, so that clashing extra columns do no harm."""
    return docs.select("doc_id", "text", *extra)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no plan refers to any more."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
