"""Sinks that replace or add the rows of documents, told by counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import stored

#: Folders of a table; a document's rows lie in the one of its hash.
BUCKETS = 64
COUNTS = "n_deleted bigint, n_inserted bigint"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a table (without its bucket); none where nothing was written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, bucket int").parquet(path).drop("bucket")


def _write(rows: DataFrame, path: str, mode: str) -> None:
    dealt = rows.repartition("bucket", F.pmod(F.monotonically_increasing_id(), F.lit(4)))  # a large bucket is four files
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def replace_documents(fresh: DataFrame, path: str, key: str = "document_id", buckets: int = BUCKETS) -> DataFrame:
    """Puts the rows of fresh in the place of all rows of the same keys in the table, and gives key, n_deleted, n_inserted.

    Only the buckets of fresh keys are read and written again (dynamic overwrite of their folders), after
    what they will hold has been stored elsewhere. Running it twice changes nothing the second time, but the
    counts say that as many rows went as came. Without rows nothing is written. Null keys are an error.
    """
    spark, schema = fresh.sparkSession, ", ".join(f"`{c}` {t}" for c, t in fresh.dtypes)
    key_type = dict(fresh.dtypes)[key]
    checked = F.coalesce(F.col(key), F.raise_error(F.lit(f"a row without {key}")).cast(key_type))
    fresh = stored(spark, fresh.withColumn(key, checked).withColumn("bucket", bucket_of(key, buckets)))
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
    if not touched:
        return spark.createDataFrame([], f"{key} {key_type}, {COUNTS}")
    keys = fresh.select(key).distinct()
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    counts, after = count(fresh, "n_inserted").withColumn("n_deleted", F.lit(0).cast("bigint")), fresh
    if _exists(spark, path):
        old = spark.read.schema(f"{schema}, bucket int").parquet(path).filter(F.col("bucket").isin(touched))
        gone = count(old.join(keys, key, "left_semi"), "n_deleted")
        counts = count(fresh, "n_inserted").join(gone, key, "left_outer").withColumn("n_deleted", F.coalesce("n_deleted", F.lit(0)))
        after = stored(spark, fresh.unionByName(old.join(keys, key, "left_anti")))
    counts = stored(spark, counts.select(key, "n_deleted", "n_inserted"))
    _write(after, path, "overwrite")
    return counts


def insert_documents(rows: DataFrame, path: str, key: str = "document_id", buckets: int = BUCKETS) -> int:
    """Adds rows to the table and gives their number; without rows nothing is written."""
    made = stored(rows.sparkSession, rows.withColumn("bucket", bucket_of(key, buckets)))
    n = made.count()
    if n:
        _write(made, path, "append")
    return n


def delete_documents(keys: DataFrame, path: str, schema: str, key: str = "document_id") -> DataFrame:
    """Deletes the rows of these keys and gives key, n_deleted of each distinct one (0 where it has no rows)."""
    spark = keys.sparkSession
    wanted = stored(spark, keys.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("bucket", bucket_of(key)))
    none = wanted.select(key, F.lit(0).cast("bigint").alias("n_deleted"))
    if not _exists(spark, path):
        return none
    touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
    old = spark.read.schema(f"{schema}, bucket int").parquet(path).filter(F.col("bucket").isin(touched))
    gone = old.join(wanted.select(key), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_deleted"))
    counts = stored(spark, wanted.select(key).join(gone, key, "left_outer").select(key, F.coalesce("n_deleted", F.lit(0)).alias("n_deleted")))
    rest = stored(spark, old.join(wanted.select(key), key, "left_anti"))
    left = {r[0] for r in rest.select("bucket").distinct().collect()}
    if left:
        _write(rest, path, "overwrite")
    _drop_buckets(spark, path, [b for b in touched if b not in left])
    return counts


def _drop_buckets(spark: SparkSession, path: str, buckets: list[int]) -> None:
    """Removes the folders of buckets that have no row left; a dynamic overwrite leaves those alone."""
    for b in buckets:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
