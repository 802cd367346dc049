"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read again: a lost executor costs no recomputation."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of texts that go to a Python worker at once; longer texts go alone.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES, so that whole texts don't pile up in workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now)
    if not 0 < number <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Bits of a row's place in its file, below those of its file.
PLACE_BITS = 32
#: Nodes of a plan that give each row of a scan at most once.
PLAIN_NODES = frozenset(("Project", "Filter", "SubqueryAlias", "LogicalRelation"))


def whole(docs: DataFrame) -> Column:
    """doc: a struct of all columns, out of the way of other names."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def fields(docs: DataFrame, names: list[str] | None = None) -> list[Column]:
    """The columns of docs (or those named) out of doc."""
    return [F.col("doc").getField(c).alias(c) for c in (docs.columns if names is None else names)]


def struct_type(docs: DataFrame) -> str:
    return "struct<" + ", ".join(f"`{c}`: {t}" for c, t in docs.dtypes) + ">"


def numbered(docs: DataFrame) -> DataFrame:
    """doc (struct of the columns of docs) and _row: a number of each row that is the same in every job, however a scan is split among tasks.

    Rows of a Parquet scan are numbered by their file and their place in it. Other inputs are stored with their numbers.
    """
    bounded_batches(docs.sparkSession)
    place = _place(docs)
    if place is not None:
        return docs.select(whole(docs), place.alias("_row"))
    return stored(docs.sparkSession, docs.select(whole(docs), F.monotonically_increasing_id().alias("_row")))


def _place(docs: DataFrame) -> Column | None:
    """A number of each row from the metadata of its file; None if docs isn't a plain scan of one Parquet path."""
    node = docs._jdf.queryExecution().analyzed()
    plain = "_metadata" not in docs.columns and node.deterministic()
    while plain and node.nodeName() in PLAIN_NODES and node.children().size() == 1:
        node = node.children().apply(0)
    if not plain or node.nodeName() != "LogicalRelation":
        return None
    relation = node.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or "ParquetFileFormat" not in relation.fileFormat().getClass().getName() or relation.location().rootPaths().size() != 1:
        return None
    path, index = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    code = lambda of, seed: F.xxhash64(of, F.lit(seed)).bitwiseAND((1 << 63 - PLACE_BITS) - 1)
    files = docs.select(path.alias("path")).groupBy("path").count()
    counts = files.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(code("path", k)).alias(f"n{k}") for k in range(4))).first()
    seed = next((k for k in range(4) if counts[f"n{k}"] == counts["n"]), None)  # one by which no two files share a code
    return None if seed is None else F.shiftleft(code(path, seed), PLACE_BITS).bitwiseOR(index)
