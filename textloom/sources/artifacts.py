"""Artifacts: one gzip JSON file for each key, written by a data source and read, listed and swept as tables."""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BooleanType, StructField, StructType

from .shared import stored

#: The ending of a file that a task is still writing.
IN_FLIGHT = ".inprogress"
#: The form of a key: it can't leave its folder.
KEY = r"^(?:[A-Za-z0-9_-][A-Za-z0-9_.-]*/)*[A-Za-z0-9_-][A-Za-z0-9_.-]*\.json\.gz$"
#: Where packs lie in a folder; they are no objects.
PACKS = "_pipeline/packs/"
LISTED = "key string, mtime timestamp, size bigint"
#: Entries of a listing, and characters of contents, that a task passes on at once.
LISTED_AT_ONCE, FETCHED_BYTES = 8192, 16 << 20


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if folder.startswith("file:") and "://" not in folder:
        folder = folder.removeprefix("file:")
    files, root = fs.FileSystem.from_uri(folder)
    return files, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    keys: int
    folder: str


class ArtifactSource(DataSource):
    """Format "artifacts": rows (key, payload) become gzip files at their keys in the folder of option path."""

    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        if schema.simpleString() != "struct<key:string,payload:string>":
            raise ValueError(f"artifacts have key and payload, not {schema.simpleString()}")
        if overwrite:
            raise ValueError("artifacts are added by key; mode append")
        return ArtifactWriter(self.options["path"])


class ArtifactWriter(DataSourceWriter):
    """Each file is written under another name and then moved to its key, with bytes that depend on its payload only.

    So a task that runs twice, or two tasks with one key and content, leave one whole file, and a
    reader never sees a part of one. There is nothing to do at the commit; an aborted job leaves artifacts
    that are right, and at most files in flight, which no listing shows.
    """

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        files, root = _files(self.path)
        made: set[str] = set()
        n = 0
        for row in iterator:
            key, payload = row["key"], row["payload"]
            if key is None or payload is None or not re.match(KEY, key) or ".." in key:
                raise ValueError(f"no artifact: {key!r}")
            folder, _, name = f"{root}/{key}".rpartition("/")
            if folder not in made:
                files.create_dir(folder, recursive=True)
                made.add(folder)
            part = f"{folder}/{name}.{uuid.uuid4().hex}{IN_FLIGHT}"
            with files.open_output_stream(part, compression=None) as out:
                out.write(gzip.compress(payload.encode(), mtime=0))
            files.move(part, f"{root}/{key}")
            n += 1
        return Written(n, self.path)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


def write_artifacts(artifacts: DataFrame, folder: str) -> None:
    """Writes rows (key, payload); of several rows of a key, the greatest payload. The folder is one that all executors reach."""
    artifacts.sparkSession.dataSource.register(ArtifactSource)
    once = artifacts.groupBy("key").agg(F.max("payload").alias("payload"))
    once.write.format("artifacts").mode("append").save(folder)


def _level(folders: DataFrame, folder: str) -> DataFrame:
    """What lies in these folders (key, relative to the folder): key, mtime, size, inside (whether it is a folder). Run in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            for at in batch.column("key").to_pylist():
                found = files.get_file_info(fs.FileSelector(f"{root}/{at}".rstrip("/"), allow_not_found=True))
                for begin in range(0, len(found), LISTED_AT_ONCE):
                    some = found[begin : begin + LISTED_AT_ONCE]
                    keys = [x.path[len(root) + 1 :] for x in some]
                    times = pa.array([x.mtime_ns // 1000 if x.mtime_ns is not None else None for x in some], pa.int64()).cast(pa.timestamp("us", "UTC"))
                    arrays = [pa.array(keys, pa.string()), times, pa.array([x.size for x in some], pa.int64()), pa.array([x.type == fs.FileType.Directory for x in some], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["key", "mtime", "size", "inside"])

    return folders.mapInArrow(run, f"{LISTED}, inside boolean")


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """key, mtime, size of the files in a folder, at any depth, but those in flight; contents aren't read. A folder that isn't there is empty, and packs aren't listed.

    Folders are listed level by level in tasks, and each level is stored, so no list of files comes to the driver.
    """
    folders, found = spark.createDataFrame([("",)], "key string"), None
    while True:
        level = stored(spark, _level(folders, folder))
        found = level if found is None else found.unionByName(level)
        inside = level.filter("inside").select("key").filter(F.col("key") != PACKS.rstrip("/"))
        if inside.isEmpty():
            break
        folders = inside.repartition(F.xxhash64("key"))
    return found.filter("not inside").drop("inside").filter(~F.endswith("key", F.lit(IN_FLIGHT)) & ~F.startswith("key", F.lit(".tmp/")))


def held_keys(keys: DataFrame, folder: str) -> DataFrame:
    """keys with held: whether there is an object at its key. Asked for each by itself, in tasks; nothing is listed."""
    schema = StructType([*keys.schema.fields, StructField("held", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        for batch in batches:
            paths = [f"{root}/{key}" for key in batch.column("key").to_pylist()]
            held = [x.type == fs.FileType.File for x in files.get_file_info(paths)] if paths else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, pa.bool_())], names=schema.names)

    return keys.mapInArrow(run, schema)


def read_artifacts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """key and rows (array of structs, by the schema) of the artifacts in a folder: one JSON array each. Fields that a file
    doesn't have are null; a file that holds no array has null rows."""
    keys = list_objects(spark, folder).filter(F.endswith("key", F.lit(".json.gz"))).select("key")
    return fetch_artifacts(keys, folder, schema)


# The fields of a stored chunk.
CHUNK = "chunk_index: bigint, text: string, token_count: bigint, page_number: int, section: string, labels: array<string>, embedding: array<float>"


def chunk_artifacts(chunks: DataFrame) -> DataFrame:
    """key, payload of the chunks (key and the fields of CHUNK they have) of each key, in order of chunk_index; null fields are left out."""
    named = [c for c in (x.split(":")[0].strip() for x in CHUNK.split(", ")) if c in chunks.columns]
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", F.struct(*named).alias("row"))))  # of one document
    return chunks.groupBy("key").agg(F.to_json(F.transform(rows, lambda r: r["row"])).alias("payload"))


def load_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """key and the fields of CHUNK of each stored chunk, in rows; missing labels are an empty array."""
    rows = read_artifacts(spark, folder, CHUNK).select("key", F.explode("rows").alias("r")).select("key", "r.*")
    return rows.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def fetch_artifacts(keys: DataFrame, folder: str, schema: str = CHUNK) -> DataFrame:
    """key and rows of the artifacts at these keys (key), each read by itself; rows are null where there is none.

    For a part of a folder; read_artifacts reads all of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        keys: list[str] = []
        found: list[str | None] = []
        size = 0
        for key in (x for batch in batches for x in batch.column("key").to_pylist()):
            try:
                with files.open_input_stream(f"{root}/{key}", compression=None) as held:
                    found.append(gzip.decompress(held.read()).decode())
            except FileNotFoundError:
                found.append(None)
            keys.append(key)
            size += len(found[-1] or "")
            if size > FETCHED_BYTES or len(keys) == LISTED_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "payload"])
                keys, found, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "payload"])

    wanted = keys.select("key").filter(F.col("key").isNotNull()).distinct()
    return wanted.mapInArrow(run, "key string, payload string").select("key", F.from_json("payload", f"array<struct<{schema}>>").alias("rows"))
