"""An index of inverted lists for vector search: rows under the nearest of many centroids, searched in the lists nearest to a query.

Centroids come from a bounded sample (SAMPLE rows or SAMPLE_BYTES, those of the smallest id hashes). Every
row is assigned. How many lists a search must probe for a given recall is measured within the sample: few
where vectors form clusters, most of them where they don't. Rows of a list are packed into pieces of about PIECE_BYTES of vectors and stored in a
folder of their list, so a search reads the folders of probed lists only. Queries go to the executors in
blocks, and a product of two small matrices gives each query's best of a piece; where there are very many blocks, tiles of
queries meet the pieces of the lists they probe in a join. A list with a third of all rows is many pieces,
dealt by ranges, so no task holds a list, and nothing of rows or queries comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.shared import new_path, stored

from .lexeme_scores import Best

SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
#: Lists are as many as twice the root of the number of rows, within these; a list has ROWS_OF_SAMPLE rows of the sample at least, on average.
MOST_LISTS = 4096
ROWS_OF_SAMPLE = 8
STEPS = 8
#: Probes are as many as reach this recall of CALIBRATED neighbours for CALIBRATING queries within the sample.
RECALL = 0.94
CALIBRATED = 50
CALIBRATING = 512
PIECE_BYTES = 1 << 20
TILE_QUERIES = 1024

_PIECES = "list int, ids array<bigint>, vectors binary, owners array<string>, owner binary, documents array<bigint>"


@dataclass
class VectorIndex:
    """Where pieces are stored, the centroids (unit vectors), how many rows are indexed, and how many lists a search probes."""

    path: str
    centroids: np.ndarray
    rows: int
    probes: int


def _units(column: pa.Array, dimension: int) -> np.ndarray:
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != dimension).any():
        raise ValueError(f"vectors of {sorted(set(map(int, lengths)))} numbers, not {dimension}")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def fit_centroids(chunks: DataFrame, lists: int | None = None) -> tuple[np.ndarray, int, int]:
    """Unit centroids of a bounded sample by spherical k-means, the number of rows with a vector, and of probes."""
    whole = chunks.filter(F.col("embedding").isNotNull())
    size = whole.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size.n:
        return np.zeros((0, 0)), 0, 0
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size.d))))
    hashed = whole.select("embedding", F.xxhash64("chunk_id").alias("h"), "chunk_id")
    # hashes are even, so somewhat more than the share that is wanted has it; no other rows need be ordered
    low = hashed.filter(F.col("h") <= int(-(2**63) + 2**64 * (1.2 * most + 1000) / size.n)) if size.n > 1.2 * most + 1000 else hashed
    rows = low.orderBy("h", "chunk_id").limit(most).collect()
    if len(rows) < min(most, size.n):
        rows = hashed.orderBy("h", "chunk_id").limit(most).collect()
    x = np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1)
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
    n = lists or int(np.clip(round(2 * size.n**0.5), 1, min(MOST_LISTS, max(1, len(x) // ROWS_OF_SAMPLE))))
    centroids = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(STEPS):
        nearest = np.concatenate([(x[at : at + 4096] @ centroids.T).argmax(axis=1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / (norms + 1e-12), centroids)
    return centroids, size.n, _probes(x, centroids)


def _probes(x: np.ndarray, centroids: np.ndarray) -> int:
    """The number of nearest lists that hold RECALL of the nearest rows of a sample."""
    own, q = (x @ centroids.T).argmax(axis=1), x[:: max(1, len(x) // CALIBRATING)]
    k = min(CALIBRATED, len(x))
    near = own[np.argpartition(-(q @ x.T), k - 1, axis=1)[:, :k]]
    places = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(places, near, 1).ravel())
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


def _packer(dimension: int):
    """A function for mapInArrow that packs neighbouring rows of one list into pieces."""
    rows_of_piece = max(1, PIECE_BYTES // (8 * max(1, dimension)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("list").to_numpy()
            borders = np.flatnonzero(np.diff(lists)) + 1
            for begin, end in zip([0, *borders], [*borders, len(lists)], strict=True):
                for at in range(begin, end, rows_of_piece):
                    some = batch.slice(at, min(rows_of_piece, end - at))
                    owners = some.column("user_id").dictionary_encode()
                    codes = owners.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4")
                    arrays = [pa.array([int(lists[at])], pa.int32()), pa.array([some.column("chunk_id").to_pylist()], pa.list_(pa.int64()))]
                    arrays += [pa.array([b"".join(some.column("vector").to_pylist())], pa.binary()), pa.array([owners.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([codes.tobytes()], pa.binary()), pa.array([some.column("document_id").to_pylist()], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["list", "ids", "vectors", "owners", "owner", "documents"])

    return pack


def _given(chunks: DataFrame) -> DataFrame:
    """chunk_id, document_id, user_id, embedding of the rows with a vector; no document or owner where there is no such column."""
    owner = F.col("user_id").cast("string") if "user_id" in chunks.columns else F.lit(None).cast("string")
    document = F.col("document_id").cast("bigint") if "document_id" in chunks.columns else F.lit(None).cast("bigint")
    return chunks.filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("bigint"), document.alias("document_id"), owner.alias("user_id"), "embedding")


def build(chunks: DataFrame, lists: int | None = None, path: str | None = None) -> VectorIndex:
    """Indexes chunks (chunk_id, document_id, embedding and, for scoped searches, user_id); rows without a vector are left out."""
    spark = chunks.sparkSession
    centroids, n, probes = fit_centroids(chunks, lists)
    path = path or new_path(spark)
    held = spark.sparkContext.broadcast(centroids)
    dimension = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(batch.column("embedding"), dimension)
            near = (x @ held.value.T).argmax(axis=1).astype(np.int32)
            vectors = pa.array([v.tobytes() for v in x.astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(near), *(batch.column(c) for c in ("chunk_id", "document_id", "user_id")), vectors], names=["list", "chunk_id", "document_id", "user_id", "vector"])

    given = _given(chunks)
    if n:
        assigned = given.mapInArrow(assign, "list int, chunk_id bigint, document_id bigint, user_id string, vector binary")
        dealt = assigned.repartitionByRange("list", "chunk_id").sortWithinPartitions("list", "chunk_id")
        dealt.mapInArrow(_packer(dimension), _PIECES).write.partitionBy("list").parquet(path)
    else:
        spark.createDataFrame([], _PIECES).write.parquet(path)
    return VectorIndex(path, centroids, n, probes)


def _tiles(queries: DataFrame, index: VectorIndex, first: int, last: int, owned: bool) -> DataFrame:
    """list and a tile of the queries whose first-th to last-th nearest lists it is among."""
    spark, dimension = queries.sparkSession, index.centroids.shape[1]
    held = spark.sparkContext.broadcast(index.centroids)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_QUERIES):
                some = batch.slice(at, TILE_QUERIES)
                x = _units(some.column("embedding"), dimension)
                near = np.argsort(-(x @ held.value.T), axis=1, kind="stable")[:, first:last]
                ids, users, allowed = (some.column(c).to_pylist() for c in ("query_id", "user_id", "document_ids"))
                for one in np.unique(near):
                    own = np.flatnonzero((near == one).any(axis=1))
                    arrays = [pa.array([int(one)], pa.int32()), pa.array([[ids[k] for k in own]], pa.list_(pa.int64())), pa.array([x[own].astype("<f8").tobytes()], pa.binary()), pa.array([[users[k] for k in own]], pa.list_(pa.string())), pa.array([[allowed[k] for k in own]], pa.list_(pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["list", "query_ids", "asked", "users", "allowed"])

    users = F.col("user_id").cast("string") if owned else F.lit(None).cast("string")
    allowed = F.col("document_ids").cast("array<bigint>") if owned and "document_ids" in queries.columns else F.lit(None).cast("array<bigint>")
    given = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("bigint"), "embedding", users.alias("user_id"), allowed.alias("document_ids"))
    return given.mapInArrow(probe, "list int, query_ids array<bigint>, asked binary, users array<string>, allowed array<array<bigint>>")


def _meet(dimension: int, pieces: DataFrame, tiles: DataFrame, k: int, owned: bool) -> DataFrame:
    """query_id, chunk_id, score: the best k of each piece for each query of each tile that meets it."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                x, q = (np.frombuffer(row[c], "<f8").reshape(-1, dimension) for c in ("vectors", "asked"))
                scores, ids = q @ x.T, np.array(row["ids"], np.int64)
                if owned:
                    codes, known = np.frombuffer(row["owner"], "<i4"), {name: c for c, name in enumerate(row["owners"])}
                    scores[np.array([known.get(u, -2) for u in row["users"]])[:, None] != codes] = -np.inf
                    documents = np.array([-1 if d is None else d for d in row["documents"]], np.int64)
                    for n, only in enumerate(row["allowed"]):
                        if only:
                            scores[n, ~np.isin(documents, only)] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k] if scores.shape[1] <= 4 * k else _narrow(scores, ids, k)
                kept = np.take_along_axis(scores, order, 1)
                real = kept > -np.inf
                asked = np.broadcast_to(np.array(row["query_ids"], np.int64)[:, None], kept.shape)
                yield pa.RecordBatch.from_arrays([pa.array(asked[real]), pa.array(ids[order][real]), pa.array(kept[real])], names=["query_id", "chunk_id", "score"])

    return pieces.join(tiles, "list").mapInArrow(best, "query_id bigint, chunk_id bigint, score double")


def _narrow(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, ties by id; what ties with the k-th is looked at before it is cut."""
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    wide = max(k, int((scores >= least).sum(axis=1).max()))
    at = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
    order = np.lexsort((ids[at], -np.take_along_axis(scores, at, 1)), axis=1)[:, :k]
    return np.take_along_axis(at, order, 1)


def _probed(index: VectorIndex, pieces: DataFrame, queries: DataFrame, k: int, first: int, last: int, owned: bool) -> DataFrame:
    """The best k rows of each query in its first-th to last-th nearest lists.

    As in retrieval.vector_topk, the queries of a block go to the executors once, and a task keeps its k best per query over all of
    its pieces. With more than MOST_BLOCKS blocks, stored tiles of queries, one for each list that they probe, meet pieces in a join.
    """
    from .retrieval import MOST_BLOCKS, query_blocks

    blocks, found, spark = query_blocks(queries), None, queries.sparkSession
    if len(blocks) > MOST_BLOCKS:
        tiles = stored(spark, _tiles(queries, index, first, last, owned))
        probed = [r[0] for r in tiles.select("list").distinct().collect()]  # MOST_LISTS numbers at most, so that only their folders are read
        return _ranked(_meet(index.centroids.shape[1], pieces.filter(F.col("list").isin(probed)), tiles, k, owned), k)
    for block in blocks:
        part = _probed_block(index, pieces, block, k, first, last, owned)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def _probed_block(index: VectorIndex, pieces: DataFrame, queries: DataFrame, k: int, first: int, last: int, owned: bool) -> DataFrame:
    spark, dimension, schema = queries.sparkSession, index.centroids.shape[1], "query_id bigint, chunk_id bigint, score double"
    lists = owned and "document_ids" in queries.columns
    users, allowed = [F.col("user_id").cast("string")] * owned, [F.col("document_ids").cast("array<bigint>")] * lists
    t = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("bigint"), "embedding", *users, *allowed).toArrow()
    if not t.num_rows:
        return spark.createDataFrame([], schema)
    x, ids = _units(t.column("embedding").combine_chunks(), dimension), t.column("query_id").to_numpy()
    asks = np.zeros((len(index.centroids), len(ids)), bool)
    for at in range(0, len(ids), TILE_QUERIES):
        near = np.argsort(-(x[at : at + TILE_QUERIES] @ index.centroids.T), axis=1, kind="stable")[:, first:last]
        asks[near, np.arange(at, at + len(near))[:, None]] = True
    given = t.column("user_id").to_pylist() if owned else None, t.column("document_ids").to_pylist() if lists else None
    held = spark.sparkContext.broadcast((ids, x, np.packbits(asks, axis=1), *given))
    probed = np.flatnonzero(asks.any(axis=1)).tolist()  # MOST_LISTS numbers at most, so that only their folders are read

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, asks, users, allowed = held.value
        kept = Best(len(ids), k)
        for batch in batches:
            for row in (batch.slice(at, 1).to_pylist()[0] for at in range(batch.num_rows)):
                vectors, chunks = np.frombuffer(row["vectors"], "<f8").reshape(-1, dimension), np.array(row["ids"], np.int64)
                own = np.flatnonzero(np.unpackbits(asks[row["list"]], count=len(ids)))
                if owned:
                    codes, known = np.frombuffer(row["owner"], "<i4"), {name: c for c, name in enumerate(row["owners"])}
                    documents = np.array([-1 if d is None else d for d in row["documents"]], np.int64)
                for at in range(0, len(own), TILE_QUERIES):
                    who = own[at : at + TILE_QUERIES]
                    scores = q[who] @ vectors.T
                    if owned:
                        scores[np.array([known.get(users[n], -2) for n in who])[:, None] != codes] = -np.inf
                    for place, n in enumerate(who) if allowed else ():
                        if allowed[n]:
                            scores[place, ~np.isin(documents, allowed[n])] = -np.inf
                    kept.add(scores, chunks, who)
        yield from kept.rows(ids, ["query_id", "chunk_id", "score"], np.float64)

    return pieces.filter(F.col("list").isin(probed)).mapInArrow(best, schema)


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, owned: bool = False, iterative: bool = False) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank of the best k rows in each query's ``probes`` nearest lists, ties by chunk_id.

    With ``owned``, a query (with user_id, and document_ids where it has such a list) meets its owner's
    rows only. With ``iterative``, queries with fewer than k rows go on to the next lists, twice as many each
    time, until they have k or no list is left. Rows come back in any order of lists and are sorted at the
    end. With as many probes as lists the result is exact.
    """
    spark = queries.sparkSession
    if not index.rows:
        return spark.createDataFrame([], "query_id bigint, chunk_id bigint, score double, rank int")
    pieces = spark.read.schema(_PIECES).parquet(index.path)
    first, last = 0, min(len(index.centroids), probes or index.probes)
    open_, found = queries, None
    while True:
        part = _probed(index, pieces, open_, k, first, last, owned)
        found = part if found is None else _ranked(found.drop("rank").unionByName(part.drop("rank")), k)
        if not iterative or last == len(index.centroids):
            return found
        found = stored(spark, found)
        enough = found.groupBy("query_id").count().filter(F.col("count") >= k)
        open_ = stored(spark, open_.filter(F.col("embedding").isNotNull()).join(enough, "query_id", "left_anti"))
        if open_.isEmpty():
            return found
        first, last = last, min(len(index.centroids), 2 * last)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Groups of pieces in an exact search by tiles; each meets every tile of queries.
GROUPS = 64


def exact_topk(queries: DataFrame, chunks: DataFrame, k: int, owned: bool = False, groups: int | None = None) -> DataFrame:
    """What retrieval.vector_topk gives, for very many queries: tiles of queries meet pieces of chunks in a join.

    Rows are packed once on either side, each tile is copied to all groups of pieces, and a task multiplies
    one tile by one piece at a time; nothing comes to the driver but the length of a vector.
    """
    some = queries.filter(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    if some is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, chunk_id bigint, score double, rank int")
    dimension, n = some[0], groups or GROUPS

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("chunk_id")
            lists = np.full(batch.num_rows, int(ids[0].as_py() or 0) % n if batch.num_rows else 0, np.int32)  # a batch is one group's
            vectors = pa.array([v.tobytes() for v in _units(batch.column("embedding"), dimension).astype("<f8")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(lists), *(batch.column(c) for c in ("chunk_id", "document_id", "user_id")), vectors], names=["list", "chunk_id", "document_id", "user_id", "vector"])

    pieces = _given(chunks).mapInArrow(unit, "list int, chunk_id bigint, document_id bigint, user_id string, vector binary").mapInArrow(_packer(dimension), _PIECES)
    one = VectorIndex("", np.zeros((1, dimension)), 0, 1)
    tiles = _tiles(queries, one, 0, 1, owned).withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return _ranked(_meet(dimension, pieces, tiles, k, owned), k)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, n_exact, n_found: how many of the exact results (query_id, chunk_id) were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left_outer")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))


def lists_read(spark: SparkSession, index: VectorIndex) -> DataFrame:
    """list, n_rows of the stored lists."""
    return spark.read.schema(_PIECES).parquet(index.path).groupBy("list").agg(F.sum(F.size("ids")).alias("n_rows"))
