"""Near-duplicate classes: BagMinHash signatures, bands, verified multiset overlap, components.

Signature. Every five-word shingle, with its count as weight, owns Poisson processes on [0, oo):
one for the weight cell (0, 1], one for each dyadic interval (2^k, 2^(k+1)] above it, whose rate
is the interval's length and whose points fall into unit cells at random. A document of weight w
sees the points of cells up to w. Each point carries a register; a register keeps its smallest
point. Two registers agree with a probability of exactly the weighted Jaccard similarity. Points
are only made up to a limit by which all registers fill, and the limit is doubled where they don't.

Candidates. Documents with equal word sequences are one node. Nodes that agree in a band and are
alike in size share a bucket. A bucket's members are compared with its leader, the node that shares
most with others; similar ones are linked. Where a bucket's members are not in one component then,
shingles that no other member of such buckets has are set apart: the others, counted by class, bound
every overlap. A member whose overlaps can't reach the threshold even with the smallest of its
bucket leaves the bucket. Of the rest, the few with most of their shingles in others are leaders
too, then those that are still outside the first leader's component. A leader meets no member of its
own component, none that is barred by sizes and the overlap bound, and none whose distance from the
first leader differs by more than 1 - threshold (weighted Jaccard distance is a metric), for these
can't be similar. So every similar pair of a bucket ends in one component, and pairs are only made
where components meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import connected_components
from .shared_store import fields, numbered, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Registers of a band and bands: a pair of similarity 0.8 is missed with probability (1 - 0.8^6)^32 < 6e-5.
BAND_ROWS = 6
BANDS = 32
#: Further leaders of a bucket in the second round.
LEADERS = 8
#: Members that meet one copy of a leader's text; a leader with more has more copies, dealt to other tasks.
MET_BY_ONE_COPY = 2000
#: Pairs, or rows, up to which they are broadcast to the texts (two bigints each).
BROADCAST_PAIRS = 200_000
#: Classes of shingles whose counts bound an overlap; a power of 2.
BINS = 64

_U = np.uint64


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingle hashes of each row, their rows' starts, and two hashes of each row's word sequence.

    Words are runs without white space, A-Z in lower case; a text of fewer words is one shingle.
    """
    starts, ends, first = ta.tokens(data, offsets, ta.SPACE_SEPARATORS)
    w = ta.token_hashes(data, starts, ends, ta.ASCII_LOWER)
    counts = np.diff(first)
    rows = len(counts)
    every = ta.window_hashes(w, size)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_starts = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_starts[-1], np.uint64)
    content = np.zeros((2, rows), np.uint64)
    powers = np.arange(1, int(counts.max(initial=0)) + 1, dtype=np.uint64)
    for r in range(rows):
        a, b, s, e = first[r], first[r + 1], out_starts[r], out_starts[r + 1]
        if b - a >= size:
            out[s:e] = np.sort(every[a : b - size + 1])
        elif e > s:
            out[s] = ta.window_hashes(w[a:b], int(b - a))[0] + _U(b - a)
        own = w[a:b] + powers[: b - a] * _U(0x9E3779B97F4A7C15)
        content[0, r] = np.bitwise_xor.reduce(ta.mix(own)) if b > a else 0
        content[1, r] = np.add.reduce(ta.mix(own ^ _U(0xA0761D6478BD642F))) if b > a else 0
    return out, out_starts, content[0], content[1]


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from a hash."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(h: np.ndarray, starts: np.ndarray, registers: int) -> np.ndarray:
    """Registers of rows of sorted hashes (repeats are weights), as bits of the smallest points; rows x registers."""
    rows = len(starts) - 1
    out = np.full((rows, registers), np.iinfo(np.int64).max, np.int64)
    counts = np.diff(starts)
    row = np.repeat(np.arange(rows), counts)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    h, row, weight = h[at], row[at], np.diff(np.append(at, len(h)))
    # one process for the cell (0, 1], then one for each (2^k, 2^(k+1)] that the weight reaches into
    seeds, of, rate, low, top = [h], [row], [np.ones(len(h))], [np.zeros(len(h), np.int64)], [weight]
    k = 0
    while (more := weight > 2**k).any():
        seeds.append(ta.mix(h[more] + _U(0x8CB92BA72F3D8DD7 * (k + 1) % 2**64)))
        of.append(row[more])
        rate.append(np.full(int(more.sum()), float(2**k)))
        low.append(np.full(int(more.sum()), 2**k))
        top.append(weight[more])
        k += 1
    seeds, of, rate, low, top = map(np.concatenate, (seeds, of, rate, low, top))
    limit = registers * (np.log(registers) + 3.0) / np.maximum(counts, 1)
    open_rows = counts > 0
    while open_rows.any():
        live = open_rows[of]
        s, r, q, lo, hi = seeds[live], of[live], rate[live], low[live], top[live]
        x = np.zeros(len(s))
        while len(s):
            s = ta.mix(s + _U(0x9E3779B97F4A7C15))
            x = x - np.log(_uniform(s)) / q
            near = x <= limit[r]
            s, x, r, q, lo, hi = s[near], x[near], r[near], q[near], lo[near], hi[near]
            side = ta.mix(s ^ _U(0xE7037ED1A0B428DB))
            seen = lo + ((side >> _U(32)).astype(np.float64) * 2.0**-32 * q).astype(np.int64) < hi
            register = ((side & _U(0xFFFFFFFF)) * _U(registers)) >> _U(32)
            np.minimum.at(out.reshape(-1), (r[seen] * registers + register[seen].astype(np.int64)), x[seen].view(np.int64))
        open_rows &= (out == np.iinfo(np.int64).max).any(axis=1)
        limit = np.where(open_rows, limit * 2, limit)
    return out


def band_hashes(signature: np.ndarray, band_rows: int, bands: int) -> np.ndarray:
    """A hash for each row and band."""
    parts = signature.view(np.uint64).reshape(len(signature), bands, band_rows)
    out = np.broadcast_to(ta.mix(np.arange(bands, dtype=np.uint64) + _U(1)), parts.shape[:2]).copy()
    for k in range(band_rows):
        out = ta.mix(out * _U(0xD6E8FEB86659FD93) + parts[:, :, k])
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in ta.text_slices(batch.column("_text")):
            h, starts, a, b = shingle_hashes(data, offsets)
            bands = band_hashes(bag_minhash(h, starts, BANDS * BAND_ROWS), BAND_ROWS, BANDS)
            empty = np.diff(starts) == 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, BANDS))]).astype(np.int32)), pa.array(ta.signed(np.ascontiguousarray(bands[~empty])).reshape(-1)))
            node = pa.array([x.tobytes() if not e else None for x, e in zip(np.stack([a, b], axis=1), empty.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_row").slice(first, last - first), batch.column("_rank").slice(first, last - first), node, pa.array(np.diff(starts)), bands], names=["row", "rank", "node", "size", "bands"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted Jaccard similarity of the shingles of two texts."""
    for batch in batches:
        sims = []
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def bag(text: str, known=known) -> tuple[np.ndarray, np.ndarray]:
            if text not in known:
                if len(known) > 64:
                    known.clear()
                raw = np.frombuffer(text.encode(), np.uint8)
                known[text] = np.unique(shingle_hashes(raw, np.array([0, len(raw)]))[0], return_counts=True)
            return known[text]

        for x, y in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
            (a, ca), (b, cb) = bag(x.as_py()), bag(y.as_py())
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            both = np.minimum(ca, np.where(b[at] == a, cb[at], 0)).sum() if len(b) else 0
            sims.append(float(both / max(1, ca.sum() + cb.sum() - both)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each text, with their counts."""
    for batch in batches:
        for first, last, data, offsets in ta.text_slices(batch.column("text")):
            h, starts, _, _ = shingle_hashes(data, offsets)
            row = np.repeat(np.asarray(batch.column("row").slice(first, last - first)), np.diff(starts))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(ta.signed(h[at])), pa.array(np.diff(np.append(at, len(h))))], names=["row", "shingle", "weight"])


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of each text fall into each of BINS classes."""
    for batch in batches:
        for first, last, data, offsets in ta.text_slices(batch.column("text")):
            h, starts, _, _ = shingle_hashes(data, offsets)
            at = np.repeat(np.arange(last - first), np.diff(starts)) * BINS + (h & _U(BINS - 1)).astype(np.int64)
            counts = pa.array(np.bincount(at, minlength=(last - first) * BINS).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * BINS), counts)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, last - first), lists], names=["row", "bins"])


def _cores(spark: SparkSession, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """row, core, bins: how many shingles of a row, repeats included, any other of the rows has; in all and by class."""
    few = rows.count() <= BROADCAST_PAIRS
    texts = texts.select("row", "text").join(F.broadcast(rows) if few else rows, "row", "left_semi").select("row", "text")
    bags = texts.mapInArrow(_bags, "row bigint, shingle bigint, weight bigint")
    alone = bags.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.sum("weight").alias("weight")).filter("n = 1")
    alone = alone.groupBy("row", F.col("shingle").bitwiseAND(BINS - 1).cast("int").alias("bin")).agg(F.sum("weight").cast("int").alias("own"))
    own = alone.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("bin", "own"))).alias("own"))
    found = texts.mapInArrow(_bins, "row bigint, bins array<int>").join(own, "row", "left_outer")
    bins = F.transform("bins", lambda n, k: n - F.coalesce(F.try_element_at("own", k), F.lit(0)))
    found = found.select("row", bins.alias("bins"))
    return stored(spark, found.select("row", F.aggregate("bins", F.lit(0), lambda x, y: x + y).alias("core"), "bins"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, sim for pairs of rows. Few pairs go to the texts where they lie; many are joined by shuffles.

    A row b of many pairs is dealt to several tasks, each with a copy of its text.
    """
    texts = texts.select("row", "text")
    heads = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MET_BY_ONE_COPY).cast("int").alias("copies"))
    few = pairs.count() <= BROADCAST_PAIRS
    small = F.broadcast if few else lambda df: df
    pairs = pairs.join(small(heads), "b").select("a", "b", F.pmod(F.xxhash64("a"), "copies").cast("int").alias("copy"))
    left = texts.join(small(pairs), F.col("row") == F.col("a")).select("a", "b", "copy", F.col("text").alias("text_a"))
    right = texts.join(small(heads), F.col("row") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias("text_b"))
    return left.join(right, ["b", "copy"]).select("a", "b", "text_a", "text_b").mapInArrow(_overlap, "a bigint, b bigint, sim double")


def similar_links(spark: SparkSession, buckets: DataFrame, texts: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """node, component for rows with links: every pair of a bucket with similarity ``threshold`` is in one component.

    buckets: bucket, row, size, heft (the larger, the sooner a leader). texts: row, text.
    """
    order = F.struct("heft", (-F.col("row")).alias("minus"))
    main = buckets.groupBy("bucket").agg((-F.max(order)["minus"]).alias("main"))
    # a group of near copies shares most of its buckets and their leader: one row for each member and leader, with its
    # buckets (2 * BANDS at most)
    pairs = buckets.join(main, "bucket").filter("row != main").groupBy("row", "main").agg(F.first("size").alias("size"), F.first("heft").alias("heft"), F.collect_list("bucket").alias("its"))
    pairs = stored(spark, pairs)
    sims = _compared(spark, pairs.select(F.col("row").alias("a"), F.col("main").alias("b")), texts)
    components = stored(spark, connected_components(spark, sims.filter(F.col("sim") >= threshold).select("a", "b")))
    pairs = pairs.join(sims.select(F.col("a").alias("row"), F.col("b").alias("main"), F.col("sim").alias("to_main")), ["row", "main"])
    members = stored(spark, _open(pairs, components))
    if members.isEmpty():
        return components
    # a shingle that no other open row has is in no overlap; of the others, no more of a class than both have
    cores = _cores(spark, members.select("row").distinct(), texts)
    factor = (1 + threshold) / threshold
    members = members.join(cores.select("row", "core"), "row")
    least = members.select("main", "size", F.explode("its").alias("bucket")).groupBy("main", "bucket").agg(F.min("size").alias("least"))
    least = least.groupBy("main").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "least"))).alias("least"))  # 2 * BANDS at most
    reach = F.col("core") * factor + 1e-6 - F.col("size")
    members = _in_buckets(members.join(least, "main"), F.filter("its", lambda b: F.element_at("least", b) <= reach)).drop("least")
    for leaders in (LEADERS, None):
        members = stored(spark, _open(members, components))
        if members.isEmpty():
            return components
        full = members.join(cores.select("row", "bins"), "row")
        heads = full if leaders else full.filter("loose")
        if leaders:
            first = Window.partitionBy("bucket").orderBy(F.desc(F.col("core") / F.col("size")), F.desc("heft"), "row")
            chosen = members.select("main", "row", "core", "size", "heft", F.explode("its").alias("bucket")).withColumn("k", F.row_number().over(first)).filter(F.col("k") <= leaders)
            chosen = stored(spark, chosen.groupBy("main", "row").agg(F.collect_list("bucket").alias("led")))
            heads = heads.join(chosen, ["main", "row"]).withColumn("its", F.col("led"))
        heads = heads.select("main", *(F.col(c).alias(f"head_{c}") for c in ("row", "part", "size", "core", "to_main", "its", "bins")))
        # rows of one bucket have its first leader in common, so they meet there once, however many buckets they share
        met = full.join(heads, "main").filter("part != head_part").filter((F.least("core", "head_core") * factor + 1e-6 >= F.col("size") + F.col("head_size")) & (F.abs(F.col("to_main") - F.col("head_to_main")) <= 1 - threshold + 1e-9))
        if not leaders:  # all that are loose are leaders
            met = met.filter("not loose or row > head_row")
        overlap = F.aggregate(F.zip_with("bins", "head_bins", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
        met = met.filter(F.arrays_overlap("its", "head_its")).filter(overlap * factor + 1e-6 >= F.col("size") + F.col("head_size"))
        components = _linked(spark, components, met.select(F.col("row").alias("a"), F.col("head_row").alias("b")), texts, threshold)
        if leaders:
            members = _in_buckets(members.join(chosen, ["main", "row"], "left_outer"), F.coalesce(F.array_except("its", "led"), F.col("its"))).drop("led")
    return components


def _in_buckets(members: DataFrame, its: Column) -> DataFrame:
    """The members in these of their buckets, without those that are in none."""
    return members.withColumn("its", its).filter(F.size("its") > 0)


def _linked(spark: SparkSession, components: DataFrame, pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The components with the links of those pairs that are similar."""
    links = _compared(spark, pairs, texts).filter(F.col("sim") >= threshold).select("a", "b")
    if links.isEmpty():
        return components
    return stored(spark, connected_components(spark, components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))


def _parts(members: DataFrame, components: DataFrame) -> DataFrame:
    """part: the component of each member (itself where it has no link); loose: not that of its first leader."""
    part = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    now = members.drop("part", "loose").join(part("row"), "row", "left_outer").join(part("main"), "main", "left_outer")
    return now.withColumn("part", F.coalesce("row_part", "row")).withColumn("loose", F.col("part") != F.coalesce("main_part", "main")).drop("row_part", "main_part")


def _open(members: DataFrame, components: DataFrame) -> DataFrame:
    """The members, with their parts, in those of their buckets that have one outside the component of their first leader.

    A bucket has one first leader, and that has 2 * BANDS buckets at most: its open ones are one short list.
    """
    now = _parts(members, components)
    open_ = now.filter("loose").select("main", F.explode("its").alias("bucket")).groupBy("main").agg(F.collect_set("bucket").alias("open"))
    return _in_buckets(now.join(open_, "main"), F.array_intersect("its", "open")).drop("open")


def _compared(spark: SparkSession, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    pairs = stored(spark, pairs.distinct())
    return stored(spark, _verify(pairs, texts))


def _shared(entries: DataFrame) -> DataFrame:
    """The entries of buckets with more than one, and n, how many."""
    return entries.join(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "bucket")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """Each document row with its class: row, doc_id, class_id, keeper (boolean).

    Two documents are in a class if a chain of links of similarity ``threshold`` or more joins
    them. class_id is the smallest id of the class; keeper marks the row that stays (smallest id,
    then the smallest row number). Null and empty texts and texts without words are classes of their own,
    as is a row with a null id (class_id null unless its class has an id). Repeated rows are
    copies.
    """
    return _classes(numbered(docs), id_col, text_col, threshold)


def _classes(rows: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """near_duplicates of rows that have their number, _row."""
    spark = rows.sparkSession
    own = F.col("doc").getField
    base = rows.select("_row", F.coalesce(own(id_col).cast("bigint"), F.lit(2**63 - 1)).alias("_rank"), F.coalesce(own(text_col), F.lit("")).alias("_text"))
    signed = stored(spark, base.mapInArrow(_sign, "row bigint, rank bigint, node binary, size bigint, bands array<bigint>"))
    # equal word sequences: one node, named by its first row
    first = F.min(F.struct("rank", "row")).alias("first")
    nodes = signed.filter("node is not null").groupBy("node").agg(first, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(spark, nodes)
    # similar texts have sizes within 1 / threshold of each other: a bucket is split by size, each member in two
    # neighbouring classes, so that such a pair shares one
    entries = _shared(nodes.select(F.col("first.row").alias("row"), "copies", "size", F.explode("bands").alias("bucket"))).drop("n")
    step = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(threshold)))
    held = _shared(entries.select("row", "copies", "size", F.explode(F.array(F.xxhash64("bucket", step), F.xxhash64("bucket", step + 1))).alias("bucket")))
    heft = F.sum("n").over(Window.partitionBy("row")) + F.col("copies")  # a row has 2 * BANDS buckets at most
    buckets = stored(spark, held.select("bucket", "row", "size", heft.alias("heft")))
    texts = base.select(F.col("_row").alias("row"), F.col("_text").alias("text"))
    joined = similar_links(spark, buckets, texts, threshold)
    node_class = nodes.select("node", "first.row", "first.rank").join(joined.withColumnRenamed("node", "row"), "row", "left_outer")
    node_class = node_class.select("node", F.coalesce("component", "row").alias("component"), F.struct("rank", "row").alias("own"))
    best = node_class.groupBy("component").agg(F.min("own").alias("best"))
    named = node_class.select("node", "component").join(best, "component").select("node", "best")
    out = signed.select("row", "rank", "node").join(named, "node", "left_outer")
    out = out.withColumn("best", F.coalesce("best", F.struct("rank", "row")))
    as_id = lambda c: F.when(c != 2**63 - 1, c)
    return out.select("row", as_id(F.col("rank")).alias(id_col), as_id(F.col("best.rank")).alias("class_id"), (F.col("best.row") == F.col("row")).alias("keeper"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The documents without all but one of each class, with their own columns."""
    rows = numbered(docs)
    gone = _classes(rows, id_col, text_col, threshold).filter(~F.col("keeper")).select(F.col("row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*fields(docs))
