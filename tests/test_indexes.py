"""Indexes against the searches that read everything, positions against plain lists, the English configuration."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import english
from textloom.operators import positions, query_language, retrieval, text_index, vector_index

VECTORS = "chunk_id long, document_id long, embedding array<float>, user_id string"


def vectors(n, seed, clusters=12, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, 24))
    return [(k, k // 4, [float(v) for v in centres[rng.integers(clusters)] + rng.normal(0, spread, 24)], f"u{k % 5}") for k in range(n)]


def rows(df):
    return sorted((r.query_id, r.chunk_id, r["rank"]) for r in df.collect())


def asked(chunks, every=50):
    return chunks.filter(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), "embedding", "user_id", F.array(F.col("document_id"), F.col("document_id") + 5).alias("document_ids"))


def test_vector_index_reaches_its_recall_and_reads_probed_lists_only(spark):
    chunks = spark.createDataFrame(vectors(4000, 1), VECTORS).repartition(3)
    index = vector_index.build(chunks)
    assert vector_index.lists_read(spark, index).agg(F.sum("n_rows")).first()[0] == 4000
    assert index.probes < 0.5 * len(index.centroids)  # clusters need few
    queries = asked(chunks).drop("document_ids")
    exact, found = retrieval.vector_topk(queries, chunks, 50), vector_index.search(index, queries, 50)
    hit = vector_index.recall(exact, found).agg(F.sum("n_found") / F.sum("n_exact")).first()[0]
    assert hit >= 0.9
    one = vector_index.search(index, queries.limit(1), 5, probes=2)
    files = {int(f.split("list=")[1].split("/")[0]) for f in spark.read.parquet(index.path).inputFiles()}
    assert len(files) > 2 and one.count() == 5
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "list" in plan.split("PartitionFilters")[1][:80]


def test_vector_index_on_given_tables(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.lit(1).cast("bigint").alias("document_id"), "embedding")
    queries = e.filter("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = vector_index.search(vector_index.build(e), queries, 50)
    assert vector_index.recall(retrieval.vector_topk(queries, e, 50), found).agg(F.sum("n_found") / F.sum("n_exact")).first()[0] >= 0.9


def test_all_lists_give_the_exact_result_with_owners_and_ties(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PIECE_BYTES", 5000)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 7)
    given = vectors(600, 2) + [(1000 + k, 3, [1.0] * 24, "u0") for k in range(300)] + [(2000, 1, None, "u1"), (2001, None, [0.5] * 24, None)]  # a hot list; ties
    chunks = spark.createDataFrame(given, VECTORS)
    index = vector_index.build(chunks, lists=9)
    for owned, columns in ((False, ["query_id", "embedding"]), (True, ["query_id", "embedding", "user_id"]), (True, ["query_id", "embedding", "user_id", "document_ids"])):
        queries = asked(chunks).select(*columns)
        whole = vector_index.search(index, queries, 20, 9, owned)
        assert rows(whole) == rows(retrieval.vector_topk(queries, chunks, 20, owned))
        few = vector_index.search(index, queries, 20, 1, owned, iterative=True)
        need = {r.query_id: r["count"] for r in whole.groupBy("query_id").count().collect()}
        assert {r.query_id: r["count"] for r in few.groupBy("query_id").count().collect()} == need
    with pytest.raises(Exception, match="numbers, not"):
        vector_index.search(index, spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>"), 3).collect()
    assert vector_index.search(vector_index.build(chunks.limit(0)), queries, 3).count() == 0


@pytest.mark.parametrize("groups", [1, 5])
def test_exact_search_by_tiles(spark, monkeypatch, groups):
    monkeypatch.setattr(vector_index, "PIECE_BYTES", 4000)
    monkeypatch.setattr(vector_index, "TILE_QUERIES", 3)
    chunks = spark.createDataFrame(vectors(400, 4) + [(900 + k, 3, [1.0] * 24, "u0") for k in range(30)] + [(2000, 1, None, "u1")], VECTORS).repartition(3)
    for owned in (False, True):
        queries = asked(chunks, 20)
        want = rows(retrieval.vector_topk(queries, chunks, 15, owned))
        assert rows(vector_index.exact_topk(queries.repartition(2), chunks, 15, owned, groups)) == want
        monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)  # so many blocks that the search goes by tiles
        assert rows(retrieval.vector_topk(queries, chunks, 15, owned)) == want
        monkeypatch.undo()
    assert vector_index.exact_topk(queries.limit(0), chunks, 3).count() == 0


WORDS = ["red", "green", "blue", "or", "tea", "sky", "x"]


def test_phrase_search_equals_the_scan(spark):
    rnd = random.Random(5)
    docs = [(k, f"u{k % 3}", " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(14)))) for k in range(150)] + [(500, None, "red"), (501, "u1", None), (502, "u1", "Red, red! GREEN-blue")]
    texts = ['"red green" -blue', "-tea", 'sky OR "blue tea sky"', '"red red"', "nothing", "", "-", '"', "-zzz red", '"tea', "red OR -red", "red red", '-"red green" -sky', "zzz OR blue tea", '"x" "x x" -"x x x"']
    queries = [(k, f"u{k % 3}", t) for k, t in enumerate(texts * 3)] + [(900, None, "red"), (0, "u0", texts[0]), (901, "none", "-red"), (902, "u1", None)]
    d, q = spark.createDataFrame(docs, "document_id long, user_id string, text string"), spark.createDataFrame(queries, "query_id long, user_id string, text string")
    found = text_index.search_phrases(text_index.build_positions(d.repartition(5)), q)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(set(map(tuple, query_language.web_search(q, d).collect()))) and len(got) > 100


def test_block_search_equals_keyword_search_and_reads_less(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)]
    body = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    chunks = [(k, body(rnd.randrange(30))) for k in range(3000)] + [(5000 + k, "w1 w1 w1 w7 w9 " * 20) for k in range(12)] + [(7000, None), (7001, ""), (-5, "w1 w2")]
    queries = [(k, body(4)) for k in range(40)] + [(90, "w1 w7 w9"), (91, ""), (92, None), (93, "nowhere")]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    index = text_index.build_blocks(c.repartition(4))
    for k in (1, 10, 50):
        assert rows(text_index.block_topk(index, q, k)) == rows(retrieval.keyword_topk(q, c, k))
    read = {r.query_id: (r.n_read, r.n_postings) for r in text_index.postings_read(index, q, 10).collect()}
    assert all(a <= b for a, b in read.values()) and read[90][0] < 0.5 * read[90][1]


def test_stems():
    # pairs of the stemmer's published examples
    pairs = """consign consign consigned consign consignment consign consistency consist consolation consol consolatory consolatori consolingly consol conspicuous conspicu conspiracy conspiraci
    conspirator conspir constables constabl constancy constanc knackeries knackeri knavish knavish kneaded knead kneeling kneel knights knight knitting knit knocker knocker knots knot
    skies sky dying die news news inning inning outing outing generous generous communism communism relational relat hopping hop hoping hope agreed agre feed feed cry cri by by say say
    happy happi ties tie gas gas gaps gap this this kiwis kiwi youth youth boyish boyish sensational sensat rational ration organization organ adoption adopt""".split()
    assert [english.stem(w) for w in pairs[::2]] == pairs[1::2]
    assert len(english.STOP_WORDS) == len(set(english.STOP_WORDS)) == 127
    assert english.stem("x" * 100_000 + "ing") == "x" * 100_000 + "ing"


def test_english_search(spark):
    c = spark.createDataFrame([(1, "The runners were running"), (2, "He ran; she runs, and RUNS."), (3, "the and of"), (4, None)], "chunk_id long, text string")
    assert [tuple(r) for r in c.select("chunk_id", english.english_lexemes(F.col("text"))).collect()] == [(1, ["runner", "run"]), (2, ["ran", "run", "run"]), (3, []), (4, [])]
    q = spark.createDataFrame([(9, "the running of runs")], "query_id long, text string")
    found = text_index.block_topk(text_index.build_blocks(c, "english"), q, 5).collect()
    assert [(r.chunk_id, r["rank"]) for r in found] == [(2, 1), (1, 2)]
    with pytest.raises(ValueError, match="klingon"):
        text_index.build_blocks(c, "klingon")


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_positions_in_any_layout(spark, monkeypatch, parts):
    monkeypatch.setattr(positions, "BLOCK", 5)
    rnd = random.Random(parts)
    given = [(rnd.choice([None, "a", "b", "hot", "hot", "hot"]), k, k * 37 % 1000, rnd.randrange(100)) for k in range(400)]
    df = spark.createDataFrame(given, "g string, k long, at long, v long").repartition(parts)
    alone = {r.k: r.position for r in positions.row_positions(df, ["at"]).collect()}
    assert alone == {k: n for n, (_, k, _, _) in enumerate(sorted(given, key=lambda r: r[2]))}
    placed = positions.row_positions(df, ["at"], ["g"])
    want = {k: sum(g == h and b < a for h, _, b, _ in given) for g, k, a, _ in given}
    assert {r.k: r.position for r in placed.collect()} == want
    summed = positions.running(placed.filter("g is not null"), "g", F.col("position"), {"total": F.col("v")}, F.sum, lambda a, b: a + b)
    assert {r.k: r.total for r in summed.collect()} == {k: sum(w for h, _, b, w in given if g == h and b <= a) for g, k, a, _ in given if g is not None}


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_zip_by_position(spark, parts):
    left = spark.createDataFrame([(k, k * 7 % 50) for k in range(50)], "a long, x long").repartition(parts)
    right = spark.createDataFrame([(f"v{k}", k * 11 % 50) for k in range(50)], "b string, y long").repartition(parts + 1)
    got = positions.zip_by_position(left, right, ["x"], ["y"]).collect()
    assert all(r.position == r.x == r.y for r in got) and len(got) == 50
    with pytest.raises(positions.LengthMismatch, match="50 rows against 49"):
        positions.zip_by_position(left, right.filter("y > 0"), ["x"], ["y"])
    with pytest.raises(ValueError, match="both tables"):
        positions.zip_by_position(left, left, ["x"], ["x"])
    assert positions.zip_by_position(left.limit(0), right.limit(0), ["x"], ["y"]).count() == 0
