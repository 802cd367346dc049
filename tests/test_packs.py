"""Artifacts in packs: few files whatever the number of contents, whole rows after repeated, doubled and broken runs."""

import os

from pyspark.sql import functions as F

from textloom.operators import stages, structure
from textloom.sources import artifacts, packs
from textloom.sources.shared import new_path, stored

CONFIGS = {"extract": "e", "clean": "c", "chunk": "limit=3", "embed": "64"}
MADE = {"clean": stages.clean, "chunk": stages.chunk(3, 1), "embed": stages.embed("hashing-64")}


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def files(folder):
    return [n for _, _, names in os.walk(local(folder)) for n in names if not n.startswith((".", "_"))]


def docs(spark, n):
    """Every tenth is empty, every fifth is a copy of the one before."""
    text = F.when(F.col("id") % 10 == 7, "​ ").otherwise(F.concat_ws(" ", F.lit("a b"), F.col("id") - (F.col("id") % 5 == 1).cast("int"), F.lit("c  d")))
    return spark.range(n).select(F.col("id").alias("document_id"), F.sha2(text, 256).alias("content_hash"), text.alias("text"))


def rows(chunks):
    return sorted((r.document_id, r.chunk_index, r.text, r.token_count, len(r.embedding)) for r in chunks.collect())


def expected(n):
    each = ((k, f"a b {k - (k % 5 == 1)}", f"{k - (k % 5 == 1)} c d") for k in range(n) if k % 10 != 7)
    return sorted((k, i, t, 3, 64) for k, *texts in each for i, t in enumerate(texts))


def test_files_do_not_grow_with_contents(spark):
    counts = []
    for n in (20, 400):
        folder = new_path(spark)
        stages.ingest(docs(spark, n).filter("document_id % 2 = 0"), folder, CONFIGS, MADE)
        chunks, told = stages.ingest(docs(spark, n), folder, CONFIGS, MADE)
        assert rows(chunks) == expected(n)
        # contents: empty ones are one; the copies of 0, 10, ... (11 of 10) and of 5 (6 of 5)
        contents, even = n - n // 5 - n // 10 + 1, n // 2
        held = {r.stage: (r.n_cached, r.n_computed) for r in told.collect()}
        distinct = docs(spark, n).select("content_hash").distinct().count()
        early = docs(spark, n).filter("document_id % 2 = 0").select("content_hash").distinct().count()
        assert held == dict.fromkeys(MADE, (early, distinct - early)) and distinct == contents and early == even
        counts.append(len(files(folder)))
        assert artifacts.list_objects(spark, folder).count() == 0  # a sweep of objects leaves packs alone
    assert max(counts) <= 3 * 2 * 2 * 8, counts


def test_stages_shuffle_nothing(spark):
    given = docs(spark, 50).select("content_hash", "text", F.lit(0).cast("bigint").alias("chunk_index"))
    made = MADE["embed"](MADE["chunk"](MADE["clean"](given)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_replace(pythonUDF") == 1


def test_vectors_of_texts_are_those_of_the_embedder(spark):
    texts = ["", None, "a", "a a b", "Ünï 3 x-y", "​ ", *(" ".join(f"w{(k * i) % 23}" for i in range(k)) for k in range(70))]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(3)
    for name, size in (("hashing-64", 64), ("hashing-256", 256)):
        told = structure.embedder(name)(df, "k", "text").withColumn("told", F.col("embedding").cast("array<float>")).drop("embedding")
        both = df.withColumn("e", structure.vector(name)(F.col("text"))).join(told, "k")
        assert both.filter("e = told").filter(F.size("e") == size).count() == len(texts)


def test_broken_and_doubled_batches(spark):
    folder, given = new_path(spark), docs(spark, 30)
    stages.ingest(given.filter("document_id < 20"), folder, CONFIGS, MADE)
    at = f"{local(folder)}/{artifacts.PACKS}"
    for fingerprint in os.listdir(at):
        held = stored(spark, packs.held(spark, folder, fingerprint))
        (batch,) = {r.batch for r in held.collect()}
        found = stored(spark, packs.read(held, folder, fingerprint))
        some = stored(spark, held.limit(9))
        packs.write(found.join(some, "content_hash", "left_semi"), some, folder, fingerprint)  # held twice
        for dead in ("before its contents", "while they were moved"):
            one = packs.write(found, held.select("content_hash"), folder, fingerprint)
            where = f"{at}{fingerprint}/contents/batch={one}"
            for f in os.listdir(where):
                if dead == "before its contents" or "SUCCESS" in f:
                    os.remove(f"{where}/{f}")
        assert found.count() == packs.read(held.withColumn("batch", F.lit(batch)), folder, fingerprint).count()
    chunks, told = stages.ingest(given, folder, CONFIGS, MADE)
    assert rows(chunks) == expected(30)
    early = given.filter("document_id < 20").select("content_hash").distinct().count()
    late = given.select("content_hash").distinct().count() - early
    assert {r.stage: (r.n_cached, r.n_computed) for r in told.collect()} == dict.fromkeys(MADE, (early, late))


def test_objects_at_their_keys_are_read(spark):
    from textloom.operators.ingest import artifact_keys

    folder, given = new_path(spark), docs(spark, 20)
    one = given.filter("document_id = 3")
    key = artifact_keys(one, CONFIGS).filter("stage = 'chunk'").select("key")
    artifacts.write_artifacts(key.withColumn("payload", F.lit('[{"chunk_index":0,"text":"kept as object","token_count":3}]')), folder)
    chunks, told = stages.ingest(given, folder, CONFIGS, MADE)
    assert rows(chunks) == sorted([r for r in expected(20) if r[0] != 3] + [(3, 0, "kept as object", 3, 64)])
    assert {r.stage: r.n_cached for r in told.collect()} == {"clean": 0, "chunk": 1, "embed": 0}
    assert {r.n_cached for r in stages.ingest(given, folder, CONFIGS, MADE)[1].collect()} == {given.select("content_hash").distinct().count()}


def test_whole_batches_are_read_without_a_join(spark):
    folder, given = new_path(spark), docs(spark, 40)
    stages.ingest(given.filter("document_id % 2 = 0"), folder, CONFIGS, MADE)
    chunks, _ = stages.ingest(given, folder, CONFIGS, MADE)
    assert len(chunks.inputFiles()) > 0 and not any(".json.gz" in f for f in chunks.inputFiles())
    for fingerprint in os.listdir(f"{local(folder)}/{artifacts.PACKS}"):
        held = stored(spark, packs.held(spark, folder, fingerprint))
        whole, part = packs.read(held, folder, fingerprint), packs.read(held.filter("content_hash > '8'"), folder, fingerprint)
        joins = ["Join" in x._jdf.queryExecution().executedPlan().toString() for x in (whole, part)]
        assert joins == [False, True]
        assert 0 < part.count() == whole.filter("content_hash > '8'").count() < whole.count()
        both = spark.read.parquet(f"{local(folder)}/{artifacts.PACKS}{fingerprint}/rows")
        assert both.count() == whole.count() and both.select("batch").distinct().count() == 2
