"""Searches of many queries move what their results need, and give what a plain count gives."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import lexeme_scores, query_language, retrieval, text_index, vector_index


def plain(queries, chunks, k, owned=False):
    """query, chunk, n, rank by counting every pair."""
    out = set()
    for q, text, user, only in queries:
        terms = set((text or "").lower().split())
        found = []
        for c, body, owner, document in chunks:
            n = sum(v for w, v in Counter((body or "").lower().split()).items() if w in terms)
            if n and (not owned or (user is not None and user == owner and (not only or document in only))):
                found.append((-n, c))
        out |= {(q, c, round(-n / (-n + 10.0), 9), at + 1) for at, (n, c) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_keyword_search_sends_no_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_QUERIES", 7), ("BLOCK_BYTES", 300), ("TILE", 5), ("TILE_OCCURRENCES", 40), ("COMMON", 3)):
            monkeypatch.setattr(lexeme_scores, name, value)
    rnd = random.Random(3)
    body = lambda n: " ".join(f"w{int(rnd.paretovariate(0.5)) % 500}" for _ in range(n))
    chunks = [(k, body(rnd.randrange(40)), rnd.choice(["a", "b", None]), k % 9) for k in range(300)] + [(900, None, "a", 1), (901, "", "b", 2), (-4, "w1 " * 90, "a", 3)]
    queries = [(k, body(rnd.randrange(20)), rnd.choice(["a", "b", "c", None]), rnd.choice([None, [], [1, 2, 3]])) for k in range(40)] + [(70, None, "a", None), (71, "zzz", "a", None)]
    c = spark.createDataFrame(chunks, "chunk_id long, text string, user_id string, document_id long").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, text string, user_id string, document_ids array<long>")
    for owned in (False, True):
        found = retrieval.keyword_topk(q, c, 10, owned)
        got = {(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in found.collect()}
        assert got == plain(queries, chunks, 10, owned) and len(got) >= 100
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # occurrences don't meet queries as rows
    assert retrieval.keyword_topk(q.limit(0), c, 10).count() == retrieval.keyword_topk(q, c.limit(0), 10).count() == 0


@pytest.mark.parametrize("configuration", ["simple", "english"])
def test_block_search_sends_no_pairs(spark, monkeypatch, configuration):
    monkeypatch.setattr(text_index, "BATCH_BLOCKS", 3)
    monkeypatch.setattr(lexeme_scores, "BLOCK_QUERIES", 9)
    rnd = random.Random(8)
    body = lambda n: " ".join(f"w{int(rnd.paretovariate(0.5)) % 300}" for _ in range(n))
    chunks = [(k - 50, body(rnd.randrange(30))) for k in range(600)] + [(9000, None), (9001, "")]
    queries = [(k, body(rnd.randrange(12))) for k in range(30)]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    index = text_index.build_blocks(c.repartition(4), configuration)
    found = text_index.block_topk(index, q, 10)
    got = {(r.query_id, r.chunk_id, round(r.score, 9), r["rank"]) for r in found.collect()}
    assert got == plain([(*r, None, None) for r in queries], [(*r, None, None) for r in chunks], 10) and len(got) >= 100
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_phrase_search_shuffles_nothing(spark, monkeypatch):
    for module, name, value in ((text_index, "BLOCK_SEARCHES", 9), (text_index, "MOST_MATCHES", 20), (lexeme_scores, "TILE", 5), (lexeme_scores, "TILE_OCCURRENCES", 40)):
        monkeypatch.setattr(module, name, value)
    rnd = random.Random(4)
    body = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    ask = lambda: " ".join(rnd.choice(["a", "-b", '"a b c"', '-"c d"', "OR", '"b a"', "zz", '"d zz"']) for _ in range(rnd.randrange(1, 6)))
    docs = [(k, rnd.choice(["u", "v", None]), body(rnd.randrange(12))) for k in range(200)] + [(900, "u", None), (901, "v", "")]
    queries = [(k, rnd.choice(["u", "v", "w", None]), ask()) for k in range(60)]
    d, q = spark.createDataFrame(docs, "document_id long, user_id string, text string"), spark.createDataFrame(queries, "query_id long, user_id string, text string")
    index = text_index.build_positions(d.repartition(3))
    found = text_index.search_phrases(index, q)
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, query_language.web_search(q, d).collect())) and len(got) > 200
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()  # rows leave the tasks that find them
    assert text_index.search_phrases(index, q.limit(0)).count() == text_index.search_phrases(text_index.build_positions(d.limit(0)), q).count() == 0
    sizes = Counter()
    for _, user, text in docs:
        for w, n in Counter((text or "").split()).items():
            sizes[w, user] += n
    assert {(r.lexeme, r.user_id): r.n for r in text_index.index_sizes(spark, index).collect()} == sizes


def test_index_search_sends_no_tiles_for_each_list(spark, monkeypatch):
    rnd = random.Random(9)
    given = [(k, k // 4, [rnd.gauss(0, 1) for _ in range(8)], f"u{k % 3}") for k in range(900)]
    chunks = spark.createDataFrame(given, "chunk_id long, document_id long, embedding array<float>, user_id string").repartition(3)
    queries = chunks.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "user_id")
    index = vector_index.build(chunks, lists=20)
    rows = lambda df: sorted((r.query_id, r.chunk_id, r["rank"]) for r in df.collect())
    for owned in (False, True):
        found = vector_index.search(index, queries, 30, 20, owned, iterative=owned)
        want = rows(retrieval.vector_topk(queries, chunks, 30, owned))
        assert rows(found) == want and "Join" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 2)  # so many blocks that tiles meet lists
        assert rows(vector_index.search(index, queries, 30, 20, owned, iterative=owned)) == want
        monkeypatch.undo()


def test_jobs_share_states(spark):
    from textloom.sources.shared import new_path
    from textloom.streaming import job_timers as jt

    n, folder, out = 3000, new_path(spark), new_path(spark)
    at = (F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 90).cast("int"))).alias("at")
    jobs = spark.range(n).select(F.col("id").alias("job_id"), F.col("id").alias("document_id"), F.lit("clean").alias("stage"), F.when(F.col("id") % 3 == 0, "running").when(F.col("id") % 3 == 1, "queued").otherwise("done").alias("status"), at)
    jobs.unionByName(jt.clock(spark, "2024-03-01 12:30:00")).write.parquet(folder)
    query = jt.watch(jt.event_stream(spark, folder), out, new_path(spark))
    query.awaitTermination()
    states = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    assert states <= 2 * jt.BUCKETS + 1  # states, and a timer for each, two keys to a timer at most
    got = Counter((r.action, r.reason) for r in spark.read.schema(jt.ACTIONS).parquet(out).collect())
    aged = sum(1 for k in range(n) if k % 3 == 1 and k % 90 < 30)
    assert got == {("fail", "stalled while running"): n // 3, ("requeue", None): n // 3, ("fail", "not picked up in time"): aged}


def test_listings_are_made_in_tasks(spark, monkeypatch):
    import os

    from textloom.operators import jobs as job_ops
    from textloom.sources import artifacts
    from textloom.sources.shared import new_path

    monkeypatch.setattr(artifacts, "LISTED_AT_ONCE", 3)
    folder = new_path(spark)
    names = [f"_pipeline/cache/{k % 3:016x}/{k:064x}/chunk.json.gz" for k in range(40)]
    artifacts.write_artifacts(spark.createDataFrame([(n, f'[{{"chunk_index":{k}}}]') for k, n in enumerate(names)], "key string, payload string"), folder)
    listed = artifacts.list_objects(spark, folder)
    assert sorted(r.key for r in listed.collect()) == sorted(names) and listed.filter("mtime > timestamp'2020-01-01' and size > 20").count() == 40
    assert not any("chunk.json.gz" in f for f in listed.inputFiles())  # the driver holds no list of objects
    assert not any("chunk.json.gz" in f for f in artifacts.load_chunks(spark, folder).inputFiles())
    assert sorted(r.chunk_index for r in artifacts.load_chunks(spark, folder).collect()) == list(range(40))
    asked = spark.createDataFrame([(n, k) for k, n in enumerate([*names[:5], "no/such.json.gz", "_pipeline/cache"])], "key string, k int")
    assert [r.held for r in artifacts.held_keys(asked, folder).orderBy("k").collect()] == [True] * 5 + [False] * 2
    for most in (7, 30):
        monkeypatch.setattr(job_ops, "MOST_LIMITED", 10)
        swept = job_ops.sweep_orphans(listed, asked, "2200-01-01 00:00:00", most=most)
        assert Counter(r.action for r in swept.collect()) == {"keep_live": 5, "delete": most, "later": 35 - most}
    os.utime(f"{folder.removeprefix('file://').removeprefix('file:')}/{names[39]}", (10**9, 10**9))
    monkeypatch.setattr(job_ops, "MOST_LIMITED", 0)
    oldest = job_ops.sweep_orphans(artifacts.list_objects(spark, folder), asked, "2200-01-01 00:00:00", most=1)
    assert [r.key for r in oldest.filter("action = 'delete'").collect()] == [names[39]]
