"""Artifacts, listings, sinks, updates, cascades, JSON and types of files."""

import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import json as tj
from textloom.functions import mime
from textloom.operators import cascade, sinks, updates
from textloom.operators import jobs as job_ops
from textloom.sources import artifacts
from textloom.sources.shared import new_path

KEY = "_pipeline/cache/{:016x}/{:064x}/chunk.json.gz"


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def files(folder):
    return sorted(os.path.relpath(os.path.join(at, n), local(folder)) for at, _, names in os.walk(local(folder)) for n in names)


def test_artifacts_are_written_once_and_read_with_defaults(spark):
    folder = new_path(spark)
    chunks = spark.createDataFrame([(KEY.format(1, k % 3), k // 3, f"é {k}", ["x"] if k else None) for k in range(9)], "key string, chunk_index long, text string, labels array<string>")
    made = artifacts.chunk_artifacts(chunks.repartition(4))
    artifacts.write_artifacts(made, folder)
    first = {f: open(f"{local(folder)}/{f}", "rb").read() for f in files(folder)}
    artifacts.write_artifacts(made.unionByName(made), folder)  # again, and each key twice
    assert {f: open(f"{local(folder)}/{f}", "rb").read() for f in files(folder)} == first and len(first) == 3
    assert [r["text"] for r in json.loads(gzip.decompress(first[KEY.format(1, 0)]))] == ["é 0", "é 3", "é 6"]
    got = sorted((r.key, r.chunk_index, r.text, r.labels) for r in artifacts.load_chunks(spark, folder).collect())
    assert got == sorted((KEY.format(1, k % 3), k // 3, f"é {k}", ["x"] if k else []) for k in range(9))
    writer = artifacts.ArtifactWriter(folder)
    row = {"key": KEY.format(1, 0), "payload": "[]"}
    assert writer.write(iter([row, row])).keys == 2 and len(files(folder)) == 3  # a repeated task leaves one file
    for key in ("../x.json.gz", "a/../../x.json.gz", "/etc/x.json.gz", "x.json", None, "a//b.json.gz"):
        with pytest.raises(ValueError, match="no artifact"):
            writer.write(iter([{"key": key, "payload": "[]"}]))
    assert artifacts.load_chunks(spark, new_path(spark)).count() == 0


def test_listing_leaves_out_what_is_in_flight(spark):
    folder = new_path(spark)
    assert artifacts.list_objects(spark, folder).count() == 0
    for name in ("u/1/a.pdf", "_pipeline/cache/x/y/chunk.json.gz", "_pipeline/cache/x/y/clean.json.gz.77.inprogress", ".tmp/up1", "b.bin"):
        os.makedirs(os.path.dirname(f"{local(folder)}/{name}"), exist_ok=True)
        with open(f"{local(folder)}/{name}", "w") as f:
            f.write("12345")
    os.utime(f"{local(folder)}/b.bin", (10**9, 10**9))
    listed = artifacts.list_objects(spark, folder)
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    assert sorted((r.key, r.size) for r in listed.collect()) == [("_pipeline/cache/x/y/chunk.json.gz", 5), ("b.bin", 5), ("u/1/a.pdf", 5)]
    live = spark.createDataFrame([("u/1/a.pdf",)], "key string")
    swept = job_ops.sweep_orphans(listed, live, "2100-01-01 00:00:00", most=1)
    assert {r.key: r.action for r in swept.collect()} == {"u/1/a.pdf": "keep_live", "b.bin": "delete", "_pipeline/cache/x/y/chunk.json.gz": "later"}
    assert job_ops.sweep_orphans(listed, live, "2001-09-09 02:00:00").filter("action = 'keep_young'").count() == 2


def test_replacing_deleting_and_adding_documents(spark):
    schema, path = "document_id long, n long, x string", new_path(spark)
    table = lambda: sorted(map(tuple, sinks.read_table(spark, path, schema).collect()))
    rows = lambda *ids, n=3, x="a": [(i, k, x) for i in ids for k in range(n)]
    df = lambda r: spark.createDataFrame(r, schema)
    assert table() == [] and sinks.replace_documents(df([]), path).count() == 0 and sinks.insert_documents(df([]), path) == 0
    assert not os.path.exists(local(path))
    assert sinks.insert_documents(df(rows(*range(100))), path) == 300
    files_before = {f: os.stat(f"{local(path)}/{f}").st_mtime_ns for f in files(path)}
    fresh = df(rows(7, 200, n=5, x="b"))
    for k in range(2):
        counts = sorted(map(tuple, sinks.replace_documents(fresh, path).select("document_id", "n_deleted", "n_inserted").collect()))
        assert counts == [(7, 5 if k else 3, 5), (200, 5 if k else 0, 5)]
        assert table() == sorted([r for r in rows(*range(100)) if r[0] != 7] + rows(7, 200, n=5, x="b"))
    same = sum(files_before.get(f) == os.stat(f"{local(path)}/{f}").st_mtime_ns for f in files(path))
    assert same >= len(files_before) - 8  # two buckets of four files
    gone = sinks.delete_documents(spark.createDataFrame([(7,), (7,), (8,), (999,), (None,)], "document_id long"), path, schema)
    assert sorted(map(tuple, gone.collect())) == [(7, 5), (8, 3), (999, 0)]
    assert table() == sorted([r for r in rows(*range(100)) if r[0] not in (7, 8)] + rows(200, n=5, x="b"))
    sinks.delete_documents(spark.range(300).select(F.col("id").alias("document_id")), path, schema)
    assert table() == []
    with pytest.raises(Exception, match="a row without document_id"):
        sinks.replace_documents(df([(None, 1, "x")]), path)


def test_updates_make_one_row_and_keep_columns(spark):
    jobs = spark.createDataFrame([(k, "running", '{"a":1,"n":{"x":[1,2]},"t":true}' if k < 3 else None if k == 3 else "oops", f"own {k}") for k in range(5)], "job_id long, status string, details string, owner string")
    jobs = jobs.withColumns({c: F.lit(None).cast("timestamp") for c in ("started_at", "finished_at")})
    ups = [(1, "running", "2024-01-01 10:00:00", '{"a":2.50}'), (1, "done", "2024-01-01 11:00:00", '{"b":null,"n":7}'), (1, "failed", "2024-01-01 09:00:00", '{"a":"early","c":[1]}'), (3, "running", "2024-01-01 10:00:00", '{"z":"1"}'), (4, "done", "2024-01-01 10:00:00", '{"z":1}'), (2, "done", "2024-01-01 10:00:00", "bad"), (77, "done", "2024-01-01 10:00:00", None), (None, "done", "2024-01-01 10:00:00", None)]
    u = spark.createDataFrame(ups, "job_id long, to string, at string, more string").withColumn("at", F.to_timestamp("at"))
    for given in (u, u.unionByName(u)):
        after = updates.mark(jobs, given.repartition(3))
        assert after.columns == jobs.columns
        got = {r.job_id: (r.status, r.owner, r.details, r.started_at and r.started_at.hour, r.finished_at and r.finished_at.hour) for r in after.collect()}
        assert after.count() == 5 and got[0] == ("running", "own 0", '{"a":1,"n":{"x":[1,2]},"t":true}', None, None)
        assert got[1] == ("done", "own 1", '{"a":2.5,"b":null,"c":[1],"n":7,"t":true}', 10, 11)
        assert got[2] == ("done", "own 2", '{"a":1,"n":{"x":[1,2]},"t":true}', None, 10)
        assert got[3] == ("running", "own 3", '{"z":"1"}', 10, None) and got[4] == ("done", "own 4", "oops", None, 10)
    docs = spark.createDataFrame([(1, "pending", "e", "o"), (2, "pending", "e", "o")], "document_id long, status string, error string, owner string").withColumn("indexed_at", F.lit(None).cast("timestamp"))
    s = spark.createDataFrame([(1, "indexed", None, 1), (1, "failed", "why", 2), (1, "processing", None, 3)], "document_id long, to string, why string, at long").withColumn("at", F.timestamp_seconds("at"))
    got = {r.document_id: r for r in updates.set_status(docs, s).collect()}
    assert (got[1].status, got[1].error, got[1].owner, got[1].indexed_at is not None) == ("processing", None, "o", True) and got[2].error == "e"
    runs = spark.createDataFrame([(1, "new", "m", 5)], "run_id long, status string, metrics string, extra int").withColumn("finished_at", F.lit(None).cast("timestamp"))
    r = spark.createDataFrame([(1, "failed", None, 1), (1, "completed", "n", 2), (1, None, None, 3)], "run_id long, new_status string, new_metrics string, at long").withColumn("at", F.timestamp_seconds("at"))
    (one,) = updates.set_run_status(runs, r).collect()
    assert (one.status, one.metrics, one.extra, one.finished_at.second) == ("completed", "n", 5, 1)
    with pytest.raises(ValueError, match="share no column"):
        updates.patch(docs, "document_id", spark.createDataFrame([(1, 2)], "document_id long, seq long"), ["seq"])


def test_json_kinds_and_merges(spark):
    texts = [('{"a":1}', "object"), ("[1]", "value"), ("3", "value"), ("null", "value"), ("", "bad"), ("{", "bad"), ('{"a":1,"a":2}', "bad"), (None, "absent"), ('{"é":{"b":[1,{"c":null}]}}', "object"), ("{}", "object")]
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, j string, kind string")
    assert df.filter(tj.json_kind(F.col("j")) != F.col("kind")).count() == 0
    merged = {r.k: r.m for r in df.select("k", tj.merged_json(F.col("j"), F.lit('{"z":1e3,"a":[true]}')).alias("m")).collect()}
    assert json.loads(merged[8]) == {"é": {"b": [1, {"c": None}]}, "z": 1000.0, "a": [True]}
    assert json.loads(merged[0]) == json.loads(merged[7]) == {"a": [True], "z": 1000.0} and merged[1] is merged[4] is None


def test_cascade_over_levels_and_circles(spark):
    rnd = random.Random(3)
    df = lambda rows, s: spark.createDataFrame(rows, s)
    docs = [(k, rnd.choice([1, 2, 3, None])) for k in range(40)]
    chunks = [(k, rnd.randrange(40)) for k in range(90)]
    messages = [(k, rnd.randrange(4)) for k in range(30)]
    citations = [(k, rnd.choice([None, *range(30)]), rnd.choice([None, *range(90)])) for k in range(80)]
    tables = {"citations": df(citations, "citation_id long, message_id long, chunk_id long"), "messages": df(messages, "message_id long, conversation_id long"), "chunks": df(chunks, "chunk_id long, document_id long"), "documents": df(docs, "document_id long, user_id long"), "users": df([(1,), (2,), (3,)], "user_id long"), "conversations": df([(k, k + 1) for k in range(4)], "conversation_id long, user_id long")}
    left, counts = cascade.cascade(tables, cascade.SCHEMA_KEYS, {"users": df([(1,), (1,), (9,)], "user_id long"), "chunks": df([(5,)], "chunk_id long")})
    gone_docs = {k for k, u in docs if u == 1}
    gone_chunks = {k for k, d in chunks if d in gone_docs or k == 5}
    gone_messages = {k for k, c in messages if c == 0}
    kept = {"citations": [r for r in citations if r[1] not in gone_messages and r[2] not in gone_chunks], "messages": [r for r in messages if r[0] not in gone_messages], "chunks": [r for r in chunks if r[0] not in gone_chunks], "documents": [r for r in docs if r[0] not in gone_docs], "users": [(2,), (3,)], "conversations": [(k, k + 1) for k in range(1, 4)]}
    total = {"citations": 80, "messages": 30, "chunks": 90, "documents": 40, "users": 3, "conversations": 4}
    assert {t: sorted(map(tuple, d.collect()), key=str) for t, d in left.items()} == {t: sorted(r, key=str) for t, r in kept.items()}
    assert all(left[t].columns == tables[t].columns for t in tables)
    assert {r["table"]: r.n_deleted for r in counts.collect()} == {t: total[t] - len(kept[t]) for t in total}
    with pytest.raises(ValueError, match="circle"):
        cascade.in_order([cascade.Key("a", "x", "b", "y"), cascade.Key("b", "x", "a", "y")], ["a", "b", "c"])


def test_types_by_signature(spark):
    office = mime.OFFICE
    cases = [(magic + b"tail", "x.md", kind) for magic, kind in mime.SIGNATURES]
    cases += [(mime.ZIP + b"\x00\x00word/document.xml", "a", office + "wordprocessingml.document"), (mime.ZIP + b"..xl/..", "a", office + "spreadsheetml.sheet"), (mime.ZIP + b"ppt/", "a", office + "presentationml.presentation"), (mime.ZIP, "a.txt", "application/zip")]
    cases += [(b"", "a.md", None), (None, "a.md", None), (b"\x00text", "a.md", "application/octet-stream"), (b"caf\xe9", "a.txt", "application/octet-stream"), ("é".encode() * 5000, "a.txt", "text/plain"), (b"x" + "é".encode() * 5000, "a.txt", "application/octet-stream")]  # the last is cut in a character
    cases += [(b"\n <HTML>", "a.txt", "text/html"), (b"<?xml", None, "text/html"), (b"# t", "A.MD", "text/markdown"), (b"# t", "b.mkd", "text/markdown"), (b"p", "c.xhtml", "text/html"), (b"p", None, "text/plain"), (b"\x01" * 5 + b"x" * 95, "a", "application/octet-stream"), (b"\x01" * 4 + b"x" * 96, "a", "text/plain"), (b"\t\r\n\f" * 9, "a", "text/plain")]
    df = spark.createDataFrame([(k, None if h is None else bytearray(h), n, m) for k, (h, n, m) in enumerate(cases)], "k int, h binary, n string, m string")
    bad = df.withColumn("got", mime.detect_mime(F.col("h"), F.col("n"))).filter("not got <=> m").collect()
    assert bad == []
    assert df.filter(mime.accepted(mime.detect_mime(F.col("h"), F.col("n")))).count() == sum(m in mime.ALLOWED for *_, m in cases)


def test_markup_cut_inside_a_character(spark):
    long = "é".encode() * 3000
    cases = [(b"<?xml?>" + long, "text/html"), (b" <!DOCTYPE html>x" + long, "text/html"), (b"<html>" + b"\xff" + long, "application/octet-stream"), (b"<html>\x00" + long, "application/octet-stream"), (b"x" + long, "application/octet-stream")]
    df = spark.createDataFrame([(bytearray(h), "a.md", m) for h, m in cases], "h binary, n string, m string")
    assert df.withColumn("got", mime.detect_mime(F.col("h"), F.col("n"))).filter("not got <=> m").collect() == []


def test_ingestion_reads_what_it_has_and_makes_the_rest(spark):
    from textloom.operators import stages

    docs = spark.createDataFrame([(1, "h1", "one  two three"), (2, "h1", "one  two three"), (3, "h2", "​  "), (4, "h3", "a b c d e f"), (5, None, "x"), (6, "h6", None)], "document_id long, content_hash string, text string")
    calls = []

    def counted(name, stage):
        def run(rows):
            calls.extend((name, r.content_hash) for r in rows.select("content_hash").distinct().collect())
            return stage(rows)

        return run

    made = lambda limit: {"clean": counted("clean", stages.clean), "chunk": counted("chunk", stages.chunk(limit, 1)), "embed": counted("embed", stages.embed("hashing-64"))}
    configs = {"extract": "e", "clean": "c", "chunk": "3", "embed": "64"}
    folder = new_path(spark)
    results = []
    for limit, given in ((3, docs.filter("document_id < 3")), (3, docs), (3, docs), (2, docs)):
        calls.clear()
        chunks, counts = stages.ingest(given, folder, configs | {"chunk": str(limit)}, made(limit))
        rows = sorted((r.document_id, r.chunk_index, r.text, len(r.embedding)) for r in chunks.collect())
        results.append((rows, {r.stage: (r.n_cached, r.n_computed) for r in counts.collect()}, sorted(calls)))
    three = [(k, 0, "one two three", 64) for k in (1, 2)] + [(4, 0, "a b c", 64), (4, 1, "c d e", 64), (4, 2, "e f", 64)]
    assert results[0] == (three[:2], dict.fromkeys(("clean", "chunk", "embed"), (0, 1)), [("chunk", "h1"), ("clean", "h1"), ("embed", "h1")])
    assert results[1] == (three, dict.fromkeys(("clean", "chunk", "embed"), (1, 2)), [("chunk", "h3"), ("clean", "h2"), ("clean", "h3"), ("embed", "h3")])
    assert results[2] == (three, dict.fromkeys(("clean", "chunk", "embed"), (3, 0)), [])
    assert results[3][1] == {"clean": (3, 0), "chunk": (0, 3), "embed": (0, 3)} and ("clean", "h1") not in results[3][2]
    assert [r for r in results[3][0] if r[0] == 1] == [(1, 0, "one two", 64), (1, 1, "two three", 64)]
    with pytest.raises(ValueError, match="without a place"):
        stages.ingest(docs, folder, configs, {"paint": stages.clean})
