"""Text forms, query language, structural chunks, evaluation sets and keys on small rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import evaluation, jobs, query_language, structure
from textloom.streaming.ingest_stream import event_windows


def test_compatibility_forms_and_spaces(spark):
    rows = ["ﬁne ａｂｃ１", "a b", "​x​  y", "m²", None, "plain", " "]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r.c for r in df.select(tx.clean_text(F.col("t")).alias("c")).collect()]
    assert got == ["fine abc1", "a b", "x y", "m2", None, "plain", ""]
    assert all(g is None or unicodedata.is_normalized("NFKC", g) for g in got)
    normal = [r.c for r in spark.createDataFrame([(" a \n b ",), ("　 ",)], "t string").select(tx.normal_query(F.col("t")).alias("c")).collect()]
    assert normal == ["a b", None]


@pytest.mark.parametrize(
    ("search", "found"),
    [("cat dog", [1]), ('"big cat"', [1, 2]), ("cat -dog", [2]), ("bird OR dog", [1, 3]), ('"big cat" -dog or bird', [2, 3]), ("-", []), ('"unclosed cat', []), ("-cat", [3]), ("", [])],
)
def test_web_search(spark, search, found):
    docs = spark.createDataFrame([(1, "u", "a Big cat, a dog"), (2, "u", "the big cat"), (3, "u", "one bird"), (4, "other", "big cat dog bird")], "document_id bigint, user_id string, text string")
    asked = spark.createDataFrame([(9, "u", search)], "query_id bigint, user_id string, text string")
    assert sorted(r.document_id for r in query_language.web_search(asked, docs).collect()) == found


ITEMS = "doc_id bigint, item int, level int, text string, page int"


def test_structural_chunks(spark):
    rows = [(1, 0, None, "before", 1), (1, 1, 1, "One", 1), (1, 2, None, "a b c", 2), (1, 3, None, "d e", 1), (1, 4, 2, "Sub", 2), (1, 5, None, "f", None), (1, 6, 1, "Two", 3), (1, 7, None, "", 3)]
    items = spark.createDataFrame(rows, ITEMS)
    bodies = [(r.section, r.page, r.text) for r in structure.merged_bodies(items).orderBy("part").collect()]
    assert bodies == [(None, 1, "before"), ("One", 1, "a b c\nd e"), ("One > Sub", None, "f"), ("Two", 3, "")]
    pieces = [(r.section, r.piece, r.text) for r in structure.structural_chunks(items, limit=4, overlap=1).orderBy("part", "piece").collect()]
    assert pieces == [(None, 0, "before"), ("One", 0, "One a b c"), ("One", 1, "One c d e"), ("One > Sub", 0, "One Sub f")]
    with pytest.raises(Exception, match="no room"):
        structure.structural_chunks(items, limit=1).collect()
    with pytest.raises(Exception, match="longer than the limit"):
        structure.structural_chunks(items, limit=4, split=False).collect()


def test_vectors_are_checked_before_they_are_written(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "chunk_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="index: 2"):
        structure.indexable(df, 2).write.format("noop").mode("overwrite").save()
    assert structure.indexable(df.filter("chunk_id = 1"), 2).count() == 1
    with pytest.raises(ValueError):
        structure.embedder("none")


def test_evaluation_set_on_disk(spark, tmp_path):
    lines = ['{"id": "a", "query": "q", "user_id": "u", "relevant_chunk_ids": ["2", "1"], "notes": 5}', "", "  # no case", '{"id": "b", "answerable": false}']
    cases = evaluation.read_cases(spark.createDataFrame([(x,) for x in lines], "value string"))
    evaluation.save_cases(cases, str(tmp_path / "set"))
    got = sorted((tuple(r) for r in evaluation.load_cases(spark, str(tmp_path / "set")).collect()), key=lambda r: r[0])
    assert got == [("a", "q", "u", [], ["1", "2"], True, "", []), ("b", None, None, [], [], False, "", [])]


def test_keys_and_orphans(spark):
    u = "00000000-0000-4000-8000-000000000001"
    keys = [f"{u}/ab/{'c' * 64}.txt", f"_pipeline/cache/{'d' * 16}/{'e' * 64}/clean.json.gz", "x/y", f"{u}/_pipeline/{u}/new.json", f"x/_pipeline/{u}/new.json", f"{u.upper()}/_pipeline/{u}/up.json"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert [r.s for r in df.select(jobs.key_shape(F.col("key")).alias("s")).collect()][:3] == ["user", "artifact", None]
    live = df.filter(F.col("key").endswith(".txt"))
    owners = spark.createDataFrame([(u, u)], "user_id string, document_id string")
    assert {r.key for r in jobs.orphans(df, live, owners).collect()} == {keys[1], keys[2], keys[4]}


def test_event_windows_drop_late_rows(spark, tmp_path):
    spark.createDataFrame([(f"2024-01-01 0{h}:30:00", "a", float(h)) for h in (1, 1, 2)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = event_windows(stream).writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.n, r.total) for r in spark.table("win").collect()) == [(1, 2.0), (2, 2.0)]
