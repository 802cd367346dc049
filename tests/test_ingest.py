import pytest

from textloom.functions import text as tx
from textloom.operators import ingest
from textloom.streaming import ingest_stream
from pyspark.sql import functions as F

ITEMS = "doc_id bigint, item int, text string"


@pytest.mark.parametrize("raw, clean", [("a  b\t c", "a b c"), ("a\n\n\n\nb", "a\n\nb"), (" ​x﻿ ", "x"), ("", ""), ("​", "")])
def test_clean_text(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(tx.clean_text(F.col("t"))).first()[0] == clean


def toc(spark, entries):
    rows = [(1, at, f"Chapter ..... {page}") for at, page in entries]
    return ingest.toc_documents(spark.createDataFrame(rows, ITEMS)).first()


def test_toc(spark):
    assert toc(spark, [(i, p) for i, p in enumerate((1, 11, 21, 31, 41))]).is_toc
    assert not toc(spark, [(i, p) for i, p in enumerate((1, 11, 21, 31))]).is_toc
    assert not toc(spark, [(i * 10, p) for i, p in enumerate((1, 11, 21, 31, 41))]).is_toc
    assert not toc(spark, [(i, p) for i, p in enumerate((41, 31, 21, 11, 1))]).is_toc


def test_prune_keeps_the_body(spark):
    rows = [(1, i, f"Part .... {i + 1}") for i in range(5)] + [(1, 5, "body"), (2, 0, "Part .... 9")]
    left = ingest.prune_toc(spark.createDataFrame(rows, ITEMS)).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, "body"), (2, "Part .... 9")]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 120, 121, 500])
def test_windows_cover_all_words_with_exact_overlap(spark, n):
    w = [f"w{i}" for i in range(n)]
    got = [r.text.split() for r in ingest.token_windows(spark.createDataFrame([(1, " ".join(w))], "doc_id bigint, text string")).orderBy("piece").collect()]
    expected, at = [], 0
    while w:
        expected.append(w[at : at + 64])
        if at + 64 >= n:
            break
        at += 56
    assert got == expected


def test_window_prefix(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.piece, r.text) for r in ingest.token_windows(df, 4, 1, "P Q").collect())
    assert got == [(1, 0, "P Q a b"), (1, 1, "P Q b c"), (1, 2, "P Q c d"), (2, 0, "P Q")]
    with pytest.raises(ValueError):
        ingest.token_windows(df, 2, 0, "P Q")


def test_replace_chunks_is_idempotent(spark):
    old = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "document_id bigint, chunk_index int, text string")
    new = spark.createDataFrame([(1, 0, "z")], old.schema)
    once = ingest.replace_chunks(old, new)
    assert sorted(ingest.replace_chunks(once, new).collect()) == sorted(once.collect()) == [(1, 0, "z"), (2, 0, "y")]


def test_stream_ingests_each_content_once(spark, tmp_path):
    rows = [(1, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5), (3, "d  e", "en", "s", 4)]
    spark.createDataFrame(rows, ingest_stream.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = ingest_stream.ingest_chunks(ingest_stream.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == ["a b c", "d e"]
