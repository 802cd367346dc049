"""Stages one after another, and each stage against a plain version on odd rows."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from textloom.llm import decontaminate, quality_rules
from textloom.llm.shared_store import stored

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, n_lines string"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages_run_one_after_another(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(spark, stage(spark, docs, DATA))
        assert docs.count() <= before
        before = docs.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert before and {"token_ids", "n_tokens", "decoded_text"} <= set(docs.columns)
    assert corpus_pipeline.run(spark, DATA).count() == before


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice(["the", "of", "and", "to", "in", "house", "river", "stone"]) + rnd.choice(["", "", "s", "ly"]) + rnd.choice("abcdefgh") * rnd.randrange(3) for _ in range(n)) + "."
    rows = [(k, "\n".join(say(15) for _ in range(6)), "en") for k in range(12)]
    rows += [(20, rows[3][1], "en"), (3, rows[3][1], "en"), (21, rows[4][1] + "\n" + say(9), "en"), (22, rows[5][1].split("\n")[0] + "\n" + say(60), "en")]
    rows += [(30, None, None), (31, "", "en"), (32, " \n ", "xx"), (None, say(70), "en"), (33, say(30_000), "en")]
    return [(k, t, lang, "s", 7, "mine", "lines") for k, t, lang in rows]


def ran(spark, name, rows):
    docs = spark.createDataFrame(rows, DOCS)
    out = STAGE[name](spark, docs, DATA)
    assert name == "sentencepiece" or out.columns == docs.columns
    assert STAGE[name](spark, docs.limit(0), DATA).count() == 0
    return out.collect()


def test_quality_stage(spark, odd):
    verdicts = quality_rules.quality_signals(spark.createDataFrame(odd, DOCS)).filter("kept").select("doc_id", "text").collect()
    got = ran(spark, "quality_rules", odd)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(map(tuple, verdicts)) and 10 < len(got) < len(odd)
    assert all(r.row == "mine" and r.n_chars == 7 for r in got)


def test_line_stage(spark, odd):
    from .test_runs import brute

    distinct = [r for n, r in enumerate(odd) if n != 13]  # row 3 stands twice: only one order is told by ids
    expected = brute([(k, t) for k, t, *_ in distinct])
    left = {k: t for k, t in expected.items() if t and t.strip()}
    got = ran(spark, "line_dedup", distinct)
    assert {r.doc_id: r.text for r in got} == left and 20 not in left
    assert all(r.row == "mine" and r.n_lines == "lines" and r.n_chars in (7, len(r.text)) for r in got)
    assert Counter(r.doc_id for r in ran(spark, "line_dedup", odd))[3] == 1


def test_near_duplicate_stage(spark, odd):
    from .test_operators import shingles

    bags = [shingles(t) for _, t, *_ in odd]
    group = list(range(len(odd)))
    for i in range(len(odd)):
        for j in range(i):
            both = (bags[i] & bags[j]).total()
            if bags[i] and bags[j] and both >= 0.8 * (bags[i].total() + bags[j].total() - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    got = ran(spark, "minhash_near_dedup", odd)
    assert len(got) == len(set(group)) and Counter(r.doc_id for r in got)[3] == 1 and not any(r.doc_id in (20, 21) for r in got)


def test_benchmark_stage(spark, odd):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").filter("length(text) > 80").first()
    rows = odd + [(40, f"x {item.text.upper()} y", "en", "s", 7, "mine", "lines")]
    got = ran(spark, "benchmark_decontamination", rows)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    hit = {(r.doc_id, r.text_key) for r in decontaminate.contamination(spark.createDataFrame(rows, DOCS), bench).collect() if r.contaminated}
    assert {k for k, _ in hit} == {40} and Counter(r.doc_id for r in got) == Counter(k for k, *_ in odd)


def test_token_stage(spark, odd):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = ran(spark, "sentencepiece", odd)
    assert len(got) == len(odd)
    for r in got:
        assert list(r.token_ids) == sp.encode(r.text or "") and r.decoded_text == sp.decode(list(r.token_ids))
    assert re.match("mine", got[0].row)
