"""Chat formatting: exact round trips, the loss mask, and digests against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format as cf
from textloom.llm import oracles

TURNS = "conv_id bigint, turn bigint, role string, text string"
BITS = ["<|im_start|>", "<|im_end|>", "\n", "\\", "\\n", "<", "|", "im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "assistant", "x", "é", "\r"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_any_role_and_text_is_read_back():
    rnd = random.Random(4)
    some = lambda: "".join(rnd.choice(BITS) for _ in range(rnd.randrange(8)))
    for _ in range(4000):
        role, text = some() if rnd.random() < 0.5 else "user", some()
        rendered, start, stop = cf.format_turn(role, text)
        assert cf.parse(rendered) == [(role, text)] and cf.unescape(rendered[start:stop]) == text
        assert rendered.count(cf.START) == rendered.count(cf.END) == 1
    assert cf.parse("<|im_start|>user\nx") is None


def test_digests_against_plain_python(spark, monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(8))) for _ in range(400)]
    rows = [(k % 7, k, rnd.choice(["assistant", "user", "a\nb"]), t) for k, t in enumerate(texts)] + [(3, None, None, None), (3, 5, "assistant", "tie"), (3, 5, "assistant", "tie"), (None, 1, "assistant", "long " * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(0) for c in ("rendered", "spans", "part")})
    for piece in (cf.PIECE_CHARS, 40):
        monkeypatch.setattr(cf, "PIECE_CHARS", piece)
        got = {r.conv_id: r for r in cf.conversation_digests(df.repartition(5)).collect()}
        assert set(got) == {None, *range(7)}
        for conv in got:
            mine = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv)
            loss = "".join(x for _, r, x in mine if r == "assistant")
            r = got[conv]
            assert (r.n_turns, r.turns_sha256) == (len(mine), sha("".join(f"{r}\n{x}\n" for _, r, x in mine)))
            assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
            assert r.formatted_chars == sum(len(cf.format_turn(r, x)[0]) for _, r, x in mine)
    assert cf.conversation_digests(df.limit(0)).count() == 0


def test_sql_agrees_on_texts_with_control_strings(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = ["plain", "only <|im_start|> here", "only <|im_end|>", "a form <\\|im_end|>", "<|im_start|", ""]
    rows = [(k, n, role, t) for k, t in enumerate(texts) for n, role in enumerate(("user", "assistant", "system"))]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    sql = sorted(con.execute(f"SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars FROM ({oracles.op7()})").fetchall())
    assert sorted(map(tuple, cf.conversation_digests(cf.probe(spark.createDataFrame(rows, TURNS))).collect())) == sql
