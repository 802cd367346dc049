"""Training-data operators against plain versions, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import line_dedup, near_dup, quality_rules, repeated_runs, sentencepiece_codec, substring_dedup, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed, vocabulary=4000):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def store(spark, tmp_path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


@pytest.fixture
def docs(spark, tmp_path):
    passage = words(60, 1)
    rows = []
    for i in range(24):
        w = words(120 + i, 100 + i)
        if i % 3 == 0:
            w[40:40] = passage
        rows.append((i, "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)), "en", "s", 1))
    rows += [(100, rows[5][1], "en", "s", 1), (5, rows[5][1], "en", "s", 1), (101, None, None, None, None), (102, "", "xx", "s", 0), (103, " \n\t ", "en", "s", 3), (None, "only three words", "en", "s", 1)]
    near = rows[7][1].split(" ")
    near[3] = "changed"
    rows.append((104, " ".join(near), "en", "s", 1))
    rows.append((105, "again and " * 200, "en", "s", 1))
    return store(spark, tmp_path, rows)


def test_substring_dedup_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    all_words = [WORDS.findall(r.text or "") for r in rows]
    seen = Counter(tuple(w[k : k + 35]) for w in all_words for k in range(len(w) - 34))
    expected = Counter()
    for r, w in zip(rows, all_words):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    clash = docs.withColumn("n_words", F.lit("mine")).withColumn("_extra", F.lit(1))
    got = substring_dedup.dedup_substrings(clash)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == expected
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_cover_is_a_difference_cover():
    residues = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert residues == set(range(substring_dedup.PERIOD))


def test_line_dedup_keeps_the_first_run(spark, tmp_path):
    run = "first line\nsecond line\nthird line"
    rows = [(2, f"own two\n{run}\nend", "en", "s", 1), (1, f"{run}\nown one", "en", "s", 1), (3, "first line\nsecond line\nother", "en", "s", 1), (4, None, None, None, None), (5, f"{run}\n\n{run}", "en", "s", 9), (None, run, "en", "s", 1)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(store(spark, tmp_path, rows)).collect()}
    assert got[1].text == f"{run}\nown one" and got[1].n_removed_lines == 0
    assert got[2].text == "own two\nend" and got[2].n_removed_lines == 3 and got[2].n_chars == len("own two\nend")
    assert got[3].n_removed_lines == 0 and got[4].text is None
    assert got[5].n_removed_lines == 6 and got[None].text == ""


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicates_against_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    bags = [shingles(r.text) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = (bags[i] & bags[j]).total()
            if bags[i] and bags[j] and both >= 0.8 * (bags[i].total() + bags[j].total() - both):
                parent[root(i)] = root(j)
    smallest = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            smallest[root(k)] = min(smallest.get(root(k), r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, smallest.get(root(k))) for k, r in enumerate(rows))
    got = near_dup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == expected
    assert sum(r.keeper for r in got) == len({root(k) for k in range(len(rows))})
    kept = near_dup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.keeper for r in got)


def test_bag_minhash_estimates_weighted_jaccard():
    import numpy as np

    from textloom.llm import textarrays as ta

    ids = ta.mix(np.arange(1, 301, dtype=np.uint64))
    rnd = np.random.default_rng(5)
    a, b = rnd.integers(0, 9, 300), rnd.integers(0, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    h = np.concatenate([np.sort(np.repeat(ids, a)), np.sort(np.repeat(ids, b))])
    s = near_dup.bag_minhash(h, np.array([0, a.sum(), a.sum() + b.sum()]), 4096)
    assert abs((s[0] == s[1]).mean() - true) < 0.04


def plain_counts(text):
    w = WORDS.findall(text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>") if text else 0, len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("spare", [0, 44])
def test_quality_counts_against_brute_force(spark, docs, monkeypatch, spare):
    monkeypatch.setattr(quality_rules, "SPARE_BITS", spare)  # hashes that don't tell windows apart
    rnd = random.Random(1)
    rows = [(k, " ".join(rnd.choice("abcd|#é") for _ in range(rnd.randrange(60)))) for k in range(40)] + [(50, " ".join(f"w{k % 30_011}" for k in range(60_000)))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id bigint, text string")).withColumn("lang", F.lit("en"))
    names = ("_w", "_h", "_doc", "doc", "_text", "kept")
    got = quality_rules.quality_signals(df.withColumns({c: F.lit("mine") for c in names}))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()) == Counter((r.doc_id, *plain_counts(r.text)) for r in df.collect())
    assert got.filter("_w != 'mine' or _doc != 'mine' or doc != 'mine'").count() == 0


def test_quality_verdicts(spark, docs):
    kept = quality_rules.keep_good(docs.withColumn("_doc", F.lit(1)))
    assert kept.columns == [*docs.columns, "_doc"] and not kept.filter("doc_id in (101, 102, 103, 105) or doc_id is null").count()
    assert quality_rules.keep_good(docs.limit(0)).count() == 0
    junk = spark.createDataFrame([(1, "### | $$$ 123 | " * 60 + " ".join(words(80, 3)), "en")], "doc_id bigint, text string, lang string")
    assert not quality_rules.quality_signals(junk).first().kept


def test_each_distance_rejects_by_itself_and_leaves_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    pytest.importorskip("pathlib").Path(folder).is_dir() or pytest.skip("no tables")
    signals = quality_rules.quality_signals(spark.read.parquet(f"{folder}/documents.parquet")).filter("not base_failed")
    rows = signals.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    # words of no language in running prose: only the word distance can tell
    rnd = random.Random(5)
    prose = " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) + ("." if k % 8 == 7 else "") for k in range(900))
    r = quality_rules.quality_signals(spark.createDataFrame([(1, prose, "en")], "doc_id bigint, text string, lang string")).first()
    assert not r.base_failed and not r.kept and r.class_distance < quality_rules.MOST_CLASS_DISTANCE


def test_sentencepiece_against_the_library(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    own, sp = sentencepiece_codec.PieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(2)
    alphabet = " ▁\n\tabcdetinghoés.,🙂éñß漢字 the<s>ﬁ\x00  "
    for _ in range(3000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
        ids = own.encode(s)
        assert ids == sp.encode(s)
        assert own.decode(ids) == sp.decode(ids)
    got = sentencepiece_codec.encode_decode(docs.withColumn("n_tokens", F.lit("mine")), path).collect()
    assert all(list(r.token_ids) == sp.encode(r.text or "") and r.n_tokens == len(r.token_ids) for r in got)
    assert all(r.decoded_text == sp.decode(sp.encode(r.text or "")) for r in got)


def test_toxicity_learns_words_and_word_parts(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(1500):
        w = words(60, 1000 + i, 300)
        bad = i % 5 == 0
        if bad:
            w[rnd.randrange(60)] = rnd.choice(["grobble", "snarkfool", "snarkling"])
        rows.append((i, " ".join(w)))
        if i < 1200:
            labels.append((i, int(bad)))
    rows += [(5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score, i % 5 == 0) for i in range(1500) if got[i].held_out]
    pos, neg = [s for s, b in held if b], [s for s, b in held if not b]
    assert sum(p > n for p in pos for n in neg) / (len(pos) * len(neg)) > 0.95
    none = toxicity.toxicity_scores(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).select("score").distinct().collect()
    assert len(none) == 1


def test_toxicity_takes_unlabelled_texts_from_all_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(400)], "doc_id bigint, text string")
    known = [(i, int(i % 4 == 0)) for i in range(0, 200)]
    ghosts = [(i, 1) for i in range(10_000, 20_000)]
    inside = set(docs.filter(~toxicity.held_out(F.col("doc_id"))).select("doc_id").toPandas().doc_id)
    seen = {}

    def fit(positive, unlabelled, prior):
        seen.update(positive=len(positive), unlabelled=len({x.tobytes() for x in unlabelled}), prior=prior)
        return toxicity.np.zeros(1 << toxicity.BITS), 0.0

    monkeypatch.setattr(toxicity, "fit", fit)
    toxicity.train(docs, spark.createDataFrame(known, "doc_id bigint, toxic int"))
    in_fold = [t for i, t in known if i in inside]
    assert seen == {"positive": sum(in_fold), "unlabelled": len(inside), "prior": sum(in_fold) / len(in_fold)}
    toxicity.train(docs, spark.createDataFrame(known + ghosts, "doc_id bigint, toxic int"))
    assert (seen["positive"], seen["unlabelled"]) == (sum(in_fold), len(inside))


def test_risk_of_a_mixture_is_that_of_known_classes():
    """Positive-unlabelled risk against the risk with all labels, on scores of two known classes mixed."""
    import numpy as np

    rnd = np.random.default_rng(1)
    for prior in (0.1, 0.4):
        toxic, clean = rnd.normal(1.0, 1.5, 200_000), rnd.normal(-1.0, 1.0, 200_000)
        mixed = np.where(rnd.random(200_000) < prior, rnd.permutation(toxic), clean)
        ours = toxicity.nnpu_risk(toxic, mixed, prior)
        true = prior * np.mean(np.log1p(np.exp(-toxic))), (1 - prior) * np.mean(np.log1p(np.exp(clean)))
        assert abs(ours[0] - true[0]) < 0.005 and abs(ours[1] - true[1]) < 0.01


def test_toxicity_on_odd_rows(spark):
    docs = spark.createDataFrame([(k, "grobble stuff here" if k % 3 == 0 else "plain words only") for k in range(90)] + [(None, "grobble"), (7, "plain words only"), (300, "long " * 300_000), (301, None)], "doc_id bigint, text string").withColumns({c: F.lit("mine") for c in ("_id", "_held", "toxic", "score")})
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)] + [(None, 1), (5, None), (0, 0), (0, 1), (999, 1)], "doc_id bigint, toxic int").withColumn("text", F.lit("mine"))
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 94 and all(0 <= r.score <= 1 for r in got) and {r.held_out for r in got if r.doc_id is None} == {False}
    assert len({r.score for r in got if r.doc_id == 7}) == 1
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_row_numbers_hold_when_a_scan_is_split_anew(spark, docs, monkeypatch):
    whole = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.minPartitionNum": "1"}
    split = {"spark.sql.files.openCostInBytes": "1g", "spark.sql.files.maxPartitionBytes": "1g", "spark.sql.files.minPartitionNum": "1"}
    set_all = lambda of: [spark.conf.set(k, v) for k, v in of.items()]
    expected = Counter((r.doc_id, r.class_id) for r in near_dup.near_duplicates(docs).collect())
    kept = Counter(tuple(r) for r in near_dup.keep_one_of_each(docs).collect())
    store_it = near_dup.stored
    calls = []

    def stored(session, df):
        calls.append(0)
        set_all(whole if len(calls) == 1 else split)
        return store_it(session, df)

    try:
        for what in (docs, docs.union(docs.limit(0)), docs.join(spark.createDataFrame([(1,), (1,)], "x int"))):
            rows = repeated_runs.with_row_ids(what, "doc_id").select("_row", "doc.doc_id", "doc.text")
            numbers = []
            for of in (whole, split):
                set_all(of)
                numbers.append(Counter((r._row, r.doc_id, r.text) for r in rows.collect()))
            assert numbers[0] == numbers[1] and len({k[0] for k in numbers[0]}) == what.count()
        monkeypatch.setattr(near_dup, "stored", stored)
        assert Counter((r.doc_id, r.class_id) for r in near_dup.near_duplicates(docs).collect()) == expected
        calls.clear()
        assert Counter(tuple(r) for r in near_dup.keep_one_of_each(docs).collect()) == kept
    finally:
        for k in whole:
            spark.conf.unset(k)
