"""URL filters against the rules' definition, on the broadcast and the dealt way."""

import random

import pytest

from textloom.llm import oracles, url_filter
from textloom.llm.queries import URL_RULES

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    return rest[:end].translate(UPPER), path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]


def judged(url, rules):
    host, path = cut(url)
    fit = [(len(h) + len(p), len(h), v, h + p) for v, h, p in ((v, h.translate(UPPER), p) for v, h, p in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, verdict, rule = max(fit) if fit else (0, 0, "allow", None)
    return host, path, rule, verdict


def urls():
    rnd = random.Random(3)
    hosts = ["example.org", "A.Example.org", "org", "x.org.", "xorg", "fr.com", "com", "b.com:80", "u@b.com", "", "İx.org", "a..org", "example.org.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/de/", "/fr/#/de/", "/de/x", "/DE/", "/é/", "/fr//de/"]
    made = [f"{rnd.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths]
    return [*made, None, "", "example.org/es/", "http:/org/", "a://b://org/", "http://org/\n/x", "http://" + "a." * 3000 + "org/" + "y" * 100_000]


RULES = [*URL_RULES, ("block", "a.example.org", "/"), ("allow", "Example.org.COM", "/de/x"), ("block", "b.com:80", ""), ("allow", "org", "/en/1"), ("block", "org", "/en/1"), ("block", "é.x", "/é/"), ("block", "org", "/en/1")]


@pytest.mark.parametrize("most", [url_filter.BROADCAST_BYTES, -1])
def test_every_url_against_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", most)
    rows = [(k, u, 7, "x") for k, u in enumerate(urls())] + [(0, "http://org/", None, None), (None, "http://org/", 1, "")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, rule int, _row string")
    for rules in (RULES, []):
        got = url_filter.judge_urls(df.repartition(3), url_filter.rules_table(spark, rules))
        assert sorted(((r.page.page_id, r.page.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str) == sorted(((k, u, *judged(u, rules)) for k, u, *_ in rows), key=str)
    kept = url_filter.keep_allowed(df, url_filter.rules_table(spark, RULES))
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if judged(r[1], RULES)[3] == "allow"), key=str)
    assert url_filter.judge_urls(df.limit(0), url_filter.rules_table(spark, RULES)).count() == 0


def test_default_verdict_and_odd_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/"), (2, None)], "page_id long, url string")
    got = url_filter.judge_urls(df, url_filter.rules_table(spark, [("allow", "b", "/")]), default="block")
    assert sorted((r.page.page_id, r.verdict) for r in got.collect()) == [(1, "allow"), (2, "block")]
    with pytest.raises(Exception, match="a rule needs"):
        url_filter.judge_urls(df, spark.createDataFrame([("deny", "b", "/")], "verdict string, host string, path string")).collect()


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    some = [u for u in urls() if u is None or len(u) < 1000]
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(some)))
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({oracles.op11(RULES)})").fetchall())
    assert want == [(k, *judged(u, RULES)) for k, u in enumerate(some)]


def test_plan_joins_on_hash_prefixes_and_runs_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    plan = url_filter.judge_urls(df, url_filter.rules_table(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "prefix#" in plan and "Python" not in plan.split("== Physical Plan ==")[1].replace("applySchemaToPythonRDD", "") and "CartesianProduct" not in plan and "NestedLoop" not in plan
