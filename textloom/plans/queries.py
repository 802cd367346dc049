"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.config import RetrievalConfig
from textloom.functions import text as tx
from textloom.operators import ingest, jobs as job_ops, metrics, passages, relational, retrieval
from textloom.sources import tables as src

from .hybrid import HybridRetriever

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DOCS = """docs AS (SELECT d.doc_id AS document_id, d.source AS user_id, sha256(d.text) AS content_hash, d.n_chars AS size_bytes,
  CASE WHEN l.quality = 1 THEN 'indexed' WHEN l.quality = 0 THEN 'failed' WHEN d.doc_id % 2 = 0 THEN 'pending' ELSE 'processing' END AS status, d.text
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
CHUNKS = r"""chunks AS (SELECT e.vec_id AS chunk_id, e.vec_id // 8 AS document_id, CAST(e.vec_id % 8 AS INT) AS chunk_index,
  CAST(e.embedding AS DOUBLE[]) AS embedding, d.text, coalesce(len(regexp_extract_all(d.text, '[^ \t\n\r]+')), 0) AS token_count,
  CASE WHEN e.vec_id % 5 <> 0 THEN CAST(e.vec_id % 8 // 2 + 1 AS INT) END AS page_number, CASE WHEN e.vec_id % 3 <> 0 THEN 'Part ' || (e.vec_id % 8 // 4) END AS section
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id),
q AS (SELECT chunk_id AS query_id, embedding, document_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS text FROM chunks WHERE chunk_id % 100 = 0),
corpus AS (SELECT * FROM chunks)"""
VECTOR = """vector AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT q.query_id, c.chunk_id, list_cosine_similarity(q.embedding, c.embedding) AS score FROM q, corpus c)) WHERE rank <= 50)"""
KEYWORD = r"""terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS lexeme FROM q),
words AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS lexeme FROM corpus),
keyword AS (SELECT * FROM (SELECT query_id, chunk_id, n / (n + 10.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY n / (n + 10.0) DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, count(*) AS n FROM words JOIN terms USING (lexeme) GROUP BY ALL)) WHERE rank <= 50)"""
FUSED = """fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vector_rank ASC NULLS LAST, keyword_rank ASC NULLS LAST) AS fused_rank FROM (
  SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rank AS vector_rank, k.rank AS keyword_rank,
         coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + k.rank), 0) AS fused
  FROM vector v FULL JOIN keyword k ON v.query_id = k.query_id AND v.chunk_id = k.chunk_id))"""
SEARCH = ", ".join([CHUNKS, VECTOR, KEYWORD, FUSED])
STAGE_NAMES = ("vector", "keyword", "fused", "rerank_input", "post_rerank", "selected", "expanded")
EXPANDED = """sel AS (SELECT p.query_id, p.chunk_id, p.pick, p.relevance, c.document_id, c.chunk_index FROM picked p JOIN chunks c USING (chunk_id)),
want AS (SELECT DISTINCT query_id, document_id, chunk_index + o AS chunk_index FROM sel, (SELECT unnest([-1, 0, 1]) AS o)),
expanded AS (SELECT w.query_id, c.chunk_id, c.document_id, c.chunk_index, s.pick, s.relevance, c.token_count, c.text, c.page_number, c.section
  FROM want w JOIN chunks c ON c.document_id = w.document_id AND c.chunk_index = w.chunk_index LEFT JOIN sel s ON s.query_id = w.query_id AND s.chunk_id = c.chunk_id)"""
STAGES = """stages AS (SELECT query_id AS case_id, 'vector' AS stage, rank, chunk_id FROM vector UNION ALL SELECT query_id, 'keyword', rank, chunk_id FROM keyword
  UNION ALL SELECT query_id, 'fused', fused_rank, chunk_id FROM fused UNION ALL SELECT query_id, 'rerank_input', fused_rank, chunk_id FROM fused WHERE fused_rank <= 30
  UNION ALL SELECT query_id, 'post_rerank', fused_rank, chunk_id FROM fused WHERE fused_rank <= 30 UNION ALL SELECT query_id, 'selected', pick, chunk_id FROM picked
  UNION ALL SELECT query_id, 'expanded', row_number() OVER (PARTITION BY query_id ORDER BY pick ASC NULLS LAST, document_id, chunk_index), chunk_id FROM expanded),
gold AS (SELECT q.query_id AS case_id, c.chunk_id FROM q JOIN corpus c USING (document_id)),
sizes AS (SELECT case_id, count(*) AS n_gold FROM gold GROUP BY 1),
metrics AS (SELECT case_id, stage, k, CAST(hits > 0 AS DOUBLE) AS hit, hits / k AS precision, dhits / n_gold AS recall, coalesce(1 / first, 0) AS mrr,
   dcg / list_sum(list_transform(range(1, least(n_gold, k) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
  FROM (SELECT s.case_id, s.stage, k, count(*) FILTER (g.chunk_id IS NOT NULL AND rank <= k) AS hits, count(DISTINCT s.chunk_id) FILTER (g.chunk_id IS NOT NULL AND rank <= k) AS dhits,
        min(rank) FILTER (g.chunk_id IS NOT NULL AND rank <= k) AS first, coalesce(sum(1 / log2(rank + 1)) FILTER (g.chunk_id IS NOT NULL AND rank <= k), 0) AS dcg
      FROM stages s LEFT JOIN gold g ON g.case_id = s.case_id AND g.chunk_id = s.chunk_id, (SELECT unnest([1, 3, 5, 10, 20]) AS k) GROUP BY ALL) JOIN sizes USING (case_id))"""
JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS document_id, CASE event_type WHEN 'signup' THEN 'extract' WHEN 'view' THEN 'clean' WHEN 'click' THEN 'chunk' WHEN 'purchase' THEN 'embed' ELSE 'index' END AS stage,
  ['queued', 'running', 'done', 'failed'][event_id % 4 + 1] AS status, ts AS created_at, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 1 MINUTE END AS started_at,
  CASE WHEN event_id % 4 >= 2 THEN ts + INTERVAL 1 MINUTE + to_seconds(CAST(floor(value) AS BIGINT)) END AS finished_at, props AS details FROM events)"""
STAGE_NO = "list_position(['extract', 'clean', 'chunk', 'embed', 'index'], stage)"
ITEMS = "items AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS item FROM documents)"
TOC = r"""dirty AS (SELECT doc_id, list_concat(CASE doc_id % 4 WHEN 0 THEN list_transform([1, 2, 3, 4, 5], lambda i: 'Part ....... ' || (i * 10)) WHEN 1 THEN list_transform([1, 2, 3, 4, 5], lambda i: 'Part ....... ' || (60 - i * 10))
    WHEN 2 THEN list_transform([1, 2, 3], lambda i: 'Part ....... ' || (i * 10)) ELSE flatten(list_transform([1, 2, 3, 4, 5], lambda i: list_concat(['Part ....... ' || (i * 10)], list_transform(range(9), lambda j: 'filler')))) END,
    list_transform(string_split(text, chr(10)), lambda x: '  ' || x || chr(9) || chr(8203) || ' ')) AS lines FROM documents),
items AS (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS item FROM dirty),
entries AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id ORDER BY item) AS cluster FROM (
  SELECT *, CASE WHEN item - lag(item) OVER (PARTITION BY doc_id ORDER BY item) <= 5 THEN 0 ELSE 1 END AS jump FROM items WHERE regexp_matches(text, '\.{3,}\s*[0-9]+'))),
sizes AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_toc, max(n) AS longest FROM (SELECT doc_id, cluster, count(*) AS n FROM entries GROUP BY ALL) GROUP BY 1),
nums AS (SELECT doc_id, item, unnest(regexp_extract_all(text, '\.{3,}\s*([0-9]+)', 1)) AS page, generate_subscripts(regexp_extract_all(text, '\.{3,}\s*([0-9]+)', 1), 1) AS k FROM entries),
rises AS (SELECT doc_id, count(*) AS n_pages, avg(CASE WHEN before IS NOT NULL THEN CAST(CAST(page AS BIGINT) >= CAST(before AS BIGINT) AS INT) END) AS ascending
  FROM (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY item, k) AS before FROM nums) GROUP BY 1),
toc AS (SELECT doc_id, n_toc, longest, ascending, n_toc >= 5 AND longest >= 5 AND n_pages >= 2 AND ascending > 0.8 AS is_toc FROM sizes JOIN rises USING (doc_id))"""
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"


MMR = """pool AS (SELECT f.query_id, f.chunk_id, fused_rank AS position, fused AS relevance, c.embedding,
    CASE WHEN max(fused) OVER w > min(fused) OVER w THEN (fused - min(fused) OVER w) / (max(fused) OVER w - min(fused) OVER w) ELSE 1 END AS rel
  FROM fused f JOIN chunks c USING (chunk_id) WHERE fused_rank <= 30 WINDOW w AS (PARTITION BY f.query_id)),
mmr AS (
  SELECT *, CAST(0 AS DOUBLE) AS near, 0 AS pick, 0 AS step FROM pool
  UNION ALL
  SELECT query_id, chunk_id, position, relevance, embedding, rel, greatest(near, list_cosine_similarity(embedding, best)), CASE WHEN position = spot THEN step + 1 ELSE pick END, step + 1
  FROM (SELECT *, first_value(embedding) OVER v AS best, first_value(position) OVER v AS spot FROM mmr WHERE step < 8
        WINDOW v AS (PARTITION BY query_id ORDER BY pick > 0, 0.7 * rel - 0.3 * near DESC, position))),
picked AS (SELECT query_id, chunk_id, pick, relevance FROM mmr WHERE step = 8 AND pick > 0)"""


PACKED = """mem AS (SELECT e.*, CASE WHEN token_count <> 0 THEN token_count ELSE greatest(1, CAST(floor(length(text) / 4) AS INT)) END AS tokens, chunk_index - row_number() OVER (PARTITION BY query_id, document_id ORDER BY chunk_index) AS island,
    (SELECT max(relevance) FROM sel s WHERE s.query_id = e.query_id AND s.document_id = e.document_id AND abs(s.chunk_index - e.chunk_index) <= 1) AS near FROM expanded e),
runs AS (SELECT query_id, document_id, island, min(chunk_index) AS lo, max(chunk_index) AS hi, max(near) AS score, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(arg_min(tokens, chunk_index) AS BIGINT) AS first_tokens,
    (SELECT min(pick) FROM sel s WHERE s.query_id = mem.query_id AND s.document_id = mem.document_id) AS doc_first FROM mem GROUP BY query_id, document_id, island),
queue AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_first, lo, hi, document_id) AS r FROM runs),
pack AS (
  SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, false AS taken, CAST(NULL AS BIGINT) AS document_id, CAST(NULL AS INT) AS lo, CAST(NULL AS INT) AS hi, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS tokens FROM queue
  UNION ALL
  SELECT o.query_id, o.r, p.used + CASE WHEN p.used + o.tokens <= 6000 THEN o.tokens WHEN p.n = 0 THEN o.first_tokens ELSE 0 END, p.n + CASE WHEN p.used + o.tokens <= 6000 OR p.n = 0 THEN 1 ELSE 0 END,
    p.used + o.tokens <= 6000 OR p.n = 0, o.document_id, o.lo, CASE WHEN p.used + o.tokens <= 6000 THEN o.hi ELSE o.lo END, o.score, CASE WHEN p.used + o.tokens <= 6000 THEN o.tokens ELSE o.first_tokens END
  FROM pack p JOIN queue o ON o.query_id = p.query_id AND o.r = p.r + 1),
passage AS (SELECT query_id, n AS citation, document_id, lo, hi, score, tokens FROM pack WHERE taken),
body AS (SELECT p.query_id, p.citation, string_agg(CAST(c.chunk_id AS VARCHAR), ',' ORDER BY c.chunk_index) AS chunk_ids, coalesce(string_agg(c.text, chr(10) ORDER BY c.chunk_index), '') AS text, min(c.page_number) AS a, max(c.page_number) AS b,
    arg_min(c.section, c.chunk_index) FILTER (c.section <> '') AS section FROM passage p JOIN chunks c ON c.document_id = p.document_id AND c.chunk_index BETWEEN p.lo AND p.hi GROUP BY ALL)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _search(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return src.query_batch(spark, d), src.vector_chunks(spark, d)


# retrieval


@query(f"WITH {CHUNKS}, {VECTOR} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vector")
def vector_topk(spark, d):
    q, c = _search(spark, d)
    return retrieval.vector_topk(q, c, 50).withColumn("score", F.round("score", 6))


@query(f"WITH {CHUNKS}, {KEYWORD} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM keyword")
def keyword_topk(spark, d):
    q, c = _search(spark, d)
    return retrieval.keyword_topk(q, c, 50).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {SEARCH} SELECT query_id, chunk_id, vector_rank, keyword_rank, round(fused, 9) AS fused, fused_rank FROM fused")
def rrf_fusion(spark, d):
    return HybridRetriever().fused(*_search(spark, d)).select("query_id", "chunk_id", "vector_rank", "keyword_rank", F.round("fused", 9).alias("fused"), "fused_rank")


@query(
    rf"""WITH {SEARCH}, pool AS (SELECT * FROM fused WHERE fused_rank <= 30),
s AS (SELECT p.*, len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\p{{L}}\p{{N}}]+')), list_distinct(regexp_extract_all(lower(c.text), '[\p{{L}}\p{{N}}]+')))) / greatest(1, len(list_distinct(regexp_extract_all(lower(q.text), '[\p{{L}}\p{{N}}]+')))) AS rr
  FROM pool p JOIN q USING (query_id) JOIN chunks c ON c.chunk_id = p.chunk_id)
SELECT query_id, chunk_id, round(rr, 9) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, fused_rank) AS final_rank FROM s WHERE rr >= 0.25"""
)
def rerank_threshold(spark, d):
    out = HybridRetriever(RetrievalConfig(rerank_enabled=True, rerank_min_score=0.25)).reranked(*_search(spark, d))
    return out.select("query_id", "chunk_id", F.round("rerank_score", 9).alias("rerank_score"), "final_rank")


@query(f"WITH RECURSIVE {SEARCH}, {MMR} SELECT query_id, chunk_id, pick FROM picked")
def mmr_selection(spark, d):
    return HybridRetriever().selected(*_search(spark, d)).select("query_id", "chunk_id", "pick")


@query(
    f"""WITH {SEARCH}, sel AS (SELECT query_id, document_id, chunk_index FROM fused JOIN corpus USING (chunk_id) WHERE fused_rank <= 8),
want AS (SELECT DISTINCT query_id, document_id, chunk_index + o AS chunk_index FROM sel, (SELECT unnest([-1, 0, 1]) AS o) WHERE chunk_index + o >= 0)
SELECT w.query_id, c.chunk_id, c.document_id, c.chunk_index FROM want w JOIN corpus c ON c.document_id = w.document_id AND c.chunk_index = w.chunk_index
WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.query_id = w.query_id AND s.document_id = w.document_id AND s.chunk_index = w.chunk_index)"""
)
def neighbour_chunks(spark, d):
    q, c = _search(spark, d)
    sel = HybridRetriever().fused(q, c).filter("fused_rank <= 8").join(c.select("chunk_id", "document_id", "chunk_index"), "chunk_id")
    return retrieval.neighbours(sel, c.select("chunk_id", "document_id", "chunk_index"), 1)


@query(
    f"""WITH {SEARCH}, sel AS (SELECT query_id, chunk_id, document_id, chunk_index, fused AS relevance, fused_rank AS o FROM fused JOIN corpus USING (chunk_id) WHERE fused_rank <= 8),
want AS (SELECT DISTINCT query_id, document_id, chunk_index + w AS chunk_index FROM sel, (SELECT unnest([-1, 0, 1]) AS w)),
m AS (SELECT w.query_id, c.document_id, c.chunk_index, c.chunk_id, c.token_count AS tokens FROM want w JOIN corpus c ON c.document_id = w.document_id AND c.chunk_index = w.chunk_index),
g AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY query_id, document_id ORDER BY chunk_index) AS island FROM m),
s AS (SELECT g.*, (SELECT max(relevance) FROM sel WHERE sel.query_id = g.query_id AND sel.document_id = g.document_id AND abs(sel.chunk_index - g.chunk_index) <= 1) AS near FROM g)
SELECT query_id, document_id, min(chunk_index) AS lo, max(chunk_index) AS hi, round(max(near), 9) AS score, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_chunks FROM s GROUP BY query_id, document_id, island"""
)
def passage_runs(spark, d):
    q, c = _search(spark, d)
    light = c.select("chunk_id", "document_id", "chunk_index", "page_number", "section", F.col("token_count").alias("tokens"))
    sel = HybridRetriever().fused(q, c).filter("fused_rank <= 8").join(light, "chunk_id")
    sel = sel.select("query_id", "document_id", "chunk_index", "chunk_id", "tokens", "page_number", "section", F.col("fused").alias("relevance"), F.col("fused_rank").alias("order"))
    near = retrieval.neighbours(sel, light, 1).select("query_id", "document_id", "chunk_index", "chunk_id", "tokens", "page_number", "section", F.lit(None).cast("double").alias("relevance"), F.lit(None).cast("int").alias("order"))
    out = passages.runs(sel.unionByName(near), 1)
    return out.select("query_id", "document_id", "lo", "hi", F.round("score", 9).alias("score"), "tokens", F.size("chunks").cast("bigint").alias("n_chunks"))


@query(f"WITH RECURSIVE {SEARCH}, {MMR}, {EXPANDED}, {PACKED} SELECT query_id, CAST(citation AS INT) AS citation, document_id, lo, hi, round(score, 9) AS score, tokens, chunk_ids FROM passage JOIN body USING (query_id, citation)")
def budgeted_passages(spark, d):
    q, c = _search(spark, d)
    r = HybridRetriever()
    return r.passages(r.selected(q, c), c).select("query_id", "citation", "document_id", "lo", "hi", F.round("score", 9).alias("score"), "tokens", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query(
    f"""WITH RECURSIVE {SEARCH}, {MMR}, {EXPANDED}, {PACKED}
SELECT query_id, string_agg('[' || citation || ']' || coalesce(' ' || section, '') || ' (' || CASE WHEN a IS NULL THEN 'n/a' WHEN a = b THEN 'p.' || a ELSE 'pp.' || a || '-' || b END || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY citation) AS context FROM body GROUP BY 1"""
)
def retrieve_context(spark, d):
    return HybridRetriever().retrieve(*_search(spark, d))


@query(
    f"""WITH {DOCS}, r AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'src0' ELSE user_id END AS user_id FROM docs)
SELECT r.user_id, r.document_id, CASE WHEN d.status IS NULL THEN 'not_found' WHEN d.status <> 'indexed' THEN 'not_ready' ELSE 'ok' END AS verdict
FROM r LEFT JOIN docs d ON d.document_id = r.document_id AND d.user_id = r.user_id"""
)
def scope_verdicts(spark, d):
    docs = src.documents(spark, d)
    asked = docs.select("document_id", F.when(F.col("document_id") % 3 == 0, "src0").otherwise(F.col("user_id")).alias("user_id"))
    return retrieval.validate_scope(asked, docs)


@query(f"WITH {DOCS} SELECT user_id, count(*) AS n, sum(size_bytes)::BIGINT AS n_bytes FROM docs WHERE status = 'indexed' AND document_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def scoped_documents(spark, d):
    docs = src.documents(spark, d)
    return retrieval.scope(docs, docs).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("n_bytes"))


@query(f"WITH RECURSIVE {SEARCH}, {MMR}, {EXPANDED}, {STAGES} SELECT query_id, {', '.join(f'(SELECT count(*) FROM stages s WHERE s.case_id = q.query_id AND stage = {chr(39)}{x}{chr(39)}) AS n_{x}' for x in STAGE_NAMES)} FROM q")
def stage_counts(spark, d):
    s = HybridRetriever().stages(*_search(spark, d)).groupBy("case_id").pivot("stage", list(STAGE_NAMES)).count()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return s.select(F.col("case_id").alias("query_id"), *[zero(x).alias(f"n_{x}") for x in STAGE_NAMES])


@query("SELECT lexeme, count(*) AS n_documents, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, lexeme, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS lexeme FROM documents) GROUP BY ALL) GROUP BY 1")
def posting_totals(spark, d):
    chunks = src.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.postings(chunks).groupBy("lexeme").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("tf").alias("n"))


# evaluation


@query(f"WITH RECURSIVE {SEARCH}, {MMR}, {EXPANDED}, {STAGES} SELECT case_id, stage, k, hit, round(precision, 9) AS precision, round(recall, 9) AS recall, round(mrr, 9) AS mrr, round(ndcg, 9) AS ndcg FROM metrics")
def rank_metrics(spark, d):
    m = metrics.rank_metrics(HybridRetriever().stages(*_search(spark, d)), src.gold(spark, d))
    return m.select("case_id", "stage", "k", "hit", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "mrr", "ndcg")])


@query(f"WITH RECURSIVE {SEARCH}, {MMR}, {EXPANDED}, {STAGES}, long AS (SELECT * FROM (SELECT stage, k, unnest(['hit', 'precision', 'recall', 'mrr', 'ndcg']) AS metric, unnest([hit, precision, recall, mrr, ndcg]) AS value FROM metrics)) SELECT stage, metric, k, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value), 4) AS least, round(max(value), 4) AS most, count(*) AS n FROM long GROUP BY ALL")
def metric_summary(spark, d):
    return metrics.aggregate_metrics(metrics.rank_metrics(HybridRetriever().stages(*_search(spark, d)), src.gold(spark, d)))


@query(f"WITH RECURSIVE {SEARCH}, {MMR}, {EXPANDED}, {STAGES}, means AS (SELECT stage, k, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM metrics GROUP BY ALL) SELECT m.metric, v.k, round(m.f - m.v, 4) AS lift FROM means v JOIN means f ON f.k = v.k, LATERAL (SELECT unnest(['hit', 'recall', 'mrr']) AS metric, unnest([v.hit, v.recall, v.mrr]) AS v, unnest([f.hit, f.recall, f.mrr]) AS f) m WHERE v.stage = 'vector' AND f.stage = 'fused'")
def fusion_lift(spark, d):
    m = metrics.aggregate_metrics(metrics.rank_metrics(HybridRetriever().stages(*_search(spark, d)), src.gold(spark, d)))
    return metrics.lift(m.filter(F.col("metric").isin("hit", "recall", "mrr")), "vector", "fused")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(avg(value), 1) AS mean, round(median(value), 1) AS p50, round(max(value) FILTER (i = floor(n * 0.95)), 1) AS p95, round(max(value), 1) AS most, count(*) AS n FROM r GROUP BY 1")
def latency_stats(spark, d):
    return metrics.latency_stats(src.table(spark, d, "events"), "event_type", "value")


@query(
    r"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(b.text), '[^ \t\n\r]+')) AS x, list_distinct(regexp_extract_all(lower(a.text), '[^ \t\n\r]+')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN len(list_intersect(x, y)) = 0 THEN 0 ELSE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) END, 9) AS f1 FROM p"""
)
def answer_f1(spark, d):
    m = src.messages(spark, d)
    answers = m.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return metrics.token_f1(m.join(answers, ["conv_id", "turn"]), "answer", "text").select("conv_id", "turn", F.round("f1", 9).alias("f1"))


# ingestion


@query(f"WITH {TOC} SELECT doc_id, item, {CLEAN.format(x='text')} AS clean, {CLEAN.format(x='text')} <> text AS changed, {CLEAN.format(x='text')} = '' AS empty FROM items")
def cleaned_items(spark, d):
    return ingest.clean_items(src.toc_items(spark, d)).select("doc_id", "item", "clean", "changed", "empty")


@query(f"WITH {TOC} SELECT doc_id, n_toc, longest, round(ascending, 9) AS ascending, is_toc FROM toc")
def toc_documents(spark, d):
    return ingest.toc_documents(src.toc_items(spark, d)).withColumn("ascending", F.round("ascending", 9))


@query(rf"WITH {TOC} SELECT doc_id, count(*) AS n FROM items i WHERE NOT (regexp_matches(text, '\.{{3,}}\s*[0-9]+') AND doc_id IN (SELECT doc_id FROM toc WHERE is_toc)) GROUP BY 1")
def pruned_items(spark, d):
    return ingest.prune_toc(src.toc_items(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    rf"""WITH {TOC}, c AS (SELECT doc_id, text, {CLEAN.format(x='text')} AS clean FROM items)
SELECT c.doc_id, count(*) - (CASE WHEN any_value(is_toc) THEN count(*) FILTER (regexp_matches(clean, '\.{{3,}}\s*[0-9]+')) ELSE 0 END) AS text_items, count(*) FILTER (clean <> text) AS changed, count(*) FILTER (clean = '') AS empty,
  coalesce(any_value(is_toc), false) AS toc_detected, count(*) FILTER (regexp_matches(clean, '\.{{3,}}\s*[0-9]+')) AS toc_items_found, CASE WHEN any_value(is_toc) THEN count(*) FILTER (regexp_matches(clean, '\.{{3,}}\s*[0-9]+')) ELSE 0 END AS pruned
FROM c LEFT JOIN toc ON toc.doc_id = c.doc_id GROUP BY c.doc_id"""
)
def cleaning_stats(spark, d):
    return ingest.cleaning_stats(src.toc_items(spark, d))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 64) / 56) AS BIGINT)) + 1)) AS piece FROM w WHERE len(w) > 0)
SELECT doc_id, piece, CAST(len(w[piece * 56 + 1 : piece * 56 + 64]) AS BIGINT) AS n_tokens, array_to_string(w[piece * 56 + 1 : piece * 56 + 64], ' ') AS text FROM s"""
)
def token_windows(spark, d):
    w = ingest.token_windows(src.table(spark, d, "documents"))
    return w.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.col("n_tokens").cast("bigint").alias("n_tokens"), "text")


STAGE_CONFIGS = {"extract": "parser=1", "clean": "rules=1", "chunk": "limit=64,overlap=8", "embed": "dim=64"}
_PRINTS = [f"left(sha256('|{STAGE_CONFIGS['extract']}'), 16)"]
for _config in list(STAGE_CONFIGS.values())[1:]:
    _PRINTS.append(f"left(sha256({_PRINTS[-1]} || '|{_config}'), 16)")


@query(
    f"""WITH {DOCS}, f AS (SELECT unnest({list(STAGE_CONFIGS)[1:]}) AS stage, unnest([{', '.join(_PRINTS[1:])}]) AS fp)
SELECT document_id, stage, '_pipeline/cache/' || fp || '/' || content_hash || '/' || stage || '.json.gz' AS key FROM docs, f"""
)
def artifact_keys(spark, d):
    return ingest.artifact_keys(src.documents(spark, d), STAGE_CONFIGS, "clean")


@query(
    f"""WITH {DOCS}, stored AS (SELECT * FROM docs WHERE document_id % 2 = 0), up AS (SELECT document_id AS upload_id, user_id, content_hash FROM docs WHERE document_id % 2 = 1)
SELECT upload_id, user_id, CASE WHEN s.id IS NOT NULL THEN 'existing' WHEN upload_id <> f.id THEN 'duplicate' ELSE 'new' END AS verdict, coalesce(s.id, f.id) AS document
FROM up LEFT JOIN (SELECT user_id, content_hash, min(document_id) AS id FROM stored GROUP BY ALL) s USING (user_id, content_hash) JOIN (SELECT user_id, content_hash, min(upload_id) AS id FROM up GROUP BY ALL) f USING (user_id, content_hash)"""
)
def upload_verdicts(spark, d):
    docs = src.documents(spark, d).drop("text")
    uploads = docs.filter("document_id % 2 = 1").select(F.col("document_id").alias("upload_id"), "user_id", "content_hash")
    return ingest.upload_verdicts(uploads, docs.filter("document_id % 2 = 0"))


@query("SELECT source, page_name, CASE WHEN starts_with(lower(left(ltrim(body), 64)), '<!doctype html') OR starts_with(lower(left(ltrim(body), 64)), '<html') THEN 'text/html' WHEN page_name LIKE '%.md' THEN 'text/markdown' WHEN page_name LIKE '%.csv' THEN 'text/csv' ELSE 'text/plain' END AS mime FROM (SELECT 'pages' AS source, page_id || '.html' AS page_name, html AS body FROM pages UNION ALL SELECT 'documents', doc_id || ['.md', '.csv', '.txt'][doc_id % 3 + 1], text FROM documents)")
def mime_types(spark, d):
    pages = src.table(spark, d, "pages").select(F.lit("pages").alias("source"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("page_name"), F.col("html").alias("body"))
    ending = F.element_at(F.array(F.lit(".md"), F.lit(".csv"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = src.table(spark, d, "documents").select(F.lit("documents").alias("source"), F.concat(F.col("doc_id").cast("string"), ending).alias("page_name"), F.col("text").alias("body"))
    return pages.unionByName(docs).select("source", "page_name", ingest.sniff_mime(F.col("body"), F.col("page_name")).alias("mime"))


@query(r"SELECT doc_id, translate(left(text, 180), chr(10), ' ') AS preview, greatest(1, CAST(floor(length(text) / 4) AS INT)) AS estimate FROM documents")
def previews(spark, d):
    t = F.col("text")
    return src.table(spark, d, "documents").select("doc_id", tx.preview(t, 180).alias("preview"), tx.token_estimate(F.lit(0), t).alias("estimate"))


# jobs


@query(
    f"""WITH {DOCS}, {JOBS}, r AS (SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'extract' END AS asked FROM jobs UNION ALL SELECT -1, 'extract')
SELECT r.job_id, v.verdict, CASE WHEN v.verdict = 'started' THEN 'running' ELSE j.status END AS job_status, CASE WHEN v.verdict = 'started' THEN 'processing' ELSE d.status END AS doc_status
FROM r LEFT JOIN jobs j USING (job_id) LEFT JOIN docs d ON d.document_id = j.document_id, LATERAL (SELECT CASE WHEN j.stage IS NULL THEN 'job_missing' WHEN r.asked <> j.stage THEN 'stage_mismatch' WHEN j.status = 'done' THEN 'already_done'
  WHEN j.status = 'failed' THEN 'already_failed' WHEN d.status IS NULL THEN 'document_missing' WHEN d.status NOT IN ('pending', 'processing') THEN 'document_closed' ELSE 'started' END AS verdict) v"""
)
def start_stage(spark, d):
    jobs = src.jobs(spark, d)
    asked = jobs.select("job_id", F.when(F.col("job_id") % 5 == 0, "extract").alias("stage")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("job_id"), F.lit("extract").alias("stage")))
    return job_ops.start_stage(asked, jobs, src.documents(spark, d))


@query(
    f"""WITH {DOCS}, {JOBS}, x AS (SELECT j.job_id, j.stage, {STAGE_NO} AS i, d.status AS doc_before, CASE WHEN j.status = 'done' THEN 'already_done' WHEN j.status <> 'running' THEN 'not_running' WHEN d.status IS NULL THEN 'document_missing' WHEN d.status <> 'processing' THEN 'document_closed' ELSE 'completed' END AS verdict
  FROM jobs j LEFT JOIN docs d ON d.document_id = j.document_id)
SELECT job_id, verdict, CASE WHEN verdict = 'completed' THEN ['extract', 'clean', 'chunk', 'embed', 'index'][i + 1] END AS next_stage, CASE WHEN verdict = 'completed' AND i = 5 THEN 'indexed' ELSE doc_before END AS doc_status FROM x"""
)
def complete_stage(spark, d):
    return job_ops.complete_stage(src.jobs(spark, d), src.documents(spark, d))


@query(f"WITH {DOCS}, {JOBS} SELECT job_id, CASE WHEN j.status IN ('queued', 'running') THEN 'failed' ELSE j.status END AS job_status, CASE WHEN j.status IN ('queued', 'running') AND d.status IN ('pending', 'processing') THEN 'failed' ELSE d.status END AS doc_status, CASE WHEN j.status IN ('queued', 'running') THEN 'lost' END AS error FROM jobs j LEFT JOIN docs d ON d.document_id = j.document_id")
def fail_stage(spark, d):
    return job_ops.fail_stage(src.jobs(spark, d), src.documents(spark, d), "lost")


LATEST = "latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id, stage ORDER BY created_at DESC, job_id DESC) = 1)"


@query(f"WITH {JOBS}, {LATEST} SELECT document_id, stage, job_id, status FROM latest")
def latest_by_stage(spark, d):
    return job_ops.latest_by_stage(src.jobs(spark, d)).select("document_id", "stage", "job_id", "status")


@query(f"WITH {JOBS} SELECT document_id, job_id, stage, epoch_us(finished_at) AS finished_us FROM jobs WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY finished_at DESC, job_id DESC) = 1")
def last_completed(spark, d):
    return job_ops.last_completed(src.jobs(spark, d)).select("document_id", "job_id", "stage", F.unix_micros("finished_at").alias("finished_us"))


@query(
    f"""WITH {DOCS}, {JOBS}, {LATEST}, x AS (SELECT docs.document_id, docs.status AS doc_status, s.stage, s.i, coalesce(l.status, 'queued') AS status, floor((epoch_us(finished_at) - epoch_us(started_at)) / 1000) AS ms
  FROM docs, (SELECT unnest(['extract', 'clean', 'chunk', 'embed', 'index']) AS stage, unnest([1, 2, 3, 4, 5]) AS i) s LEFT JOIN latest l ON l.document_id = docs.document_id AND l.stage = s.stage)
SELECT document_id, doc_status AS status, round(count(*) FILTER (status = 'done') / 5, 2) AS progress, CASE WHEN doc_status <> 'failed' THEN coalesce(arg_min(stage, i) FILTER (status = 'running'), arg_min(stage, i) FILTER (status <> 'done')) END AS current_stage,
  count(*) FILTER (status = 'done') AS stages_done, CAST(sum(ms) AS BIGINT) AS duration_ms FROM x GROUP BY document_id, doc_status"""
)
def document_state(spark, d):
    return job_ops.document_state(src.documents(spark, d), src.jobs(spark, d))


NOW = f"TIMESTAMP '{src.NOW}'"
STUCK = f"stuck AS (SELECT * FROM jobs WHERE (status = 'queued' AND created_at < {NOW} - INTERVAL 20 MINUTE) OR (status = 'running' AND started_at < {NOW} - INTERVAL 180 MINUTE))"


@query(f"WITH {JOBS}, {STUCK} SELECT job_id, document_id, stage, CASE WHEN status = 'running' OR coalesce(started_at, created_at) < {NOW} - INTERVAL 12 HOUR THEN 'fail' ELSE 'requeue' END AS action, CASE WHEN status = 'running' THEN 'stalled while running' WHEN created_at < {NOW} - INTERVAL 12 HOUR THEN 'not picked up in time' END AS reason FROM stuck")
def pipeline_sweep(spark, d):
    return job_ops.sweep(src.jobs(spark, d), src.NOW)


@query(f"WITH {DOCS}, {JOBS} SELECT document_id, user_id FROM docs WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = docs.document_id AND j.status IN ('queued', 'running'))")
def pending_without_job(spark, d):
    return job_ops.pending_without_job(src.documents(spark, d), src.jobs(spark, d)).select("document_id", "user_id")


@query(f"WITH {DOCS}, {JOBS} SELECT document_id, epoch_us(finished_at) AS indexed_us, coalesce(CAST(json_extract_string(details, '$.k') AS BIGINT), 0) AS chunk_count FROM docs JOIN (SELECT * FROM jobs WHERE status = 'done' AND stage = 'index' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY finished_at DESC, job_id DESC) = 1) j USING (document_id) WHERE docs.status = 'processing'")
def reconcile(spark, d):
    return job_ops.reconcile(src.documents(spark, d), src.jobs(spark, d)).select("document_id", F.unix_micros("indexed_at").alias("indexed_us"), "chunk_count")


@query(
    f"""WITH {DOCS}, o AS (SELECT event_id AS id, 'objects/' || event_id AS key, CASE WHEN event_id % 11 <> 0 THEN ts END AS mtime FROM events), live AS (SELECT 'objects/' || document_id AS key FROM docs WHERE document_id % 3 <> 0),
x AS (SELECT o.key, mtime, live.key IS NOT NULL AS is_live, mtime IS NULL OR mtime > {NOW} - INTERVAL 2 HOUR AS young FROM o LEFT JOIN live ON live.key = o.key)
SELECT key, CASE WHEN is_live THEN 'keep_live' WHEN young THEN 'keep_young' WHEN row_number() OVER (PARTITION BY is_live OR young ORDER BY mtime, key) <= 1000 THEN 'delete' ELSE 'later' END AS action FROM x"""
)
def orphan_sweep(spark, d):
    objects = src.table(spark, d, "events").select(F.concat(F.lit("objects/"), F.col("event_id").cast("string")).alias("key"), F.when(F.col("event_id") % 11 != 0, F.col("ts").cast("timestamp")).alias("mtime"))
    live = src.documents(spark, d).filter("document_id % 3 != 0").select(F.concat(F.lit("objects/"), F.col("document_id").cast("string")).alias("key"))
    return job_ops.sweep_orphans(objects, live, src.NOW)


@query(f"WITH {JOBS} SELECT job_id, tries, CAST(least(5 * pow(2, tries), 300) AS BIGINT) AS delay_s FROM (SELECT job_id, job_id % 8 AS tries FROM jobs WHERE status = 'failed')")
def retry_delays(spark, d):
    tries = F.col("job_id") % 8
    return src.jobs(spark, d).filter("status = 'failed'").select("job_id", tries.alias("tries"), F.least(5 * F.pow(F.lit(2), tries), F.lit(300.0)).cast("bigint").alias("delay_s"))


# read patterns


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100 OFFSET 40")
def document_page(spark, d):
    return relational.page(src.table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], 40, 100)


@query(f"WITH {DOCS} SELECT user_id, document_id, count(*) OVER (PARTITION BY user_id) AS total FROM docs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY document_id DESC) BETWEEN 6 AND 15")
def owner_pages(spark, d):
    docs = src.documents(spark, d).select("user_id", "document_id")
    return relational.page_with_total(docs, ["user_id"], [F.desc("document_id")], 5, 10).select("user_id", "document_id", "total")


@query(f"WITH {DOCS}, {JOBS} SELECT document_id, count(job_id) AS n FROM docs LEFT JOIN jobs USING (document_id) GROUP BY 1")
def jobs_per_document(spark, d):
    return relational.count_children(src.documents(spark, d), src.jobs(spark, d), "document_id")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_messages(spark, d):
    return relational.last_n(src.messages(spark, d).select("conv_id", "turn", "role"), "conv_id", "turn", 3)


@query(f"WITH {DOCS} SELECT user_id, count(*) AS n_documents, CAST(sum(size_bytes) AS BIGINT) AS n_bytes, count(*) >= 50 OR sum(size_bytes) > 120000 AS \"over\" FROM docs GROUP BY 1")
def quota(spark, d):
    return relational.quota(src.documents(spark, d), 50, 120_000)


@query(f"WITH {DOCS}, {JOBS} SELECT count(*) AS n_jobs, count(DISTINCT document_id) AS n_documents FROM jobs WHERE document_id NOT IN (SELECT document_id FROM docs WHERE user_id = 'src0')")
def cascade_delete(spark, d):
    docs = src.documents(spark, d).filter("user_id = 'src0'")
    (left,) = relational.delete_cascade(docs, "document_id", src.jobs(spark, d))
    return left.agg(F.count(F.lit(1)).alias("n_jobs"), F.count_distinct("document_id").alias("n_documents"))


@query("SELECT source, doc_id, CAST(hits AS INT) AS hits FROM (SELECT source, doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(contains(lower(text), 'und') AS INT) AS hits FROM documents) WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) <= 5")
def draft_gold(spark, d):
    c = src.table(spark, d, "documents").select("source", "doc_id", "text", F.col("doc_id").alias("chunk_index"))
    return relational.keyword_candidates(c, ["the", "Que", "und"], "source").select("source", "doc_id", F.col("hits").cast("int").alias("hits"))


@query("SELECT doc_id, quality FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 50")
def review_queue(spark, d):
    return relational.page(src.table(spark, d, "labels").filter("toxic = 1").select("doc_id", "quality"), ["doc_id"], 0, 50)


@query(f"WITH {DOCS} SELECT user_id, content_hash, count(*) AS copies, min(document_id) AS first FROM docs GROUP BY ALL HAVING count(*) > 1")
def repeated_content(spark, d):
    g = src.documents(spark, d).groupBy("user_id", "content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min("document_id").alias("first"))
    return g.filter("copies > 1")


@query(f"WITH {DOCS} SELECT status, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS n_bytes FROM docs GROUP BY 1")
def status_totals(spark, d):
    return src.documents(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("n_bytes"))
