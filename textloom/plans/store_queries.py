"""Registered queries on artifacts, listings, sinks, cascades, merged JSON and types of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import json as tj
from textloom.functions import mime
from textloom.operators import cascade as deletes
from textloom.operators import evaluation, ingest, metrics, retrieval, sinks, stages, updates
from textloom.operators import jobs as job_ops
from textloom.sources import artifacts
from textloom.sources import tables as src
from textloom.sources.shared import new_path, stored

from .hybrid import HybridRetriever
from .more_queries import HERE, LONG
from .queries import _PRINTS, DOCS, JOBS, NOW, SQL, STAGE_CONFIGS, query

KEYS = f"""{DOCS}, keyed AS (SELECT document_id, '_pipeline/cache/' || {_PRINTS[2]} || '/' || content_hash || '/chunk.json.gz' AS key FROM docs WHERE regexp_matches(text, '[^ \\t\\n\\r]'))"""


def _chunk_keys(spark, d):
    """document_id, content_hash, key of the chunk artifact of each document."""
    docs = src.documents(spark, d)
    keys = ingest.artifact_keys(docs, STAGE_CONFIGS).filter("stage = 'chunk'")
    return docs.select("document_id", "content_hash").join(keys.select("document_id", "key"), "document_id")


def _write_chunks(spark, d):
    """A folder with the chunk artifact of each different text."""
    keys = _chunk_keys(spark, d)
    first = keys.groupBy("key").agg(F.min("document_id").alias("doc_id"))
    texts = src.table(spark, d, "documents").join(first, "doc_id").select("doc_id", "text", "key")
    pieces = ingest.token_windows(texts.select("doc_id", "text")).join(first, "doc_id")
    chunks = pieces.select("key", F.col("piece").cast("bigint").alias("chunk_index"), "text", F.col("n_tokens").cast("bigint").alias("token_count"))
    folder = new_path(spark)
    artifacts.write_artifacts(artifacts.chunk_artifacts(chunks), folder)
    return folder


@query(SQL["token_windows"])
def artifact_chunks(spark, d):
    """Chunks of each document, out of the artifact of its content."""
    loaded = artifacts.load_chunks(spark, _write_chunks(spark, d))
    out = _chunk_keys(spark, d).join(loaded, "key")
    return out.select(F.col("document_id").alias("doc_id"), F.col("chunk_index").alias("piece"), F.col("token_count").alias("n_tokens"), "text")


@query(f"WITH {KEYS} SELECT DISTINCT key, true AS filled, true AS timed FROM keyed")
def object_listing(spark, d):
    listed = artifacts.list_objects(spark, _write_chunks(spark, d))
    return listed.select("key", (F.col("size") > 20).alias("filled"), (F.col("mtime") > F.lit("2020-01-01").cast("timestamp")).alias("timed"))


@query(f"WITH {KEYS}, live AS (SELECT key FROM keyed WHERE document_id % 3 <> 0) SELECT DISTINCT key, CASE WHEN key IN (SELECT key FROM live) THEN 'keep_live' ELSE 'delete' END AS action FROM keyed")
def listed_sweep(spark, d):
    """The orphan sweep over a real listing, long after the grace period."""
    listed = artifacts.list_objects(spark, _write_chunks(spark, d))
    live = _chunk_keys(spark, d).filter("document_id % 3 != 0").select("key")
    return job_ops.sweep_orphans(listed, live, "2200-01-01 00:00:00", most=2**31 - 1)


def _windows(spark, d, every, limit):
    texts = src.table(spark, d, "documents").filter(F.col("doc_id") % every == 0)
    return ingest.token_windows(texts, limit, 8).select(F.col("doc_id").alias("document_id"), F.col("piece").cast("bigint").alias("chunk_index"), "text")


_PIECES = "greatest(0, CAST(ceil((n - {0}) / ({0} - 8)) AS BIGINT)) + 1"


@query(
    rf"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n FROM documents), c AS (SELECT doc_id AS document_id, {_PIECES.format(64)} AS old, {_PIECES.format(32)} AS fresh FROM w WHERE n > 0)
SELECT document_id, CASE WHEN document_id % 3 = 0 THEN CASE WHEN document_id % 2 = 0 THEN old ELSE 0 END END AS n_deleted, CASE WHEN document_id % 3 = 0 THEN fresh END AS n_inserted,
  CASE WHEN document_id % 3 = 0 THEN fresh END AS again, CASE WHEN document_id % 3 = 0 THEN fresh ELSE old END AS n_rows FROM c WHERE document_id % 2 = 0 OR document_id % 3 = 0"""
)
def replaced_chunks(spark, d):
    """A chunk table in which every third document's chunks are replaced, twice; counts of both times and of the table's rows."""
    path, fresh = new_path(spark), _windows(spark, d, 3, 32)
    sinks.insert_documents(_windows(spark, d, 2, 64), path)
    sinks.replace_documents(fresh.limit(0), path)
    first, again = sinks.replace_documents(fresh, path), sinks.replace_documents(fresh, path)
    rows = sinks.read_table(spark, path, "document_id bigint, chunk_index bigint, text string").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_rows"))
    again = again.filter("n_deleted = n_inserted").select("document_id", F.col("n_inserted").alias("again"))
    return rows.join(first, "document_id", "left_outer").join(again, "document_id", "left_outer")


@query(
    """WITH m AS (SELECT event_id, json_merge_patch(CAST(props AS JSON), CAST('{"of":[1,2.5,"x"],"event":' || event_id || CASE WHEN event_id % 2 = 0 THEN ',"k":"text"' ELSE '' END || '}' AS JSON)) AS m, props FROM events)
SELECT event_id, json_extract_string(m, '$.k') AS k, json_type(m, '$.k') <> 'VARCHAR' AS k_is_number, json_extract_string(m, '$.event') AS event, CAST(json_extract(m, '$.of') AS VARCHAR) AS nested, len(json_keys(m)) AS n_keys,
  CASE event_id % 4 WHEN 0 THEN 'object' WHEN 1 THEN 'bad' WHEN 2 THEN 'value' ELSE 'absent' END AS kind, event_id % 4 IN (1, 2) AS unmerged FROM m"""
)
def merged_props(spark, d):
    """Props of events merged with another object, types kept; and texts that can't be merged."""
    x = src.table(spark, d, "events").select("event_id", "props")
    more = F.concat(F.lit('{"of":[1,2.5,"x"],"event":'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ',"k":"text"').otherwise(""), F.lit("}"))
    odd = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("["), "props", F.lit("]")))
    m = x.select("event_id", tj.merged_json(F.col("props"), more).alias("m"), odd.alias("odd"), more.alias("more"))
    get = lambda path: F.get_json_object("m", path)
    return m.select("event_id", get("$.k").alias("k"), F.contains("m", F.concat(F.lit('"k":'), get("$.k"))).alias("k_is_number"), get("$.event").alias("event"), get("$.of").alias("nested"), F.size(tj.fields_of(F.col("m"))).cast("bigint").alias("n_keys"), tj.json_kind(F.col("odd")).alias("kind"), tj.merged_json(F.col("odd"), F.col("more")).isNull().alias("unmerged"))


_TREE = f"""{DOCS}, {JOBS}, gone_docs AS (SELECT document_id FROM docs WHERE user_id = (SELECT min(user_id) FROM docs) OR document_id % 10 = 7),
gone_chunks AS (SELECT vec_id FROM embeddings WHERE vec_id // 8 IN (SELECT document_id FROM gone_docs)), gone_jobs AS (SELECT job_id FROM jobs WHERE document_id IN (SELECT document_id FROM gone_docs))"""


def _cascaded(spark, d):
    docs = src.documents(spark, d).select("document_id", "user_id")
    chunks = src.vector_chunks(spark, d).select("chunk_id", "document_id")
    tables = {"chunks": chunks, "documents": docs, "users": docs.select("user_id").distinct(), "jobs": src.jobs(spark, d).select("job_id", "document_id")}
    gone = {"users": docs.agg(F.min("user_id").alias("user_id")), "documents": docs.filter("document_id % 10 = 7").select("document_id")}
    return deletes.cascade(tables, deletes.SCHEMA_KEYS, gone)


@query(f"WITH {_TREE} SELECT 'users' AS \"table\", CASE WHEN (SELECT min(user_id) FROM docs) IS NULL THEN 0 ELSE 1 END AS n_deleted UNION ALL SELECT 'documents', count(*) FROM gone_docs UNION ALL SELECT 'chunks', count(*) FROM gone_chunks UNION ALL SELECT 'jobs', count(*) FROM gone_jobs")
def cascade_counts(spark, d):
    """Rows deleted in each table with one owner and every tenth document: owner, documents, chunks and jobs."""
    return _cascaded(spark, d)[1]


@query(f"WITH {_TREE} SELECT 'chunks' AS kind, vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM gone_chunks) UNION ALL SELECT 'jobs', job_id FROM jobs WHERE job_id NOT IN (SELECT job_id FROM gone_jobs)")
def cascade_rest(spark, d):
    left = _cascaded(spark, d)[0]
    return left["chunks"].select(F.lit("chunks").alias("kind"), F.col("chunk_id").alias("id")).unionByName(left["jobs"].select(F.lit("jobs").alias("kind"), F.col("job_id").alias("id")))


_HEADS = [*(x for x, _ in mime.SIGNATURES), *(mime.ZIP + x for x, _ in mime.MEMBERS), mime.ZIP, b"", b"\x00", b" <!DOCTYPE html>", b"<?xml?>"]
_ENDS = ["a.md", "a.html", "a.txt", "a", "b.pdf"]
_NAMED = [*(f"('{x.hex().upper()}', '{m}')" for x, m in mime.SIGNATURES), *(f"('{(mime.ZIP + x).hex().upper()}', '{m}')" for x, m in mime.MEMBERS), f"('{mime.ZIP.hex().upper()}', 'application/zip')", "('00', 'application/octet-stream')", f"('{b' <!DOCTYPE html>'.hex().upper()}', 'text/html')", f"('{b'<?xml?>'.hex().upper()}', 'text/html')"]


@query(
    rf"""WITH named AS (SELECT * FROM (VALUES {", ".join(_NAMED)}) AS v(head, mime)), f AS (SELECT doc_id, text, {[x.hex().upper() for x in _HEADS]}[doc_id % {len(_HEADS)} + 1] AS head, {_ENDS}[doc_id % {len(_ENDS)} + 1] AS name FROM documents WHERE text IS NOT NULL),
plain AS (SELECT doc_id, name, text, TRY(decode(encode(text)[1:4096])) AS cut FROM f WHERE head = ''),
told AS (SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN cut IS NULL OR contains(cut, chr(0)) OR length(regexp_replace(cut, '[^\x00-\x08\x0B\x0E-\x1F]', '', 'g')) >= 0.05 * length(cut) THEN 'application/octet-stream'
  WHEN regexp_matches(lower(ltrim(cut, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '^(<!doctype html|<html|<head|<body|<\?xml)') THEN 'text/html' WHEN ends_with(name, '.md') THEN 'text/markdown' WHEN ends_with(name, '.html') THEN 'text/html' ELSE 'text/plain' END AS mime FROM plain
  UNION ALL SELECT doc_id, named.mime FROM f JOIN named USING (head))
SELECT doc_id, mime, coalesce(mime IN {mime.ALLOWED}, false) AS accepted FROM told"""
)
def file_types(spark, d):
    """Types of files made of each signature and a document's bytes."""
    heads = F.array(*(F.lit(bytearray(x)) for x in _HEADS))
    ends = F.array(*map(F.lit, _ENDS))
    x = src.table(spark, d, "documents").filter("text is not null")
    at = lambda of, n: F.element_at(of, (F.col("doc_id") % n + 1).cast("int"))
    files = x.select("doc_id", F.concat(at(heads, len(_HEADS)), F.encode("text", "utf-8")).alias("content"), at(ends, len(_ENDS)).alias("name"))
    found = files.select("doc_id", mime.detect_mime(F.col("content"), F.col("name")).alias("mime"))
    return found.withColumn("accepted", mime.accepted(F.col("mime")))


@query(f"WITH {DOCS} SELECT document_id, user_id, CASE WHEN document_id % 4 = 0 THEN 'title 2' WHEN document_id % 4 = 1 THEN 'title 1' ELSE 'old' END AS title, document_id % 4 < 1 AS needs_review, {NOW} IS NOT NULL AS kept FROM docs")
def partial_updates(spark, d):
    """Titles and review flags of documents after updates that give some of them, some twice."""
    docs = src.documents(spark, d).select("document_id", "user_id", F.lit("old").alias("title"), F.lit(False).alias("needs_review"), F.lit(True).alias("kept"))
    change = lambda n, title, flag, at: docs.filter(F.col("document_id") % 4 < n).select("document_id", F.lit(title).alias("title"), F.lit(flag).cast("boolean").alias("needs_review"), F.lit(at).alias("seq"))
    return updates.patch(docs, "document_id", change(2, "title 1", None, 1).unionByName(change(1, "title 2", None, 2)).unionByName(change(1, None, True, 3)), ["seq"])


_RUN = "case_id IN (SELECT query_id FROM q WHERE query_id % 7 <> 0 AND text <> '' AND length(text) <= 2000)"


@query(
    f"""{HERE}, {LONG.replace("FROM metrics)", f"FROM metrics WHERE case_id % 3 <> 0 AND {_RUN})")}
SELECT stage, metric || '@' || k AS name, mean, (SELECT count(*) FROM q) AS n_cases, (SELECT count(*) FROM q WHERE query_id % 3 <> 0) AS n_answerable,
  (SELECT count(*) FROM q WHERE query_id % 7 = 0 OR coalesce(text, '') = '') AS n_empty, (SELECT count(*) FROM q WHERE query_id % 7 <> 0 AND length(text) > 2000) AS n_long FROM means"""
)
def eval_summary(spark, d):
    """The summary of an evaluation: means over answerable cases that could be run, and how many couldn't, read back from its JSON."""
    asked = src.query_batch(spark, d).withColumn("text", F.when(F.col("query_id") % 7 == 0, "  ").otherwise(F.col("text")))
    cases = asked.select(F.col("query_id").alias("case_id"), F.col("text").alias("query"), F.lit(None).cast("string").alias("user_id"), F.array().cast("array<string>").alias("document_ids"), (F.col("query_id") % 3 != 0).alias("answerable"), "embedding")
    ranked, dropped = evaluation.run_cases(cases, HybridRetriever(), src.vector_chunks(spark, d))
    found = stored(spark, metrics.rank_metrics(ranked, src.gold(spark, d)))
    schema = "n_cases bigint, n_answerable bigint, aggregate map<string, map<string, double>>, dropped map<string, bigint>"
    x = evaluation.summary_report(cases, found, dropped).select(F.from_json("report", schema).alias("r")).select("r.*")
    n = lambda reason: F.coalesce(F.try_element_at("dropped", F.lit(reason)), F.lit(0)).alias
    x = x.select("n_cases", "n_answerable", n("empty query")("n_empty"), n("long query")("n_long"), F.explode("aggregate").alias("stage", "means"))
    return x.select("stage", F.explode("means").alias("name", "mean"), "n_cases", "n_answerable", "n_empty", "n_long")


@query(
    r"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 35 END AS top_k, doc_id % 120 AS n FROM documents)
SELECT doc_id, CASE WHEN coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), '') = '' THEN 'empty query' WHEN length(text) > 2000 THEN 'long query' WHEN coalesce(top_k, 8) NOT BETWEEN 1 AND 30 THEN 'top_k out of bounds' WHEN n > 100 THEN 'too many documents' ELSE 'ok' END AS verdict FROM r"""
)
def request_verdicts(spark, d):
    x = src.table(spark, d, "documents")
    ids = F.when(F.col("doc_id") % 120 > 0, F.sequence(F.lit(1), (F.col("doc_id") % 120).cast("int")))
    asked = x.select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 35).cast("int")).alias("top_k"), ids.alias("document_ids"))
    return retrieval.request_verdicts(asked).select("doc_id", "verdict")


@query(
    f"""WITH {DOCS}, {JOBS}, c AS (SELECT *, {NOW} - to_seconds(CAST(document_id % 40 AS INT)) AS created_at FROM docs)
SELECT document_id, user_id FROM c WHERE status = 'pending' AND created_at < {NOW} - INTERVAL 12 SECOND AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.document_id = c.document_id AND j.status IN ('queued', 'running')) ORDER BY created_at, document_id LIMIT 20"""
)
def oldest_pending(spark, d):
    """The twenty oldest pending documents that no job will move, past the grace of those just uploaded."""
    docs = src.documents(spark, d).withColumn("created_at", F.lit(src.NOW).cast("timestamp") - F.make_dt_interval(secs=(F.col("document_id") % 40)))
    return job_ops.pending_without_job(docs, src.jobs(spark, d), src.NOW, limit=20).select("document_id", "user_id")


@query(f"WITH {JOBS} SELECT document_id, stage AS schema_name, job_id AS extraction_id FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id, stage ORDER BY created_at DESC, job_id DESC) = 1")
def newest_extractions(spark, d):
    x = src.jobs(spark, d).select("document_id", F.col("stage").alias("schema_name"), F.col("job_id").alias("extraction_id"), "created_at")
    return job_ops.newest_per_schema(x).select("document_id", "schema_name", "extraction_id")


@query(
    f"""WITH {DOCS}, c AS (SELECT content_hash, bool_or(document_id % 2 = 0) AS held FROM docs WHERE text IS NOT NULL GROUP BY 1), n AS (SELECT count(*) FILTER (held) AS n_cached, count(*) FILTER (NOT held) AS n_computed FROM c),
s AS (SELECT unnest(['clean', 'chunk', 'embed']) AS stage, unnest([0, 1, 1]) AS changed)
SELECT run, stage, CASE WHEN run = 2 AND changed = 1 THEN 0 WHEN run = 2 THEN n_cached + n_computed ELSE n_cached END AS n_cached, CASE WHEN run = 2 AND changed = 1 THEN n_cached + n_computed WHEN run = 2 THEN 0 ELSE n_computed END AS n_computed FROM s, n, (SELECT unnest([1, 2]) AS run)"""
)
def cached_stages(spark, d):
    """What a second ingestion, of all documents after every second one, and a third with another chunk size read and made."""
    folder, docs = new_path(spark), src.documents(spark, d).select("document_id", "content_hash", "text")
    made = lambda limit: {"clean": stages.clean, "chunk": stages.chunk(limit), "embed": stages.embed("hashing-64")}
    stages.ingest(docs.filter("document_id % 2 = 0"), folder, STAGE_CONFIGS, made(64))
    _, second = stages.ingest(docs, folder, STAGE_CONFIGS, made(64))
    _, third = stages.ingest(docs, folder, STAGE_CONFIGS | {"chunk": "limit=32,overlap=8"}, made(32))
    return second.select(F.lit(1).alias("run"), "*").unionByName(third.select(F.lit(2).alias("run"), "*"))


@query(
    rf"""WITH {DOCS}, w AS (SELECT document_id, regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace(text, '[' || chr(8203) || chr(8204) || chr(8205) || chr(65279) || ']', '', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), '[^ \t\n\r]+') AS w FROM docs),
s AS (SELECT document_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 64) / 56) AS BIGINT)) + 1)) AS piece FROM w WHERE len(w) > 0)
SELECT document_id, piece AS chunk_index, CAST(len(w[piece * 56 + 1 : piece * 56 + 64]) AS BIGINT) AS token_count, sha256(array_to_string(w[piece * 56 + 1 : piece * 56 + 64], ' ')) AS text, 64 AS dimension FROM s"""
)
def staged_chunks(spark, d):
    """Chunks of all documents by the stages, half of them out of the cache."""
    folder, docs = new_path(spark), src.documents(spark, d).select("document_id", "content_hash", "text")
    made = {"clean": stages.clean, "chunk": stages.chunk(), "embed": stages.embed("hashing-64")}
    stages.ingest(docs.filter("document_id % 2 = 0"), folder, STAGE_CONFIGS, made)
    chunks, _ = stages.ingest(docs, folder, STAGE_CONFIGS, made)
    return chunks.select("document_id", "chunk_index", "token_count", F.sha2("text", 256).alias("text"), F.size("embedding").alias("dimension"))
