"""Further registered queries: query language, structural chunks, evaluation reports, job and key rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import evaluation, ingest, jobs as job_ops, metrics, query_language, relational, structure, text_index
from textloom.sources import tables as src

from .hybrid import HybridRetriever
from .queries import DOCS, EXPANDED, JOBS, LATEST, MMR, NOW, SEARCH, STAGE_CONFIGS, STAGE_NAMES, STAGES, _PRINTS, query

LEX = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+')"
HERE = "WITH RECURSIVE " + ", ".join([SEARCH, MMR, EXPANDED, STAGES])


# query language

ASKED = r"""asked AS (SELECT doc_id AS query_id, source AS user_id, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS d FROM (
  SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id % 100 = 0) WHERE len(w) > 3 AND NOT list_contains(w[1:4], 'or'))"""


def _asked(spark, d):
    """Searches with a phrase, an exclusion and an alternative, made of the first words of every hundredth document."""
    mine = F.col("doc_id") % 100 == 0
    # other texts aren't taken apart, in whatever order filters run
    x = src.table(spark, d, "documents").filter(mine).select(F.col("doc_id").alias("query_id"), F.col("source").alias("user_id"), tx.lexemes(F.when(mine, F.col("text"))).alias("w"))
    x = x.filter((F.size("w") > 3) & ~F.array_contains(F.slice("w", 1, 4), "or"))
    w = lambda k: F.get("w", F.lit(k))
    return x.select("query_id", "user_id", F.concat(F.lit('"'), w(0), F.lit(" "), w(1), F.lit('" -'), w(2), F.lit(" OR "), w(3), F.lit(" "), w(0)).alias("text"))


@query(
    rf"""WITH {ASKED}, docs AS (SELECT doc_id, source, ' ' || array_to_string({LEX.format(x='text')}, ' ') || ' ' AS t FROM documents)
SELECT query_id, doc_id AS document_id FROM asked JOIN docs ON source = user_id
WHERE (contains(t, ' ' || a || ' ' || b || ' ') AND NOT contains(t, ' ' || c || ' ')) OR (contains(t, ' ' || d || ' ') AND contains(t, ' ' || a || ' '))"""
)
def web_search(spark, d):
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), "text")
    return text_index.search_phrases(text_index.build_positions(docs), _asked(spark, d))


@query(r"""SELECT conv_id, turn, regexp_matches(text, '"[^"]+"|(^|\s)-\w|(?i:(^|\s)or(\s|$))') AS operators, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS normal FROM conversations""")
def query_syntax(spark, d):
    return src.messages(spark, d).select("conv_id", "turn", query_language.has_operators(F.col("text")).alias("operators"), tx.normal_query(F.col("text")).alias("normal"))


# structure

ITEMS = r"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
items AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS item FROM raw),
lev AS (SELECT *, CASE WHEN item % 7 = 0 THEN 1 WHEN item % 7 = 3 THEN 2 END AS level, CASE WHEN doc_id % 5 <> 0 THEN CAST(item // 10 + 1 AS INT) END AS page FROM (SELECT doc_id, item, CASE WHEN item % 7 IN (0, 3) THEN array_to_string(regexp_extract_all(text, '[^ \t\n\r]+')[1:4], ' ') ELSE text END AS text FROM items)),
sec AS (SELECT *, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 1 THEN item END IGNORE NULLS) OVER w AS p1,
  last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN level = 2 THEN item END IGNORE NULLS) OVER w AS p2, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER w AS part
  FROM lev WINDOW w AS (PARTITION BY doc_id ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CASE WHEN p2 > coalesce(p1, -1) THEN CASE WHEN h1 IS NULL THEN h2 ELSE h1 || ' > ' || h2 END ELSE h1 END AS section FROM sec),
bodies AS (SELECT doc_id, CAST(part AS BIGINT) AS part, min(section) AS section, min(page) AS page, string_agg(text, chr(10) ORDER BY item) AS text FROM s WHERE level IS NULL GROUP BY doc_id, part)"""


def _items(spark, d):
    """Lines of documents, of which some are headings (their first four words) of two levels."""
    x = ingest.text_items(src.table(spark, d, "documents"))
    at = F.col("item") % 7
    level = F.when(at == 0, 1).when(at == 3, 2)
    head = F.array_join(F.slice(tx.words(F.col("text")), 1, 4), " ")
    return x.select("doc_id", "item", level.alias("level"), F.when(level.isNotNull(), head).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 5 != 0, F.floor(F.col("item") / 10).cast("int") + 1).alias("page"))


@query(f"WITH {ITEMS} SELECT doc_id, part, section, page, text FROM bodies")
def merged_bodies(spark, d):
    return structure.merged_bodies(_items(spark, d))


@query(
    rf"""WITH {ITEMS}, w AS (SELECT doc_id, part, section, page, regexp_extract_all(text, '[^ \t\n\r]+') AS w, coalesce(regexp_extract_all(replace(section, ' > ', ' '), '[^ \t\n\r]+'), []) AS head FROM bodies),
r AS (SELECT *, 64 - len(head) AS room, greatest(1, 64 - len(head) - 8) AS step FROM w WHERE len(w) > 0),
p AS (SELECT *, unnest(range(0, greatest(0, CAST(ceil((len(w) - room) / step) AS BIGINT)) + 1)) AS piece FROM r)
SELECT doc_id, part, piece, section, page, CAST(len(head) + len(w[piece * step + 1 : piece * step + room]) AS BIGINT) AS n_tokens, array_to_string(list_concat(head, w[piece * step + 1 : piece * step + room]), ' ') AS text FROM p"""
)
def structural_chunks(spark, d):
    x = structure.structural_chunks(_items(spark, d))
    return x.select("doc_id", "part", F.col("piece").cast("bigint").alias("piece"), "section", "page", F.col("n_tokens").cast("bigint").alias("n_tokens"), "text")


@query(f"WITH {ITEMS} SELECT doc_id, part, section || chr(10) AS prefix FROM bodies WHERE section IS NOT NULL UNION ALL SELECT doc_id, part, '' FROM bodies WHERE section IS NULL")
def heading_prefixes(spark, d):
    x = structure.merged_bodies(_items(spark, d))
    context = F.when((F.col("doc_id") % 2 == 0) & F.col("section").isNotNull(), F.concat("section", F.lit("\n"), "text")).otherwise(F.concat("text", F.lit("!")))
    return x.select("doc_id", "part", structure.heading_prefix(context, F.col("text"), F.col("section")).alias("prefix"))


@query(f"WITH {ITEMS} SELECT doc_id, count(DISTINCT page) AS pages, count(*) FILTER (level IS NULL) AS text_items, count(*) FILTER (level IS NOT NULL) AS headings FROM lev GROUP BY 1")
def document_stats(spark, d):
    return structure.document_stats(_items(spark, d))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, CAST(ceil((len(w) - 64) / 14) AS BIGINT)) + 1)) AS piece FROM w WHERE len(w) > 0)
SELECT doc_id, piece, array_to_string(w[piece * 14 + 1 : piece * 14 + 64], ' ') AS text FROM s"""
)
def fixed_chunks(spark, d):
    w = ingest.token_windows(src.table(spark, d, "documents"), overlap=50)
    return w.select("doc_id", F.col("piece").cast("bigint").alias("piece"), "text")


@query(
    rf"""WITH w AS (SELECT doc_id, unnest({LEX.format(x='text')}) AS w FROM documents), h AS (SELECT doc_id, CAST('0x' || left(md5(w), 8) AS BIGINT) AS code FROM w),
p AS (SELECT doc_id, code % 64 AS place, sum(CASE WHEN (code >> 16) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS s FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS norm FROM p GROUP BY 1)
SELECT d.doc_id, k AS place, round(CASE WHEN norm > 0 THEN coalesce(s, 0) / norm ELSE 0 END, 5) AS value FROM documents d, range(0, 64) AS r(k) LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN p ON p.doc_id = d.doc_id AND p.place = k"""
)
def hashed_embeddings(spark, d):
    x = structure.embedder("hashing-64")(src.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return x.select("doc_id", F.posexplode("embedding").alias("place", "value")).select("doc_id", F.col("place").cast("bigint").alias("place"), F.round("value", 5).alias("value"))


@query("SELECT vec_id AS chunk_id, len(embedding) AS n FROM embeddings")
def indexable_chunks(spark, d):
    return structure.indexable(src.vector_chunks(spark, d), 64).select("chunk_id", F.size("embedding").cast("bigint").alias("n"))


# evaluation


@query("SELECT CAST(item_id AS VARCHAR) AS case_id, text AS query, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 2 END AS n_gold, item_id % 3 <> 0 AS answerable, '' AS reference_answer, 0 AS n_tags FROM benchmark")
def eval_cases(spark, d):
    """Cases written as lines of JSON, between comments and blank lines, and read back."""
    b = src.table(spark, d, "benchmark")
    gold = F.when(F.col("item_id") % 3 != 0, F.array(F.lit("b"), F.lit("a")))
    whole = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), gold.alias("relevant_chunk_ids"), F.when(F.col("item_id") % 3 == 0, False).alias("answerable"), F.lit(1).alias("notes"))
    lines = b.select(F.explode(F.array(F.to_json(whole), F.lit("  "), F.lit(" # comment"))).alias("value"))
    back = evaluation.read_cases(evaluation.case_lines(evaluation.read_cases(lines)))
    return back.select("case_id", "query", F.size("gold").alias("n_gold"), "answerable", "reference_answer", F.size("tags").alias("n_tags"))


def _metrics(spark, d):
    return metrics.rank_metrics(HybridRetriever().stages(src.query_batch(spark, d), src.vector_chunks(spark, d)), src.gold(spark, d))


LONG = "long AS (SELECT * FROM (SELECT stage, k, unnest(['hit', 'precision', 'recall', 'mrr', 'ndcg']) AS metric, unnest([hit, precision, recall, mrr, ndcg]) AS value FROM metrics)), means AS (SELECT stage, metric, k, round(avg(value), 4) AS mean FROM long GROUP BY ALL)"


@query(
    f"{HERE}, {LONG} SELECT metric, k, {', '.join(f'max(mean) FILTER (stage = {chr(39)}{s}{chr(39)}) AS {s}' for s in STAGE_NAMES)} FROM means WHERE (metric, k) IN {evaluation.KEY_METRICS} GROUP BY ALL"
)
def stage_report(spark, d):
    return evaluation.stage_report(metrics.aggregate_metrics(_metrics(spark, d)), list(STAGE_NAMES))


@query(
    f"{HERE}, {LONG} SELECT a.metric, a.k, s.step, round(b.mean - a.mean, 4) AS lift FROM (VALUES ('fusion', 'vector', 'fused'), ('rerank', 'rerank_input', 'post_rerank')) AS s(step, x, y) JOIN means a ON a.stage = s.x JOIN means b ON b.stage = s.y AND b.metric = a.metric AND b.k = a.k"
)
def stage_lifts(spark, d):
    return evaluation.lifts(metrics.aggregate_metrics(_metrics(spark, d)))


@query(f"{HERE} SELECT case_id, stage FROM metrics WHERE k = 5 AND hit = 0 AND stage IN ('keyword', 'selected')")
def failed_cases(spark, d):
    m = _metrics(spark, d)
    return evaluation.failures(m, "keyword").withColumn("stage", F.lit("keyword")).unionByName(evaluation.failures(m, "selected").withColumn("stage", F.lit("selected")))


@query(
    f"WITH {JOBS} SELECT job_id AS run_id, CASE WHEN job_id % 3 = 0 THEN 'completed' WHEN job_id % 3 = 1 THEN 'running' ELSE status END AS status, CASE WHEN job_id % 3 = 0 AND job_id % 2 = 0 THEN 'new' ELSE details END AS metrics, epoch_us(CASE WHEN job_id % 3 = 0 THEN coalesce(finished_at, {NOW}) ELSE finished_at END) AS finished_us FROM jobs"
)
def run_status(spark, d):
    jobs = src.jobs(spark, d)
    runs = jobs.select(F.col("job_id").alias("run_id"), "status", F.col("details").alias("metrics"), "finished_at")
    moved = jobs.filter("job_id % 3 < 2").select(F.col("job_id").alias("run_id"), F.when(F.col("job_id") % 3 == 0, "completed").otherwise("running").alias("new_status"), F.when((F.col("job_id") % 3 == 0) & (F.col("job_id") % 2 == 0), "new").alias("new_metrics"), F.lit(src.NOW).cast("timestamp").alias("at"))
    before = moved.withColumns({"new_status": F.lit("running"), "new_metrics": F.lit("early"), "at": F.col("at") - F.expr("INTERVAL 1 HOUR")})  # each run twice
    return evaluation.set_run_status(runs, before.filter("new_metrics is not null and run_id % 2 = 0 and run_id % 3 = 0").unionByName(moved)).select("run_id", "status", "metrics", F.unix_micros("finished_at").alias("finished_us"))


# jobs and documents


@query(f"WITH {JOBS}, t AS (SELECT job_id, unnest(range(1, job_id % 4 + 1)) AS attempt FROM jobs WHERE status = 'running') SELECT job_id, count(*) AS n_attempts, 'error ' || max(attempt) AS last_error FROM t GROUP BY 1")
def record_attempts(spark, d):
    jobs = src.jobs(spark, d)
    attempts = jobs.select("job_id", F.explode(F.sequence(F.lit(0), F.col("job_id") % 4)).alias("attempt")).filter("attempt > 0").select("job_id", "attempt", F.concat(F.lit("error "), F.col("attempt").cast("string")).alias("error"))
    return job_ops.record_attempts(jobs, attempts).select("job_id", "n_attempts", "last_error")


@query(
    f"""WITH {JOBS}, u AS (SELECT job_id, CASE job_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' END AS t FROM jobs)
SELECT job_id, document_id, coalesce(t, status) AS status, epoch_us(CASE WHEN t = 'running' THEN {NOW} WHEN t = 'failed' THEN {NOW} - INTERVAL 1 HOUR ELSE started_at END) AS started_us, epoch_us(CASE WHEN t = 'failed' THEN {NOW} ELSE finished_at END) AS finished_us,
  CASE WHEN t = 'failed' THEN '7' WHEN t = 'running' THEN '3' ELSE json_extract_string(details, '$.k') END AS k, CASE WHEN t = 'failed' THEN 'lost' END AS error, CASE WHEN t IS NOT NULL THEN '{{"of":[1,2.5,null]}}' END AS nested FROM jobs JOIN u USING (job_id)"""
)
def mark_jobs(spark, d):
    jobs = src.jobs(spark, d)
    to = F.when(F.col("job_id") % 3 == 0, "running").when(F.col("job_id") % 3 == 1, "failed")
    updates = jobs.select("job_id", to.alias("to"), F.lit(src.NOW).cast("timestamp").alias("at"), F.when(to == "failed", '{"k": 7, "error": "lost"}').alias("more")).filter("to is not null")
    before = updates.select("job_id", F.lit("running").alias("to"), (F.col("at") - F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit('{"k": 3, "nested": {"of": [1, 2.5, null]}}').alias("more"))  # each job twice
    x = job_ops.mark(jobs, updates.unionByName(before))
    field = lambda name: F.get_json_object("details", f"$.{name}").alias(name)
    return x.select("job_id", "document_id", "status", F.unix_micros("started_at").alias("started_us"), F.unix_micros("finished_at").alias("finished_us"), field("k"), field("error"), field("nested"))


@query("SELECT event_id, e AS error, CASE WHEN e IN ('ValueError', 'DocumentNotFound') THEN 'permanent' ELSE 'transient' END AS kind FROM (SELECT event_id, ['ValueError', 'TimeoutError', 'DocumentNotFound', 'OSError'][event_id % 4 + 1] AS e FROM events)")
def error_classes(spark, d):
    names = F.array(*map(F.lit, ("ValueError", "TimeoutError", "DocumentNotFound", "OSError")))
    x = src.table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("error"))
    return x.withColumn("kind", job_ops.error_class(F.col("error")))


@query(f"WITH {DOCS} SELECT document_id, CASE document_id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'indexed' ELSE status END AS status, CASE WHEN document_id % 3 = 0 THEN 'why' WHEN document_id % 3 = 2 THEN 'old' END AS error, document_id % 3 = 1 AS stamped FROM docs")
def set_status(spark, d):
    docs = src.documents(spark, d).select("document_id", "status", F.lit("old").alias("error"), F.lit(None).cast("timestamp").alias("indexed_at"))
    at = F.col("document_id") % 3
    updates = docs.filter(at < 2).select("document_id", F.when(at == 0, "failed").otherwise("indexed").alias("to"), F.when(at == 0, "why").alias("why"), F.lit(src.NOW).cast("timestamp").alias("at"))
    before = updates.withColumns({"to": F.lit("processing"), "why": F.lit("earlier"), "at": F.col("at") - F.expr("INTERVAL 1 HOUR")})  # each document twice
    x = job_ops.set_status(docs, before.unionByName(updates).unionByName(updates.limit(1).withColumn("document_id", F.lit(-5).cast("bigint"))))
    return x.select("document_id", "status", "error", F.col("indexed_at").isNotNull().alias("stamped"))


@query(f"WITH {DOCS}, c AS (SELECT vec_id // 8 AS document_id, count(*) AS n FROM embeddings GROUP BY 1) SELECT document_id, coalesce(n, 0) AS chunk_count, CASE WHEN document_id % 2 = 0 AND n IS NOT NULL THEN n ELSE 1 END AS page_count FROM docs LEFT JOIN c USING (document_id)")
def index_results(spark, d):
    docs = src.documents(spark, d).select("document_id", F.lit(0).cast("bigint").alias("chunk_count"), F.lit(1).cast("bigint").alias("page_count"), F.lit(None).cast("timestamp").alias("indexed_at"))
    n = src.vector_chunks(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    results = n.select("document_id", "chunks", F.when(F.col("document_id") % 2 == 0, F.col("chunks")).alias("pages"), F.lit(src.NOW).cast("timestamp").alias("at"))
    return job_ops.set_index_results(docs, results).select("document_id", "chunk_count", "page_count")


@query(f"WITH {DOCS}, {JOBS} SELECT document_id, document_id IN (SELECT document_id FROM jobs WHERE status IN ('queued', 'running')) AS active FROM docs")
def active_jobs(spark, d):
    return job_ops.has_active_job(src.documents(spark, d), src.jobs(spark, d))


@query(f"WITH {JOBS} SELECT document_id, job_id, stage, status FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, job_id DESC) = 1")
def latest_job(spark, d):
    return job_ops.latest_overall(src.jobs(spark, d)).select("document_id", "job_id", "stage", "status")


_UUID = "'{x}' || lpad(to_hex({c}), 8, '0') || '-0000-4000-8000-' || lpad(to_hex({c}), 12, '0')"
_ARTIFACTS = f"SELECT unnest([{', '.join(_PRINTS)}]) AS fp, unnest({list(STAGE_CONFIGS)}) AS stage"


def _keyed(spark, d):
    """Documents with storage keys, owners and ids as UUIDs."""
    hex_of = lambda n: F.lower(F.lpad(F.hex("document_id"), n, "0"))
    name = F.concat(hex_of(8), F.lit("-0000-4000-8000-"), hex_of(12))
    docs = src.documents(spark, d).withColumn("uuid", name)
    return docs.withColumns({"storage_key": F.concat("uuid", F.lit("/"), F.left("content_hash", F.lit(2)), F.lit("/"), "content_hash", F.lit(".txt")), "parsed_key": F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("parsed/"), "uuid"))})


KEYED = "keyed AS (SELECT *, lower(lpad(to_hex(document_id), 8, '0')) || '-0000-4000-8000-' || lower(lpad(to_hex(document_id), 12, '0')) AS uuid FROM docs)"
LIVE = f"""arts AS ({_ARTIFACTS}), live AS (SELECT uuid || '/' || left(content_hash, 2) || '/' || content_hash || '.txt' AS key FROM keyed UNION SELECT 'parsed/' || uuid FROM keyed WHERE document_id % 2 = 0
  UNION SELECT '_pipeline/cache/' || fp || '/' || content_hash || '/' || stage || '.json.gz' FROM keyed, arts)"""


@query(f"WITH {DOCS}, {KEYED}, {LIVE} SELECT key, CASE WHEN starts_with(key, '_pipeline') THEN 'artifact' WHEN NOT starts_with(key, 'parsed') THEN 'user' END AS shape FROM live")
def live_keys(spark, d):
    return job_ops.live_keys(_keyed(spark, d), STAGE_CONFIGS).withColumn("shape", job_ops.key_shape(F.col("key")))


@query(
    f"""WITH {DOCS}, {KEYED} SELECT 'x/_pipeline/' || uuid || '/new.json' AS key FROM keyed UNION ALL SELECT uuid || '/_pipeline/' || uuid || '/gone.json' FROM keyed WHERE document_id % 2 = 1
UNION ALL SELECT 'parsed/' || uuid FROM keyed WHERE document_id % 2 = 1"""
)
def orphan_keys(spark, d):
    docs = _keyed(spark, d)
    below = lambda first, name: F.concat(first, F.lit("/_pipeline/"), "uuid", F.lit(f"/{name}.json"))
    kept = F.when(F.col("document_id") % 2 == 0, below(F.col("uuid"), "new")).otherwise(below(F.col("uuid"), "gone"))
    objects = docs.select(F.explode(F.array("storage_key", F.concat(F.lit("parsed/"), "uuid"), below(F.lit("x"), "new"), kept)).alias("key"))
    owners = docs.filter("document_id % 2 = 0").select(F.col("uuid").alias("user_id"), F.col("uuid").alias("document_id"))
    return job_ops.orphans(objects, job_ops.live_keys(docs, STAGE_CONFIGS), owners)


@query(
    f"""WITH {DOCS}, a AS ({_ARTIFACTS}) SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN document_id % 4 = 0 THEN 'chunk' END AS stage,
  (SELECT string_agg('_pipeline/cache/' || fp || '/' || content_hash || '/' || stage || '.json.gz', ',' ORDER BY stage) FROM a WHERE document_id % 4 = 0 AND stage IN ('chunk', 'embed')) AS keys FROM docs"""
)
def reprocess(spark, d):
    docs = src.documents(spark, d).withColumn("indexed_at", F.lit(src.NOW).cast("timestamp"))
    asked = docs.filter("document_id % 4 = 0").select("document_id", F.lit("chunk").alias("from_stage"))
    after, jobs, keys = job_ops.reprocess(docs, asked, STAGE_CONFIGS)
    gone = keys.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.regexp_extract("key", r"([a-z]+)\.json", 1).alias("s"), "key"))).alias("ks")).select("document_id", F.array_join(F.col("ks.key"), ",").alias("keys"))
    return after.select("document_id", "status").join(jobs.select("document_id", "stage"), "document_id", "left_outer").join(gone, "document_id", "left_outer")


@query(f"WITH {JOBS}, {LATEST}, {DOCS} SELECT d.document_id, d.user_id FROM docs d JOIN (SELECT document_id, max(created_at) AS u FROM jobs GROUP BY 1) j USING (document_id) WHERE status = 'processing' AND u < {NOW} - INTERVAL 6 HOUR")
def stale_processing(spark, d):
    touched = src.jobs(spark, d).groupBy("document_id").agg(F.max("created_at").alias("updated_at"))
    return job_ops.processing_since(src.documents(spark, d).join(touched, "document_id"), "2024-01-30 06:00:00").select("document_id", "user_id")


# read patterns


@query("SELECT d.doc_id, d.source AS user_id, d.n_chars FROM documents d WHERE d.doc_id % 10 = 0 AND d.source = CASE WHEN d.doc_id % 20 = 0 THEN d.source ELSE 'src0' END")
def owner_lookups(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", F.col("source").alias("user_id"), "n_chars")
    wanted = docs.filter("doc_id % 10 = 0").select("doc_id", F.when(F.col("doc_id") % 20 == 0, F.col("user_id")).otherwise("src0").alias("user_id"))
    return relational.owned(docs, wanted, "doc_id").select("doc_id", "user_id", "n_chars")


@query("SELECT i.id AS doc_id, d.source FROM (SELECT doc_id * 7 AS id FROM documents) i LEFT JOIN documents d ON d.doc_id = i.id")
def point_lookups(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", "source")
    return relational.point_lookup(docs, "doc_id", docs.select((F.col("doc_id") * 7).alias("doc_id")))


@query(f"WITH {SEARCH} SELECT chunk_id, page_number FROM chunks WHERE contains(lower(text), 'the') AND page_number = 2")
def annotation_search(spark, d):
    return relational.search_annotations(src.vector_chunks(spark, d), "The", 2).select("chunk_id", "page_number")


@query(f"WITH {DOCS} SELECT document_id, user_id FROM docs WHERE status = 'indexed'")
def documents_by_status(spark, d):
    return relational.only(src.documents(spark, d), status="indexed", user_id=None).select("document_id", "user_id")


@query(r"SELECT doc_id, left(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), 200) AS meta, ['.pdf', '.md', '.bin'][doc_id % 3 + 1] AS ending FROM documents")
def metadata_values(spark, d):
    mime = F.element_at(F.array(F.lit("application/pdf"), F.lit("text/markdown"), F.lit("image/x-odd")), (F.col("doc_id") % 3 + 1).cast("int"))
    return src.table(spark, d, "documents").select("doc_id", job_ops.ascii_metadata(F.col("text")).alias("meta"), job_ops.extension(mime).alias("ending"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def message_listing(spark, d):
    """A conversation's messages in order, each with its place."""
    return relational.listed(src.messages(spark, d).select("conv_id", "turn", "role"), "conv_id", ["turn"])
