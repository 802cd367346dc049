"""Ingestion: cleaning, tables of contents, token windows, fingerprints, dedup of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import clean_text, fingerprint_chain, words

# An entry of a table of contents, and the stages in order.
TOC_LINE = r"\.{3,}\s*[0-9]+"
STAGES = ("extract", "clean", "chunk", "embed", "index")


def text_items(documents: DataFrame) -> DataFrame:
    """doc_id, item, text: lines in reading order."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("item", "text"))


def clean_items(items: DataFrame) -> DataFrame:
    """Adds the cleaned text, and whether cleaning changed or emptied it."""
    cleaned = items.withColumn("clean", clean_text(F.col("text")))
    return cleaned.withColumn("changed", F.col("clean") != F.col("text")).withColumn("empty", F.col("clean") == "")


def toc_documents(items: DataFrame) -> DataFrame:
    """doc_id, n_toc, longest, ascending, is_toc: five or more entries with dots and a page, five of them within
    gaps of at most five items, two or more pages, and over 80 % of neighbouring pages ascending."""
    entries = items.filter(F.col("text").rlike(TOC_LINE))
    by = Window.partitionBy("doc_id").orderBy("item")
    entries = entries.withColumn("jump", F.when(F.col("item") - F.lag("item").over(by) <= 5, 0).otherwise(1))
    entries = entries.withColumn("cluster", F.sum("jump").over(by))
    sizes = entries.groupBy("doc_id", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_toc"), F.max("n").alias("longest"))
    pages = entries.select("doc_id", "item", F.posexplode(F.regexp_extract_all("text", F.lit(r"\.{3,}\s*([0-9]+)"), 1)).alias("k", "page"))
    after = Window.partitionBy("doc_id").orderBy("item", "k")
    pages = pages.withColumn("page", F.col("page").cast("bigint")).withColumn("before", F.lag("page").over(after))
    rises = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.avg(F.when(F.col("before").isNotNull(), (F.col("page") >= F.col("before")).cast("int"))).alias("ascending"))
    out = sizes.join(rises, "doc_id")
    return out.select("doc_id", "n_toc", "longest", "ascending", ((F.col("n_toc") >= 5) & (F.col("longest") >= 5) & (F.col("n_pages") >= 2) & (F.col("ascending") > 0.8)).alias("is_toc"))


def prune_toc(items: DataFrame) -> DataFrame:
    """Items without the entries of documents that are found to have a table of contents."""
    toc = toc_documents(items).filter("is_toc").select("doc_id")
    bad = items.filter(F.col("text").rlike(TOC_LINE)).join(toc, "doc_id", "left_semi").select("doc_id", "item")
    return items.join(bad, ["doc_id", "item"], "left_anti")


def cleaning_stats(items: DataFrame) -> DataFrame:
    """Per document: text_items (after pruning), changed, empty, toc_detected, toc_items_found, pruned."""
    marked = clean_items(items).withColumn("entry", F.col("clean").rlike(TOC_LINE).cast("int"))
    toc = toc_documents(marked.filter("entry = 1").select("doc_id", "item", F.col("clean").alias("text"))).select("doc_id", "is_toc")
    by_doc = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"), F.count_if("empty").alias("empty"), F.sum("entry").alias("toc_items_found"))
    out = by_doc.join(toc, "doc_id", "left_outer").withColumn("toc_detected", F.coalesce("is_toc", F.lit(False)))
    pruned = F.when(F.col("toc_detected"), F.col("toc_items_found")).otherwise(F.lit(0).cast("bigint"))
    return out.select("doc_id", (F.col("n") - pruned).alias("text_items"), "changed", "empty", "toc_detected", "toc_items_found", pruned.alias("pruned"))


def token_windows(documents: DataFrame, limit: int = 64, overlap: int = 8, prefix: str = "", text_col: str = "text") -> DataFrame:
    """doc_id, piece (from 0), n_tokens, text: windows of ``limit`` words less the prefix's, ``overlap`` shared.

    A prefix as long as the limit is an error; an empty body gives the prefix alone, or nothing.
    """
    head = prefix.split()
    room = limit - len(head)
    if room <= 0:
        raise ValueError("the prefix leaves no room")
    step = max(1, room - overlap)
    w = documents.select("doc_id", words(F.col(text_col)).alias("w")).withColumn("n", F.size("w"))
    # the window that reaches the end is the last: starts 0, step, ... while start - step + room < n
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - room) / F.lit(step)).cast("int"))
    w = w.filter((F.col("n") > 0) | F.lit(bool(head))).withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    body = F.slice("w", F.col("piece") * step + 1, F.lit(room))
    tokens = F.concat(F.array(*map(F.lit, head)), body) if head else body
    return w.select("doc_id", "piece", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("text"))


def artifact_keys(documents: DataFrame, configs: dict[str, str], from_stage: str | None = None) -> DataFrame:
    """document_id, stage, key of each cached artifact from a stage onward (content hash and chained fingerprint)."""
    prints = dict(zip(configs, fingerprint_chain(list(configs.values())), strict=True))
    stages = list(configs)
    stages = stages[stages.index(from_stage) :] if from_stage else stages
    each = F.array(*[F.struct(F.lit(s).alias("stage"), prints[s].alias("fp")) for s in stages])
    out = documents.filter(F.col("content_hash").isNotNull()).select("document_id", "content_hash", F.explode(each).alias("x"))
    return out.select("document_id", F.col("x.stage").alias("stage"), F.concat_ws("/", F.lit("_pipeline"), F.lit("cache"), F.col("x.fp"), F.col("content_hash"), F.concat(F.col("x.stage"), F.lit(".json.gz"))).alias("key"))


def upload_verdicts(uploads: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds verdict (existing, duplicate, new) and document: the stored or first uploaded one with that owner and hash."""
    stored = documents.groupBy("user_id", "content_hash").agg(F.min("document_id").alias("stored_id"))
    firsts = uploads.groupBy("user_id", "content_hash").agg(F.min("upload_id").alias("first_id"))
    out = uploads.join(stored, ["user_id", "content_hash"], "left_outer").join(firsts, ["user_id", "content_hash"])
    verdict = F.when(F.col("stored_id").isNotNull(), "existing").when(F.col("upload_id") != F.col("first_id"), "duplicate").otherwise("new")
    return out.select("upload_id", "user_id", verdict.alias("verdict"), F.coalesce("stored_id", "first_id").alias("document"))


def sniff_mime(head: Column, name: Column) -> Column:
    """Mime type of textual content by its first characters, then by the name's ending; null where nothing fits."""
    start = F.lower(F.substring(F.ltrim(head), 1, 64))
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    text = F.when(ending == "md", "text/markdown").when(ending.isin("adoc", "asciidoc"), "text/asciidoc").when(ending == "csv", "text/csv").otherwise("text/plain")
    return F.when(F.coalesce(head, F.lit("")) == "", F.lit(None)).when(head.startswith("%PDF-"), "application/pdf").when(start.startswith("<!doctype html") | start.startswith("<html"), "text/html").when(start.startswith("<?xml"), "application/xml").when(F.instr(head, "\x00") > 0, F.lit(None)).otherwise(text)


def replace_chunks(stored: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """The chunk table after the fresh documents' chunks took the place of their old ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
