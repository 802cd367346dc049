"""Benchmark decontamination with DataFrame functions only.

The n-grams of the benchmark are one hash table on every executor while their bytes stay within
``BROADCAST_BYTES``; beyond it, hashes of windows are dealt and joined. Each document's token
windows are looked up by hash, and a hit counts only if the words themselves are equal. Documents
go, or the words of their hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Bytes of the benchmark's n-grams and their items' ids up to which their table is broadcast.
BROADCAST_BYTES = 64 << 20
#: What separates words once A-Z is in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text whose A-Z aren't in lower case yet.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """Lower-cases A-Z only and splits at every ASCII character but letters and digits; null has no words."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def benchmark_grams(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """gram_hash, gram (array of words), items (ids of the items that have it, as strings; "" for null)."""
    words = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), normal_words(F.col("text")).alias("w"))
    words = words.withColumn("len", F.least(F.lit(window), F.size("w"))).filter("len > 0")
    grams = words.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    grams = grams.select("item", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("gram_hash"), "gram", "items")


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, pos, stop (words, from 0), items for each window of a document that is one of the benchmark's.

    text_key, a hash of the text, tells rows of one id apart; repeated rows give equal rows. Null
    and empty texts give none.
    """
    grams = benchmark_grams(benchmark, window)
    held = F.sum(F.aggregate(F.concat("gram", "items"), F.lit(0), lambda n, x: n + F.octet_length(x) + 16) + 64)
    found = grams.agg(F.sort_array(F.collect_set(F.size("gram"))).alias("sizes"), F.coalesce(held, F.lit(0)).alias("bytes")).first()  # at most `window` sizes
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), normal_words(F.col(text_col)).alias("w"))
    gram, stop = F.slice("w", F.col("pos") + 1, F.col("len")), F.col("pos") + F.col("len")

    def windows(rows: DataFrame) -> DataFrame:
        """A row for each window: with w, which only passes through a chain of narrow operators."""
        each = rows.withColumn("len", F.explode(F.array(*map(F.lit, found.sizes)))) if len(found.sizes) > 1 else rows.withColumn("len", F.lit(found.sizes[0] if found.sizes else window))
        last = F.size("w") - F.col("len")
        return each.withColumn("pos", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))

    if found.bytes <= BROADCAST_BYTES:
        hits = windows(base).withColumn("h", F.xxhash64(gram)).join(F.broadcast(grams), F.col("h") == F.col("gram_hash")).filter(F.col("gram") == gram)
        return hits.select("id", "text_key", "pos", stop.alias("stop"), "items")
    # only hashes are dealt; the few hits come back to their texts and are compared there
    dealt = windows(base).select("id", "text_key", "pos", "len", F.xxhash64(gram).alias("gram_hash"))
    near = dealt.join(grams, "gram_hash").groupBy("id", "text_key").agg(F.collect_set(F.struct("pos", "len", "gram", "items")).alias("near"))
    near = near.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "near")
    back = base.join(near, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    hits = back.select("id", "text_key", F.explode(F.filter("near", lambda x: F.slice(F.col("w"), x["pos"] + 1, x["len"]) == x["gram"])).alias("x"))
    return hits.select("id", "text_key", "x.pos", (F.col("x.pos") + F.col("x.len")).alias("stop"), "x.items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, text_key, n_words, n_hit, n_items, item_ids, contaminated.

    Null and empty texts have no words and no hits. Rows that are repeated or share an id are
    kept apart by text_key (a hash of the text), and each has its own row. Empty tables
    give no rows, or no hits. Further columns of either table aren't read.
    """
    hits = contaminated_spans(docs, benchmark, window, id_col, text_col)
    by_doc = hits.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.sort_array(F.collect_set(F.struct("pos", "stop"))).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["pos"], a["stop"]))).alias("n"), F.greatest(a["stop"], x["stop"]).alias("stop")),
        lambda a: a["n"].cast("bigint"),
    )
    by_doc = by_doc.select("_id", "_key", covered.alias("n_hit"), "item_ids")
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), F.size(normal_words(F.col(text_col))).cast("bigint").alias("n_words"))
    out = keyed.join(by_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_outer")
    items = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("item_ids"), F.col("_key").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns; null texts stay."""
    bad = contaminated_spans(docs, benchmark, window, id_col, text_col).select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = docs[id_col].eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["_key"])
    return docs.join(bad, same, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, without the words that a benchmark window covers; what stands between words stays.

    Their other columns stay, but for n_chars, which counts the new text's code points where it changed.
    Only documents with a hit are cut into words and put together again, each by its own rows.
    """
    hits = contaminated_spans(docs, benchmark, window, id_col, text_col)
    gone = hits.select("id", "text_key", F.explode(F.sequence(F.col("pos"), F.col("stop") - 1)).alias("i")).distinct()
    keys = gone.select(F.col("id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), F.col(text_col).alias("text"))
    texts = texts.join(keys, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi").dropDuplicates(["id", "text_key"])
    # what stands before each word, with the word; the last entry has no word
    pieces = texts.select("id", "text_key", F.posexplode(F.arrays_zip(F.split("text", WORD).alias("gap"), F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("word"))).alias("i", "piece"))
    gone = gone.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("i").alias("_i"))
    pieces = pieces.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")) & (F.col("i") == F.col("_i")), "left_outer")
    left = F.concat(F.col("piece.gap"), F.when(F.col("_i").isNull(), F.coalesce("piece.word", F.lit(""))).otherwise(F.lit("")))
    made = pieces.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_list(F.struct("i", left.alias("t")))).alias("ts"))
    made = made.select("_id", "_key", F.array_join(F.col("ts.t"), "").alias("_new"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"))
    own = own.join(made, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_outer")
    types = dict(docs.dtypes)

    def column(c: str) -> Column:
        old = F.col("doc").getField(c)
        new = {text_col: F.col("_new"), "n_chars": F.char_length("_new").cast(types[c])}.get(c)
        return old.alias(c) if new is None else F.coalesce(new, old).alias(c)

    return own.select(*map(column, docs.columns))
