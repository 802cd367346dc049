"""License scans with DataFrame functions only: Dice coefficient over word bigrams.

A template is compared with windows of a text as long as itself (in words; shorter at the text's
ends) by the Dice coefficient of their sets of word bigrams. A set of b bigrams can only reach a
threshold t with one of a if a * t / (2 - t) <= b <= a * (2 - t) / t, and then has at least
a * t / (2 - t) of the a. So it has one of any a - ceil(a * t / (2 - t)) + 1 of them: these, the
ones of most letters, are the template's anchors. The anchors of all templates are one broadcast
table, bounded by the list of templates. Each place of a text whose bigram is an anchor aligns the
template with the text, and the window there is compared. (A text whose words were moved inside a window may
be compared at a place a few words off.)
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

LEAST_DICE = 0.7
#: Licences whose notice is so short that it counts only in a text that names no other licence, as a line of its own
#: (behind a copyright notice at most). Other licences' files and plain prose hold the same words.
LONE = "Proprietary"
LONE_LINE = r"(?i)(^|\n)[^\p{L}\p{N}\n]*((copyright|\(c\)|©)[^\n]*)?all rights reserved[^\p{L}\p{N}\n]*(\n|$)"


def least_bigrams(n: int, least: float) -> int:
    """Bigrams of which a set must have at least so many to reach ``least`` with a set of n."""
    return max(1, math.ceil(n * least / (2 - least) - 1e-9))


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(words: list[str], least: float) -> list[int]:
    """Offsets of a template's anchors: all places of the bigrams that were chosen."""
    places: dict[tuple[str, str], list[int]] = {}
    for k, pair in enumerate(zip(words, words[1:], strict=False)):
        places.setdefault(pair, []).append(k)
    chosen = sorted(places, key=lambda p: (-len(p[0] + p[1]), p))[: len(places) - least_bigrams(len(places), least) + 1]
    return sorted(k for p in chosen for k in places[p])


def anchor_table(spark: SparkSession, least: float = LEAST_DICE, templates=TEMPLATES) -> DataFrame:
    """A row for each anchor: code (hash of its bigram), template, license, offset, body (the words), length, earlier (offsets before it), grams, n_grams."""
    rows = []
    for k, (name, text) in enumerate(templates):
        words = template_words(text)
        found = anchors(words, least)
        rows += [(k, name, at, words, found[:n]) for n, at in enumerate(found)]
    made = spark.createDataFrame(rows, "template int, license string, offset int, body array<string>, earlier array<int>")
    made = made.withColumn("grams", bigrams(F.col("body"))).withColumn("n_grams", F.size("grams")).withColumn("length", F.size("body"))
    return made.withColumn("code", F.xxhash64(F.get("body", F.col("offset")), F.get("body", F.col("offset") + 1)))


def bigrams(words: Column) -> Column:
    """The set of word bigrams."""
    after = F.slice(words, F.lit(2), F.size(words))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(after)), after, lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def license_spans(docs: DataFrame, least: float = LEAST_DICE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, template, license, start, stop (words, from 0), dice: the windows that reach ``least``.

    Words are lower-case runs of letters and digits, so markup, indents and line ends don't count. Each alignment of a template is
    one row, also where several anchors give it. Null and empty texts, and those of one word, give none;
    repeated rows give equal rows. text_key, a hash of the text, tells rows of one id apart.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "").alias("w"))
    places = F.when(F.size("w") > 1, F.sequence(F.lit(0), F.size("w") - 2))
    at = base.select("id", "text_key", "w", F.explode(places).alias("pos"))
    at = at.withColumn("code", F.xxhash64(F.get("w", F.col("pos")), F.get("w", F.col("pos") + 1)))
    hits = at.join(F.broadcast(anchor_table(spark, least, templates)), "code").withColumn("begin", F.col("pos") - F.col("offset"))
    hits = hits.withColumn("start", F.greatest(F.col("begin"), F.lit(0))).withColumn("stop", F.least(F.col("begin") + F.col("length"), F.size("w")))
    hits = hits.filter((F.col("stop") - F.col("start") - 1) * (2 - least) >= F.col("n_grams") * least - 1e-9)
    # behind an explode, so that Catalyst puts what needs lambdas not into the join, which would
    # then copy the whole text for each place, but behind it, where only windows are left
    window = F.struct("begin", "start", "stop", F.slice("w", F.col("start") + 1, F.col("stop") - F.col("start")).alias("words"))
    hits = hits.select("id", "text_key", "template", "license", "body", "earlier", "grams", "n_grams", F.explode(F.array(window)).alias("at"))
    word = lambda k: F.get("at.words", F.col("at.begin") - F.col("at.start") + k)
    same = lambda k: F.coalesce((word(k) == F.get("body", k)) & (word(k + 1) == F.get("body", k + 1)), F.lit(False))
    # the first anchor that aligns a window stands for it
    hits = hits.filter(~F.exists("earlier", lambda k: (F.col("at.begin") + k >= F.col("at.start")) & same(k)))
    window = bigrams(F.col("at.words"))
    hits = hits.select("id", "text_key", "template", "license", "at.start", "at.stop", "grams", "n_grams", window.alias("found"))
    dice = 2 * F.size(F.array_intersect("found", "grams")) / (F.size("found") + F.col("n_grams"))
    return hits.withColumn("dice", dice).filter(F.col("dice") >= least).select("id", "text_key", "template", "license", "start", "stop", "dice")


def license_summary(docs: DataFrame, least: float = LEAST_DICE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its id, licenses (sorted, distinct), n_license_words (bigint), best_dice.

    A word belongs to the best window over it (largest coefficient, then first template, first start, last end); a
    window counts if at least half of its words belong to it, so that a licence isn't taken for
    another one like it. Documents without such a window have an empty list, 0 and 0.0; so have null texts. Rows
    that are repeated or share an id are kept apart by their texts, and each has its own row. LONE counts only where
    no other licence does, and on a line of its own.
    """
    spans = license_spans(docs, least, templates, id_col, text_col)
    words = spans.withColumn("word", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    best = words.groupBy("id", "text_key", "word").agg(F.max(F.struct("dice", (-F.col("template")).alias("t"), (-F.col("start")).alias("s"), "stop", "license")).alias("b"))
    own = best.groupBy("id", "text_key", "b").agg(F.count(F.lit(1)).alias("n")).filter(2 * F.col("n") >= F.col("b.stop") + F.col("b.s"))
    lone = F.col("b.license") == LONE
    sums = lambda which: F.struct(F.sort_array(F.collect_set(F.when(which, F.col("b.license")))).alias("licenses"), F.sum(F.when(which, F.col("n"))).alias("n"), F.max(F.when(which, F.col("b.dice"))).alias("best"))
    by_doc = own.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(sums(~lone).alias("others"), sums(lone).alias("lone"))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("text_key"), F.coalesce(F.col(text_col).rlike(LONE_LINE), F.lit(False)).alias("reserved"))
    out = keyed.join(by_doc, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_outer")
    found = F.when(F.size("others.licenses") > 0, F.col("others")).when(F.col("reserved"), F.col("lone"))
    out = out.select("id", found.alias("found"))
    return out.select(F.col("id").alias(id_col), F.coalesce("found.licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("found.n", F.lit(0)).cast("bigint").alias("n_license_words"), F.coalesce("found.best", F.lit(0.0)).alias("best_dice"))
