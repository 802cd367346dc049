"""Document quality rules with DataFrame functions only: one narrow pass, no shuffle, no Python.

Beside counting rules, a document's character classes and common words are compared with
references of its language by the Jensen-Shannon distance (base 2, so 0 to 1). A sample of n from
k kinds lies about sqrt((k - 1) / (8 n ln 2)) from what it is drawn from, so a limit is that and what
a text may differ by besides; each distance rejects on its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_store import fields, whole

# Shares of character classes (letters, digits, spaces, sentence marks, anything else) in running prose.
CLASS_SHARES = {
    "en": (0.800, 0.006, 0.165, 0.026, 0.003),
    "fr": (0.800, 0.006, 0.160, 0.030, 0.004),
    "de": (0.825, 0.006, 0.140, 0.026, 0.003),
    "es": (0.805, 0.006, 0.160, 0.026, 0.003),
}
# The commonest words of running prose and their shares, about, in thousandths.
COMMON_WORDS = {
    "en": {"the": 62, "of": 30, "and": 29, "to": 26, "in": 21, "a": 21, "is": 11, "that": 11, "for": 9, "it": 9, "as": 8, "was": 8},
    "fr": {"de": 48, "la": 28, "le": 22, "et": 22, "les": 19, "des": 16, "en": 14, "un": 11, "du": 11, "une": 10, "que": 10, "dans": 9},
    "de": {"der": 30, "die": 30, "und": 27, "in": 18, "den": 12, "von": 11, "zu": 10, "das": 10, "mit": 9, "sich": 8, "des": 8, "auf": 7},
    "es": {"de": 60, "la": 37, "que": 29, "el": 28, "en": 26, "y": 25, "a": 20, "los": 17, "se": 13, "del": 12, "las": 11, "un": 10},
}
#: Largest distances that pass, beside the noise of a sample of the text's size.
MOST_CLASS_DISTANCE = 0.13
MOST_WORD_DISTANCE = 0.20
#: Guards: shorter texts aren't judged by that distance.
LEAST_CLASS_CHARS = 200
LEAST_COMMON_WORDS = 80

#: Bits of a window's hash that aren't looked at, beside those that its place takes (more in tests).
SPARE_BITS = 0

SPACES = r"[\x20\x09-\x0D]+"


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that sum to 1 (arrays of equal length)."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _by_language(lang: Column, tables: dict, make) -> Column:
    """What ``make`` gives for the language's table; null for any other language."""
    out = F.lit(None)
    for name, entry in tables.items():
        out = F.when(lang == name, make(entry)).otherwise(out)
    return out


def noise(kinds: int, size: Column) -> Column:
    """Distance that a sample of this size is expected to have from its source by chance."""
    return F.sqrt(F.lit((kinds - 1) / (8 * math.log(2))) / size)


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds to each document row what the rules look at, and their verdict.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint),
    class_distance, word_distance (double; null where a guard or an unknown or null language
    leaves them out), base_failed, kept (boolean). A null text counts as empty, so it fails.
    Rows stay as they are, repeated ones too; columns with the names of added ones are replaced.
    """
    return _signals(docs, text_col, lang_col).select(*fields(docs, [c for c in docs.columns if c not in ADDED]), *ADDED)


def _signals(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """doc (all columns of docs) and ADDED."""
    text, lang = F.col("_text"), F.col("_lang")
    df = docs.select(whole(docs), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(lang_col).alias("_lang"))
    df = df.withColumn("_w", F.array_remove(F.split(text, SPACES), "")).withColumn("_n", F.size("_w"))
    # equal 3-word windows: (hash, position) packed in a bigint and sorted, so that equal ones are neighbours
    low = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ceil(F.log2(F.col("_n") + F.lit(2))).cast("int") + SPARE_BITS) - 1
    df = df.withColumn("_low", low)
    w, mask = F.col("_w"), F.col("_low")
    window = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint"))
    df = df.withColumn("_h", F.transform(F.slice(w, F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0))), window))
    df = df.withColumn("_h", F.sort_array("_h"))
    h = F.col("_h")

    def near(x: Column, y: Column) -> Column:
        return x.bitwiseXOR(y).bitwiseAND(F.bitwise_not(mask)) == 0

    def equal(x: Column, y: Column) -> Column:
        i, j = (z.bitwiseAND(mask).cast("int") for z in (x, y))
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    same = lambda x, y: F.coalesce(near(x, y) & equal(x, y), F.lit(False))
    by_hash = F.transform(F.filter(h, lambda x, i: same(x, F.get(h, i + 1)) | same(x, F.get(h, i - 1))), lambda x: x.bitwiseAND(mask))
    # where the bits that are left of a hash don't tell two windows apart, windows are sorted by their words
    clash = F.exists(F.transform(h, lambda x, i: F.coalesce(near(x, F.get(h, i + 1)) & ~equal(x, F.get(h, i + 1)), F.lit(False))), lambda x: x)
    spelled = F.sort_array(F.transform(F.slice(w, F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.cast("bigint").alias("i"))))
    df = df.withColumn("_g", F.when(clash, spelled))
    g = F.col("_g")
    by_words = F.transform(F.filter(g, lambda x, i: F.coalesce(x["g"] == F.get(g, i + 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(g, i - 1)["g"], F.lit(False))), lambda x: x["i"])
    df = df.withColumn("_at", F.sort_array(F.when(g.isNotNull(), by_words).otherwise(by_hash)))
    covered = F.aggregate("_at", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).cast("bigint").alias("at")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).cast("bigint").alias("n"), x.cast("bigint").alias("at")), lambda a: a["n"])

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    # classes: what is left after taking away letters, then spaces, digits and sentence marks
    df = df.withColumn("_r", F.regexp_replace(text, r"\p{L}+", "")).withColumn("_r1", F.regexp_replace("_r", SPACES, ""))
    df = df.withColumn("_r2", F.regexp_replace("_r1", "[0-9]+", "")).withColumn("_r3", F.regexp_replace("_r2", r"[.,;:!?'\"()\u00BF\u00A1\u2019\u2013-]+", ""))
    chars = F.char_length(text)
    left = [chars, *(F.char_length(c) for c in ("_r", "_r1", "_r2", "_r3"))]
    # letters, spaces, digits, marks, others, in the order of CLASS_SHARES
    n_letters, n_spaces, n_digits, n_marks = (a - b for a, b in zip(left, left[1:], strict=False))
    classes = F.transform(F.array(n_letters, n_digits, n_spaces, n_marks, left[4]), lambda x: x / chars)
    shares = _by_language(lang, CLASS_SHARES, lambda q: F.array(*map(F.lit, q)))
    df = df.withColumn("class_distance", F.when((chars >= LEAST_CLASS_CHARS) & shares.isNotNull(), js_distance(classes, shares)))

    df = df.withColumn("_z", F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "  "), F.lit(" ")))
    df = df.withColumn("_t", (F.char_length("_z") - F.char_length(F.replace("_z", F.lit("  "), F.lit(" ")))) + 1)
    z, total = F.col("_z"), F.col("_t")

    def words_of(entry: dict) -> Column:
        counts = [(F.octet_length(z) - F.octet_length(F.replace(z, F.lit(f" {v} "), F.lit("")))) / F.lit(len(f" {v} ".encode())) for v in entry]
        return F.transform(F.array(*counts), lambda x: x / total)

    counted = _by_language(lang, COMMON_WORDS, words_of)
    df = df.withColumn("_p", counted)
    reference = _by_language(lang, COMMON_WORDS, lambda e: F.array(*(F.lit(x / 1000) for x in e.values())))
    rest = lambda a: F.concat(a, F.array(F.greatest(F.lit(0.0), 1 - F.aggregate(a, F.lit(0.0), lambda s, x: s + x))))
    df = df.withColumn("word_distance", F.when((total >= LEAST_COMMON_WORDS) & F.col("_p").isNotNull(), js_distance(rest(F.col("_p")), rest(reference))))

    long = lambda c: c.cast("bigint")
    df = df.withColumns(
        {
            "n_words": long(F.col("_n")),
            "word_chars": long(chars - n_spaces),
            "n_symbols": long(F.char_length("_r3") - F.char_length(F.regexp_replace("_r3", r"[#*$%&|<>]", ""))),
            "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
            "n_repeat_words": long(covered),
        }
    )
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    within = lambda c, most, kinds, size: F.coalesce(F.col(c) <= most + noise(kinds, size), F.lit(True))
    alike = within("class_distance", MOST_CLASS_DISTANCE, 5, chars) & within("word_distance", MOST_WORD_DISTANCE, 13, total)
    df = df.withColumn("kept", ~F.col("base_failed") & alike)
    # behind an explode: Catalyst would put a filter on a signal, with each signal that it is made of written out
    # wherever it is used, below the projections that compute signals once
    return df.select("doc", F.explode(F.array(F.struct(*ADDED))).alias("q")).select("doc", *[F.col("q").getField(c).alias(c) for c in ADDED])


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns; rows with null texts fail, repeated rows stay."""
    return _signals(docs, text_col, lang_col).filter("kept").select(*fields(docs))
