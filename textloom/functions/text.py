"""Text expressions as Column builders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_WIDTH = "[​‌‍﻿]"


#: Any white space of Unicode.
SPACES = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def _normal_forms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility normal form, in Arrow batches; a text that is in it already passes as it is."""
    return F.pandas_udf(_normal_forms, "string")(text)


def clean_text(text: Column) -> Column:
    """NFKC, no zero-width characters, one space for runs of spaces and tabs, at most two newlines, stripped."""
    out = F.regexp_replace(nfkc(text), ZERO_WIDTH, "")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def normal_query(text: Column) -> Column:
    """One space for runs of any white space, stripped; null for what is empty then."""
    out = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(out != "", out)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), "")


def lexemes(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order ("simple" configuration)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def token_estimate(token_count: Column, text: Column) -> Column:
    """The token count where it is not null or 0, else a quarter of the characters, at least 1."""
    return F.when(F.coalesce(token_count, F.lit(0)) != 0, token_count).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(text) / 4).cast("int")))


def page_label(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "n/a").when(first == last, F.concat(F.lit("p."), first.cast("string"))).otherwise(F.concat(F.lit("pp."), first.cast("string"), F.lit("-"), last.cast("string")))


def preview(text: Column, n: int) -> Column:
    return F.translate(F.substring(text, 1, n), "\n", " ")


def fingerprint_chain(configs: list[str]) -> list[Column]:
    """Chained fingerprints: each the first 16 hex digits of sha-256 over the one before and its stage's configuration."""
    out, before = [], F.lit("")
    for config in configs:
        before = F.left(F.sha2(F.concat_ws("|", before, F.lit(config)), 256), F.lit(16))
        out.append(before)
    return out
