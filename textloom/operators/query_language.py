"""Search texts with operators: phrases, exclusions and OR, as Columns over lexemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import lexemes

# A quoted phrase, a word behind a minus, the bare word OR.
OPERATORS = r'"[^"]+"|(^|\s)-\w|(?i:(^|\s)or(\s|$))'
_TERM = r'(-?"[^"]*"?|\S+)'


def has_operators(text: Column) -> Column:
    """Whether a text looks like operator syntax ("or" as a plain word does too)."""
    return text.rlike(OPERATORS)


def clauses(text: Column) -> Column:
    """Alternatives between bare ORs, each an array of (negated, lexemes), all of which must hold. Never fails: odd input is plain terms."""
    terms = F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(1)), lambda t: F.struct((F.lower(t) == "or").alias("split"), (t.startswith("-") & (F.length(t) > 1)).alias("negated"), lexemes(t).alias("lexemes")))
    none = F.array().cast("array<array<struct<negated:boolean,lexemes:array<string>>>>")
    start = F.struct(none.alias("done"), F.array().cast("array<struct<negated:boolean,lexemes:array<string>>>").alias("open"))
    step = lambda a, t: F.when(t["split"], F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), F.array().cast("array<struct<negated:boolean,lexemes:array<string>>>").alias("open"))).when(
        F.size(t["lexemes"]) == 0, a
    ).otherwise(F.struct(a["done"].alias("done"), F.concat(a["open"], F.array(F.struct(t["negated"].alias("negated"), t["lexemes"].alias("lexemes")))).alias("open")))
    every = F.aggregate(terms, start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return F.filter(every, lambda group: F.size(group) > 0)


def matches(parsed: Column, body: Column) -> Column:
    """Whether some alternative holds in a text's lexemes (body); a phrase's lexemes stand side by side. Without alternatives nothing matches."""
    spoken = F.concat(F.lit(" "), F.array_join(body, " "), F.lit(" "))
    holds = lambda t: F.contains(spoken, F.concat(F.lit(" "), F.array_join(t["lexemes"], " "), F.lit(" "))) != t["negated"]
    return F.exists(parsed, lambda group: F.forall(group, holds))


def web_search(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, document_id: each owner's queries (query_id, user_id, text) on that owner's documents (document_id, user_id, text).

    Every query meets every document of its owner, so this is for few of either; text_index.search_phrases gives the same by postings.
    """
    asked = queries.select("query_id", "user_id", clauses(F.col("text")).alias("parsed"))
    held = documents.select("document_id", "user_id", lexemes(F.col("text")).alias("body"))
    return held.join(asked, "user_id").filter(matches(F.col("parsed"), F.col("body"))).select("query_id", "document_id")
