"""URL filters: rules on hosts and paths, found by hash prefixes of a URL's expressions.

A rule is a host and the beginning of a path; it fits the URLs of its host and of all subdomains
whose path begins so. Every URL is expanded into the expressions a rule could have: the last
labels of its host with the first characters of its path, for the pairs of label count and path
length (shapes) that the rules have. Expressions meet rules by a short prefix of their SHA-256
digests; the full digests confirm. Of the rules that fit, the longest decides (host and path
together, then the host); where one rule both allows and blocks, it blocks.

All of it is DataFrame functions. A rule is named within a URL by its two lengths, so a match is one
number, and only these numbers are aggregated. Rules up to BROADCAST_BYTES go to the expressions;
beyond that each rule is copied to SALTS buckets, among which the expressions of a host with a third
of all rows spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared_store import fields, numbered

#: Hex digits of a digest that rows are joined on.
PREFIX_DIGITS = 8
#: Bytes of hosts and paths of the rules, with RULE_BYTES for each besides, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
RULE_BYTES = 160
SALTS = 16
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """verdict (allow or block), host, path of rules given as such triples."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash sign or the end, A-Z in lower case; "" for null or no ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash sign or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ://."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _distinct_rules(rules: DataFrame) -> DataFrame:
    """Rules as host, path, block, shape; those without a host or a path, or with another verdict, are an error."""
    verdict = F.when(F.col("verdict").isin("allow", "block") & F.col("host").isNotNull() & F.col("path").isNotNull(), F.col("verdict") == "block")
    checked = F.coalesce(verdict, F.raise_error(F.lit("a rule needs a host, a path and a verdict, allow or block")).cast("boolean"))
    host = F.translate("host", _UPPER, _LOWER)
    kept = rules.select(host.alias("host"), "path", checked.alias("block")).groupBy("host", "path").agg(F.bool_or("block").alias("block"))
    return kept.withColumn("shape", F.struct(_labels(F.col("host")).alias("labels"), F.length("path").alias("chars")))


def expressions(host: Column, path: Column, shapes: Column) -> Column:
    """(host_chars, path_chars) of the host suffixes and path prefixes of a URL in these shapes (array of labels, chars)."""
    fit = F.filter(shapes, lambda s: (s["labels"] <= _labels(host)) & (s["chars"] <= F.length(path)))
    return F.transform(fit, lambda s: F.struct(F.length(F.call_function("substring_index", host, F.lit("."), F.negative(s["labels"]))).alias("host_chars"), s["chars"].alias("path_chars")))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """All columns of pages in ``page``, with host, path, rule (null if none fits) and verdict of each URL; one row for each row.

    rules: verdict, host, path; their host is compared in lower case, their path as it is; repeated
    rules count once. Null URLs and those without :// have an empty host and path. Repeated rows
    are judged alike, empty tables give no rows, and columns of any name pass in ``page``.
    """
    own = _distinct_rules(rules)
    shapes = own.agg(F.collect_set("shape").alias("shapes")).scalar()  # one value, bounded by label counts x path lengths of the rules
    rows = numbered(pages)
    of = F.col("doc").getField(url)
    parts = rows.select("_row", host_of(of).alias("host"), path_of(of).alias("path"), shapes.alias("shapes"))
    found = parts.select("_row", "host", "path", F.explode(expressions(F.col("host"), F.col("path"), F.col("shapes"))).alias("e")).select(
        "_row", "e.host_chars", "e.path_chars", F.sha2(F.concat(_suffix("host", "e.host_chars"), F.lit("\n"), _first("path", "e.path_chars")), 256).alias("digest")
    )
    prefix = F.left("digest", F.lit(PREFIX_DIGITS)).alias("prefix")
    known = own.select(F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("digest"), "block")
    keyed, salted = known.select(prefix, F.col("digest").alias("full"), "block"), found.select("*", prefix)
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + RULE_BYTES), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        met = salted.join(F.broadcast(keyed), "prefix")
    else:
        keyed = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")).join(keyed, ["prefix", "salt"])
    # host and path together first, then the host, then block before allow, in one number
    rank = F.shiftleft((F.col("host_chars") + F.col("path_chars")).cast("bigint"), 32) + F.shiftleft(F.col("host_chars").cast("bigint"), 1) + F.col("block").cast("bigint")
    best = met.filter("digest = full").groupBy("_row").agg(F.max(rank).alias("best"))
    out = rows.join(best, "_row", "left_outer").select(F.col("doc").alias("page"), host_of(of).alias("host"), path_of(of).alias("path"), F.shiftright("best", 32).cast("int").alias("chars"), (F.shiftright("best", 1).bitwiseAND((1 << 31) - 1)).cast("int").alias("host_chars"), (F.col("best") % 2).alias("block"))
    rule = F.concat(_suffix("host", "host_chars"), _first("path", "chars - host_chars"))
    return out.select("page", "host", "path", rule.alias("rule"), F.when(F.col("block") == 1, "block").when(F.col("block") == 0, "allow").otherwise(default).alias("verdict"))


def _suffix(text: str, n: str) -> Column:
    return F.expr(f"substring({text}, length({text}) - {n} + 1, {n})")


def _first(text: str, n: str) -> Column:
    return F.expr(f"substring({text}, 1, {n})")


def keep_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The rows of pages whose URL is allowed, with their own columns."""
    judged = judge_urls(pages, rules, url, default).filter("verdict = 'allow'")
    return judged.select(F.col("page").alias("doc")).select(*fields(pages))
