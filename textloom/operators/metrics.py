"""Retrieval metrics over long ranked lists (case_id, stage, rank, chunk_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import words

#: Bins of a group's values.
BINS = 256
KS = (1, 3, 5, 10, 20)


def rank_metrics(ranked: DataFrame, gold: DataFrame, ks=KS) -> DataFrame:
    """case_id, stage, k and hit, precision, recall, mrr, ndcg; all null for a case without gold (one aggregation)."""
    sizes = gold.select("case_id", "chunk_id").distinct().groupBy("case_id").agg(F.count(F.lit(1)).alias("n_gold"))
    marked = ranked.join(gold.select("case_id", "chunk_id", F.lit(1).alias("is_gold")).distinct(), ["case_id", "chunk_id"], "left_outer")
    marked = marked.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    good = (F.col("rank") <= F.col("k")) & F.col("is_gold").isNotNull()
    m = marked.groupBy("case_id", "stage", "k").agg(
        F.count_if(good).alias("hits"),
        F.count_distinct(F.when(good, F.col("chunk_id"))).alias("distinct_hits"),
        F.min(F.when(good, F.col("rank"))).alias("first"),
        F.sum(F.when(good, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    m = m.join(sizes, "case_id", "left_outer")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.col("k"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    known = lambda c: F.when(F.col("n_gold").isNotNull(), c)
    return m.select(
        "case_id",
        "stage",
        "k",
        known((F.col("hits") > 0).cast("double")).alias("hit"),
        known(F.col("hits") / F.col("k")).alias("precision"),
        known(F.col("distinct_hits") / F.col("n_gold")).alias("recall"),
        known(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        known(F.col("dcg") / ideal).alias("ndcg"),
    )


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """stage, metric, k: mean, median, min, max, n over cases, nulls left out."""
    names = ["hit", "precision", "recall", "mrr", "ndcg"]
    long = metrics.unpivot(["case_id", "stage", "k"], names, "metric", "value").filter("value is not null")
    return long.groupBy("stage", "metric", "k").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.median("value"), 4).alias("median"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("most"), F.count(F.lit(1)).alias("n"))


def latency_stats(samples: DataFrame, by: str, value: str) -> DataFrame:
    """mean, p50, p95 (the element at index int(0.95 n) of the sorted values) and most, one decimal.

    A group's different values are dealt to BINS between approximate quantiles, which hold about as many of them
    each, whatever outliers there are; only those of the bins with a wanted place are ordered, each bin by
    itself, so no group is sorted or counted by one task.
    """
    known = samples.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    cuts = F.percentile_approx(value, [k / BINS for k in range(1, BINS)], 10 * BINS).alias("cuts")
    sizes = known.groupBy(by).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"), F.max(value).alias("most"), cuts)
    binned = known.join(sizes, by).withColumn("bin", F.size(F.filter("cuts", lambda x: x < F.col(value)))).drop("cuts")
    bins = binned.groupBy(by, "bin").agg(F.sum("c").alias("s"), F.first("n").alias("n"))
    bins = bins.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = F.col("n")
    places = {"low": F.floor((n - 1) / 2), "high": F.ceil((n - 1) / 2), "late": F.floor(n * 0.95)}
    wanted = bins.filter(F.array_max(F.array(*[((i >= F.col("before")) & (i < F.col("before") + F.col("s"))).cast("int") for i in places.values()])) == 1)
    near = binned.join(wanted.select(by, "bin", "before"), [by, "bin"])
    near = near.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(by, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    has = {k: F.max(F.when((i < F.col("upto")) & (i >= F.col("upto") - F.col("c")), F.col(value))) for k, i in places.items()}
    found = near.groupBy(by).agg(((has["low"] + has["high"]) / 2).alias("p50"), has["late"].alias("p95"), F.first("mean").alias("mean"), F.first("most").alias("most"), F.first("n").alias("n"))
    return found.select(by, F.round("mean", 1).alias("mean"), F.round("p50", 1).alias("p50"), F.round("p95", 1).alias("p95"), F.round("most", 1).alias("most"), "n")


def token_f1(pairs: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Adds f1 of the sets of lower-case words; 0 where either is empty."""
    p, r = F.array_distinct(words(F.lower(F.col(prediction)))), F.array_distinct(words(F.lower(F.col(reference))))
    both = F.size(F.array_intersect(p, r))
    return pairs.withColumn("f1", F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(r))))


def lift(aggregated: DataFrame, before: str, after: str) -> DataFrame:
    """metric, k, lift: the mean of one stage less that of another; a missing mean counts as 0."""
    one = aggregated.groupBy("metric", "k").pivot("stage", [before, after]).agg(F.first("mean"))
    return one.select("metric", "k", F.round(F.coalesce(F.col(f"`{after}`"), F.lit(0.0)) - F.coalesce(F.col(f"`{before}`"), F.lit(0.0)), 4).alias("lift"))
