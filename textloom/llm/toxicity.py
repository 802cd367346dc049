"""Toxicity scores by non-negative positive-unlabelled learning.

A linear scorer over hashed words and character n-grams is fitted from texts confirmed as toxic (P)
and any texts, taken as unlabelled (U), with the risk

    pi * R_P(+1) + max(0, R_U(-1) - pi * R_P(-1))

where pi is the share of toxic texts and R the mean logistic loss. U is drawn from all texts, so it is
a mixture with a share pi of toxic ones, and the second term is the risk on the others, unbiased.
Where it falls below zero, the step goes the other way on it, so that the scorer can't gain by
pushing unlabelled texts below what the prior allows (Kiryo et al., 2017). Both sets are bounded, so
each step takes all of them. Features enter by the logarithm of how much more often they are in P
than in U; those of less than LEAST_RATIO stay out, as does what fewer than LEAST_TEXTS of P have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared_store import bounded_batches

#: Hashed features.
BITS = 18
#: Most documents that the model is fitted on: confirmed toxic, and any, taken as unlabelled.
MOST_POSITIVE = 2000
MOST_UNLABELLED = 3000
#: Character n-grams of words, beside whole words.
NGRAMS = (4, 5, 6)
EPOCHS = 30
#: Least logarithm of a feature's share in P to that in U, and least texts of P that have it.
LEAST_RATIO = 0.7
LEAST_TEXTS = 3
FOLDS = 5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all rows of a slice (distinct and sorted in each row) and their rows' starts.

    Words are runs of letters (bytes from 0x80 count as letters), A-Z in lower case.
    """
    starts, ends, first = ta.tokens(data, offsets, ta.NON_LETTERS)
    rows = len(offsets) - 1
    of = np.repeat(np.arange(rows), np.diff(first))
    found = [(of, ta.token_hashes(data, starts, ends, ta.ASCII_LOWER))]
    for n in NGRAMS:
        counts = np.maximum(ends - starts - n + 1, 0)
        cum = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(cum[-1]) - np.repeat(cum[:-1] - starts, counts)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + ta.ASCII_LOWER[data[at + k]]
        found.append((np.repeat(of, counts), ta.mix(h)))
    row = np.concatenate([r for r, _ in found])
    ids = np.concatenate([h >> np.uint64(64 - BITS) for _, h in found])
    keys = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | ids)
    row = (keys >> np.uint64(BITS)).astype(np.int64)
    return (keys & np.uint64((1 << BITS) - 1)).astype(np.int32), np.searchsorted(row, np.arange(rows + 1))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in ta.text_slices(batch.column("_text")):
            ids, starts = features(data, offsets)
            packed = pa.array([ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_toxic").slice(first, last - first), packed], names=["toxic", "ids"])


def nnpu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk for the scores (before the logistic function) of P and U; the second may be negative."""
    loss = lambda z, sign: float(np.mean(np.logaddexp(0, -sign * z))) if len(z) else 0.0
    return prior * loss(positive, 1), loss(unlabelled, -1) - prior * loss(positive, -1)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from the feature ids of each text of P and U."""
    size = 1 << BITS
    n_pos = np.bincount(np.concatenate([*positive, np.zeros(0, np.int32)]).astype(np.int64), minlength=size)
    n_unl = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int32)]).astype(np.int64), minlength=size)
    p_pos, p_unl = (n_pos + 0.5) / (len(positive) + 1), (n_unl + 0.5) / (len(unlabelled) + 1)
    telling = np.where(n_pos >= LEAST_TEXTS, np.log(p_pos / p_unl), 0.0)
    scale = np.where(telling > LEAST_RATIO, np.minimum(telling, 4.0), 0.0)
    keep = [x[scale[x] > 0] for x in [*positive, *unlabelled]]
    lengths = np.array([len(x) for x in keep])
    flat, row = np.concatenate([*keep, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(keep)), lengths)
    value = scale[flat]
    is_pos = np.arange(len(keep)) < len(positive)
    w, b = np.full(size, 0.05), float(np.log(prior / (1 - prior)))
    sums = [np.zeros(size), 0.0]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(epochs):
        rate = 1.0 / (1 + 0.1 * epoch)
        z = b + np.bincount(row, w[flat] * value, minlength=len(keep))
        s = sigmoid(z)
        g = np.zeros(len(keep))
        way = 1.0 if nnpu_risk(z[is_pos], z[~is_pos], prior)[1] >= 0 else -1.0
        g[is_pos] = prior * (-(1 - s[is_pos]) - way * s[is_pos]) / max(1, is_pos.sum())
        g[~is_pos] = way * s[~is_pos] / max(1, (~is_pos).sum())
        grad = np.bincount(flat, g[row] * value, minlength=size) + 1e-5 * w * (scale > 0)
        sums[0] += grad**2
        sums[1] += g.sum() ** 2
        w = w - rate * 0.3 * grad / (np.sqrt(sums[0]) + 1e-9)
        b = b - rate * 0.3 * g.sum() / (np.sqrt(sums[1]) + 1e-9)
    return np.where(scale > 0, w * scale, 0.0), b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Fits the scorer on document rows outside the held-out fold.

    Confirmed texts (P) are documents whose label says toxic, at most MOST_POSITIVE of them; unlabelled ones (U) are
    documents whatever their label says, if they have one, at most MOST_UNLABELLED, so a text may be in both. Which rows
    is settled by a hash of the id, so a run doesn't depend on how data lie; an id counts once, as toxic if any of its
    labels says so. The prior comes from all labels outside the fold. Null ids and null labels are left out. Without a
    positive text every score is the prior.
    """
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    n, p = counts["n"] or 0, counts["p"] or 0
    prior = min(0.9, max(0.01, p / n)) if n else 0.1
    toxic = known.filter(F.col("toxic") == 1).select(F.col(id_col).alias("_id")).distinct()
    ids = docs.select(F.col(id_col).alias("_id")).filter(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).distinct()
    pick = lambda of, flag, most: of.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", F.lit(flag).alias("_toxic"))
    both = pick(ids.join(toxic, "_id", "left_semi"), True, MOST_POSITIVE).unionByName(pick(ids, False, MOST_UNLABELLED))
    chosen = F.broadcast(both.groupBy("_id").agg(F.collect_set("_toxic").alias("_sets")))  # bounded by the two limits
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(chosen, "_id").dropDuplicates(["_id"])
    found = rows.select(F.explode("_sets").alias("_toxic"), "_text").mapInArrow(_featurise, "toxic boolean, ids binary").collect()
    positive, unlabelled = ([np.frombuffer(r.ids, np.int32) for r in found if r.toxic == flag] for flag in (True, False))
    if not positive or not unlabelled:
        return np.zeros(1 << BITS), float(np.log(prior / (1 - prior)))
    return fit(positive, unlabelled, prior)


def held_out(id_col) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS == 0


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row; null and empty texts score by the bias alone.

    The weights (2^BITS numbers, whatever the input) go to the executors once. A null id isn't held out.
    """
    bounded_batches(docs.sparkSession)
    used = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((used, weights[used].astype(np.float64), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, b = model.value
        w = np.zeros(1 << BITS)
        w[at] = value
        for batch in batches:
            for first, last, data, offsets in ta.text_slices(batch.column("_text")):
                ids, starts = features(data, offsets)
                cum = np.concatenate([[0.0], np.cumsum(w[ids])])
                z = b + cum[starts[1:]] - cum[starts[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, last - first), batch.column("_held").slice(first, last - first), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "held", "score"])

    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("_held"), F.col(text_col).alias("_text"))
    out = base.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, held boolean, score double")
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the labelled rows and scores every document row."""
    weights, bias = train(docs, labels, id_col, text_col)
    return score(docs, weights, bias, id_col, text_col)
