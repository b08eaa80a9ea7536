"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk, a linear scorer in numpy.

Positives are texts marked 1; the unlabelled are texts at large, whatever their marks; marks 0 are never read. The class
prior is estimated from these two alone: a first scorer ranks both, and since every positive is among the unlabelled too,
the share of the unlabelled above any bound is at least the prior times the share of the positives above it. The least such
ratio over bounds that hold enough positives is the estimate. The risk is
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; while the bracket is negative, the step goes the other way. Features:
square roots of the frequencies of byte classes and of pairs of them, and the share of words that equal the word before,
over the whole text.

Training reads a bounded sample (``MAX_POSITIVE``, ``MAX_UNLABELLED`` rows, smallest hashes of their ids), only of rows
whose crc32(doc_id as text) mod 5 is not 0. Scoring covers every whole text, piece by piece (``PIECE`` bytes), so that a very
long one takes no more memory than its words' hashes. Null or empty texts have no features and get the score of the bias;
null ids never train. Ties of hashes go by id. With no positives or no unlabelled rows every score is 0.5; an empty table
gives none. Repeated label rows of a document count once (the largest mark); repeated rows are scored each. Other columns
are kept, and a column that has the score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import byte_spans, column, free_name, held_out, map_arrow, plus, slices, table
from streamloom.llm.words import word_hashes

MAX_POSITIVE, MAX_UNLABELLED = 2500, 5000
THRESHOLD = 0.3
#: Bytes whose pairs are counted at a time.
PIECE = 4 << 20
KINDS = 24
SIZE = KINDS + KINDS * KINDS + 1


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 22, np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r", "\t", ".", ",", "!", "?", ":;", "\"'", "-", "_", "()[]{}", "<>", "|", "#", "$%", "&", "*", "/\\"]
    for k, group in enumerate(groups):
        kind[list(group.encode())] = k
    kind[128:] = 23
    return kind


KIND = _byte_kinds()


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, SIZE), np.float32)
    if not len(raw):
        return out
    length = np.diff(offsets)
    per = np.maximum(length, 1)[:, None]
    single, pairs = np.zeros(n * KINDS, np.int64), np.zeros(n * KINDS * KINDS, np.int64)
    for at in range(0, len(raw), PIECE):
        end = min(at + PIECE + 1, len(raw))  # one byte more, for the pair across
        here = np.maximum(np.minimum(offsets[1:], end) - np.maximum(offsets[:-1], at), 0)
        row = np.repeat(np.arange(n, dtype=np.int32), here)  # a slice's counters fit: rows * 576 stays far below 2^31
        kind = KIND[raw[at:end]].astype(np.int32)
        single += np.bincount((row * KINDS + kind)[:PIECE], minlength=len(single))
        same = row[1:] == row[:-1]
        pairs += np.bincount(row[1:][same] * (KINDS * KINDS) + kind[:-1][same] * KINDS + kind[1:][same], minlength=len(pairs))
    out[:, :KINDS] = np.sqrt(single.reshape(n, KINDS) / per)
    out[:, KINDS:-1] = np.sqrt(pairs.reshape(n, -1) / per)
    h, of = word_hashes(raw, offsets)
    again = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    out[:, -1] = np.sqrt(np.bincount(of[1:][again], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    def __init__(self, mean, scale, weight, bias):
        self.mean, self.scale, self.weight, self.bias = mean, scale, weight, bias

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((x - self.mean) / self.scale @ self.weight + self.bias)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 3000, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Scorer:
    """Adam on the non-negative risk with the sigmoid loss."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.02
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(p.shape[1] + 1) for _ in range(3))
    for t in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        sp, su = sigmoid(xp @ w[:-1] + w[-1]), sigmoid(xu @ w[:-1] + w[-1])
        slope_p, slope_u = sp * (1 - sp) / batch, su * (1 - su) / batch
        if su.mean() - prior * sp.mean() >= 0:
            gp, gu = -2 * prior * slope_p, slope_u
        else:
            gp, gu = prior * slope_p, -slope_u
        g = np.append(gp @ xp + gu @ xu + decay * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Scorer(mean.astype(np.float32), scale.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]))


#: The least share of the positives that a bound of the prior's estimate must hold.
LEAST_SHARE = 0.25


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, as far as the ranking of a first scorer tells them apart."""
    first = fit_nnpu(positive[::2], unlabelled[::2], 0.5, steps=600)
    p, u = np.sort(first(positive[1::2])), np.sort(first(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    bounds = np.unique(np.quantile(p, np.linspace(0, 1 - LEAST_SHARE, 96)))
    above = lambda x: 1 - np.searchsorted(x, bounds) / len(x)
    share_p, share_u = above(p), (above(u) * len(u) + 0.5) / (len(u) + 1)
    ratio = share_u / np.maximum(share_p, LEAST_SHARE)
    # One standard error more keeps a chance gap among the unlabelled from passing for the prior.
    error = ratio * np.sqrt((1 - share_u) / (len(u) * share_u) + (1 - share_p) / (len(p) * np.maximum(share_p, LEAST_SHARE)))
    return float(np.clip(np.min(ratio + error), 0.01, 0.99))


def _feature_rows(df: DataFrame) -> DataFrame:
    """(part, x binary): float32 features of (part, text) rows, made where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x = features(*byte_spans(column(b, "text")))
            yield pa.RecordBatch.from_arrays([column(b, "part"), pa.array([r.tobytes() for r in x], pa.binary())], ["part", "x"])

    return map_arrow(df.select("part", "text"), run, "part int, x binary")


def _smallest(ids: DataFrame, n: int, most: int) -> DataFrame:
    """The ``most`` ids of smallest hashes. All but about 1.3 times as many go before the sort, so tasks send few rows."""
    luck = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1 << 40))
    return ids.filter(luck < int((1 << 40) * min(1.0, 1.3 * most / max(n, 1)))).orderBy(luck, "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """A scorer from a bounded sample of the training folds; None if a part of it is empty."""
    marks = labels.filter("quality = 1 AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    trusted = _smallest(marks, marks.count(), MAX_POSITIVE).select("doc_id", F.lit(1).alias("part"))
    web = _smallest(ids, ids.count(), MAX_UNLABELLED).select("doc_id", F.lit(0).alias("part"))
    # Both lists are bounded by the limits above, so they are broadcast.
    chosen = docs.sparkSession.createDataFrame([tuple(r) for part in (trusted, web) for r in part.collect()], "doc_id long, part int").distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = _feature_rows(sample).collect()
    parts = [np.frombuffer(b"".join(sorted(bytes(r.x) for r in rows if r.part == k)), np.float32).reshape(-1, SIZE) for k in (1, 0)]
    return fit_nnpu(parts[0], parts[1], estimate_prior(parts[0], parts[1])) if all(map(len, parts)) else None


def score(df: DataFrame, scorer: Scorer | None, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with each whole text's score, 0 to 1, in place of any column of that name."""
    df = df.drop(name)
    shipped, keep = df.sparkSession.sparkContext.broadcast(scorer), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for b in slices(batches, text_col):
            x = features(*byte_spans(column(b, text_col)))
            s = model(x).astype(np.float64) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*keep, name])

    return map_arrow(df, run, plus(df.schema, **{name: "double"}))


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text scores at least ``THRESHOLD``, with the same columns."""
    name = free_name(df, "score")
    return score(df, train(df, labels), name=name).filter(F.col(name) >= THRESHOLD).drop(name)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
