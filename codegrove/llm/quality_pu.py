"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled good; all documents are the unlabelled web text. The
class prior is estimated from the ratio of both densities where positives are dense, and a
small network minimises the non-negative unbiased risk: the negative part of the risk, estimated as
unlabelled minus prior times positive, is not let below zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, draw, store
from .textstats import COUNTS, RATIOS, text_stats

FEATURES = COUNTS + RATIOS
#: Positives and unlabelled rows the model is fitted on at most (smallest hashes of the id).
POSITIVE_ROWS, UNLABELLED_ROWS = 20_000, 40_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 24, 1500, 1024, 0.01, 1e-4


@dataclass
class Network:
    """Standardised features -> one hidden layer -> score."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def prepare(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([x, np.minimum(x * x, 25) / 4], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.prepare(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def squash(x: np.ndarray) -> np.ndarray:
    """Counts by their logarithm; ratios stay."""
    out = x.astype(np.float64).copy()
    out[:, : len(COUNTS)] = np.log1p(out[:, : len(COUNTS)])
    return out


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, plain: bool) -> Network:
    """plain: positives against unlabelled rows as they are; else the non-negative risk with the prior."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    d = 2 * positive.shape[1]
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-6, rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0, prior)
    p, u = net.prepare(positive), net.prepare(unlabelled)
    names = ["w1", "b1", "w2", "b2"]
    m = {k: 0.0 for k in names}
    v = {k: 0.0 for k in names}
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ net.w1 + net.b1)
        g = h @ net.w2 + net.b2
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        sp, su = s[:BATCH], s[BATCH:]
        dg = np.empty(2 * BATCH)  # gradient of the risk for each output; logistic loss
        if plain:
            dg[:BATCH], dg[BATCH:] = (sp - 1) / BATCH, su / BATCH
        else:
            loss = lambda z: np.logaddexp(0, z)
            negative = loss(g[BATCH:]).mean() - prior * loss(g[:BATCH]).mean()
            if negative >= 0:
                dg[:BATCH] = (prior * (sp - 1) - prior * sp) / BATCH
                dg[BATCH:] = su / BATCH
            else:  # the risk must not go below zero: step back along its negative part
                dg[:BATCH] = prior * sp / BATCH
                dg[BATCH:] = -su / BATCH
        dh = np.outer(dg, net.w2) * (1 - h * h)
        grad = {"w1": x.T @ dh + DECAY * net.w1, "b1": dh.sum(axis=0), "w2": h.T @ dg + DECAY * net.w2, "b2": dg.sum()}
        rate = RATE * (1 - step / (STEPS + 1)) + 1e-4
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            setattr(net, k, getattr(net, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 8) -> float:
    """Share of positives among unlabelled rows.

    Where only positives live, the unlabelled density is the prior times the positive one; the
    smallest ratio over score ranges that hold a good part of the positives is the estimate.
    """
    cut_p, cut_u = len(positive) // 2, len(unlabelled) // 2
    net = _fit(positive[:cut_p], unlabelled[:cut_u], 0.5, seed, plain=True)
    p, u = net.raw(positive[cut_p:]), net.raw(unlabelled[cut_u:])
    ratios = []
    for q in (0.1, 0.2, 0.3, 0.4, 0.5):
        t = np.quantile(p, q)
        ratios.append((u >= t).mean() / max(1e-9, (p >= t).mean()))
    return float(np.clip(min(ratios), 0.05, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 8) -> Network | None:
    """The network; None without positives or unlabelled rows."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return None
    p, u = squash(positive), squash(unlabelled)
    return _fit(p, u, estimate_prior(p, u, seed), seed, plain=False)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = POSITIVE_ROWS, unlabelled: int = UNLABELLED_ROWS) -> tuple[DataFrame, Network | None]:
    """A row per document (_id, score 0..1) and the network.

    Positives are rows labelled 1 that may teach (crc32 of the id, modulo 5, is not 0); unlabelled
    rows are drawn from the same part of all documents. Null texts count as empty and are scored;
    without positives every score is 0.5. Repeated rows are each returned; a null id stays null.
    """
    stats = store(text_stats(docs, id_col, text_col), "stats")
    may = stats.filter(F.col("_id").isNotNull() & (crc_mod("_id", 5) != 0))
    good = labels.filter(F.col(label_col) == 1).select(F.col("doc_id").alias("_id")).distinct()

    def drawn(rows: DataFrame, n: int) -> np.ndarray:
        some = draw(rows.select("_id", *FEATURES), "_id", n).select(*FEATURES).collect()
        return np.array([list(r) for r in some], np.float64).reshape(len(some), len(FEATURES))

    net = train(drawn(may.join(good, "_id", "left_semi"), positives), drawn(may, unlabelled))
    if net is None:
        return stats.select("_id", F.lit(0.5).alias("score")), None
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 1 + len(FEATURES))], axis=1)
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score(squash(x)), pa.float64())], names=["_id", "score"])

    return arrow_map(stats.select("_id", *FEATURES), run, "_id long, score double"), net
