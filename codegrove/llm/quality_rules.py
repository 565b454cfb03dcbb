"""Quality rules as a learned decision list.

Sequential covering on labelled statistics: a rule is a conjunction of thresholds, grown condition
by condition for gain on one part of the rows and pruned on the other; rows it covers are
taken out and the next rule is learned. The list is emitted as one Spark conditional expression, in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, draw, store
from .textstats import COUNTS, RATIOS, text_stats

FEATURES = COUNTS + RATIOS
#: Labelled rows a list is learned from at most (those with the smallest hash of their id).
LABEL_ROWS = 40_000
MAX_RULES, MAX_CONDITIONS, CUTS = 16, 4, 64
#: A rule stays if so large a share of what it covers on the pruning rows is bad, and it covers so many rows.
PRECISION, SUPPORT = 0.8, 8


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v < self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    """Add the condition with the largest information gain until only bad rows are covered."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS:
        xs, ys = x[inside], bad[inside]
        p, n = ys.sum(), len(ys)
        if not p or p == n:
            break
        base, best = np.log2(p / n), (0.0, None)
        for j, name in enumerate(FEATURES):
            cuts = np.unique(np.quantile(xs[:, j], np.linspace(0, 1, CUTS + 1)[1:-1], method="higher"))
            order = np.sort(xs[:, j])
            pos = np.sort(xs[ys, j])
            for above in (True, False):
                covered = np.searchsorted(order, cuts)
                good = np.searchsorted(pos, cuts)
                if above:
                    covered, good = n - covered, p - good
                ok = (good >= SUPPORT) & (covered < n)
                if not ok.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ok, good * (np.log2(np.maximum(good, 1e-9) / np.maximum(covered, 1)) - base), -1)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """Drop final conditions while that does not lower (bad - good) / (bad + good) of what is covered."""
    def worth(r: Rule) -> float:
        c = covers(r, x)
        n = c.sum()
        return (2 * bad[c].sum() - n) / n if n else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 5) -> list[Rule]:
    """Ordered rules for bad rows; none if there are no bad rows."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    x, bad = x[order := rng.permutation(len(x))], bad[order]
    while len(rules) < MAX_RULES and bad.sum() >= 2 * SUPPORT:
        cut = 2 * len(x) // 3
        rule = prune(grow(x[:cut], bad[:cut]), x[cut:], bad[cut:])
        if not rule:
            break
        test, c = covers(rule, x[cut:]), covers(rule, x)
        if not test.any() or bad[cut:][test].mean() < PRECISION or c.sum() < SUPPORT:
            break
        rules.append(rule)
        x, bad = x[~c], bad[~c]
        order = rng.permutation(len(x))
        x, bad = x[order], bad[order]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True to keep: the rules in order as one conditional expression."""
    out = None
    for rule in rules:
        c = F.lit(True)
        for i, x in enumerate(rule):
            c = x.column() if i == 0 else c & x.column()
        out = F.when(c, F.lit(False)) if out is None else out.when(c, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled(stats: DataFrame, labels: DataFrame, label_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels (1 good) of at most `rows` labelled rows that may teach, by hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(label_col).alias("_label"))
    both = stats.join(known.filter(crc_mod("_id", 5) != 0), "_id").select("_id", "_label", *FEATURES)
    some = draw(both, "_id", rows).select("_label", *FEATURES).collect()
    data = np.array([list(r) for r in some], np.float64).reshape(len(some), 1 + len(FEATURES))
    return data[:, 1:], data[:, 0]


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = LABEL_ROWS) -> tuple[DataFrame, list[Rule]]:
    """A row per document (_id, COUNTS, RATIOS, base_failed, kept) and the rules.

    Only labels of rows that may teach are read (crc32 of the id, modulo 5, is not 0). A null text has no words
    and fails the base; without labels, or without bad ones, only the base decides. Repeated rows
    are each returned; a null id stays null and teaches nothing.
    """
    stats = store(text_stats(docs, id_col, text_col), "stats")
    x, good = labelled(stats, labels, label_col, rows)
    rules = learn_rules(x, good < 0.5)
    failed = base_failed()
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)), rules
