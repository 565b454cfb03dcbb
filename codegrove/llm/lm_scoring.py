"""Text scores of a log-bilinear language model trained with noise-contrastive estimation.

The model predicts word classes: the most frequent words are classes of their own, every other word belongs to
one of the tail classes by its ending, and the end of a text is a class. The number of both kinds grows with the
logarithm of the training tokens. A context of two classes gives a predicted vector (their vectors times one matrix
per position); a class scores its product with that vector plus a bias. Training goes over the counts of all class
triples of all training texts, again and again: each counted triple takes part in every pass with its whole count,
and the noise term is taken in expectation over all classes rather than from draws, so the number of steps grows with
the contexts that occur. For scoring, batched matrix products give every context's scores, which are normalised over
all classes; a word of a tail class has its share of the class by its smoothed training count, unseen words together
one more. So token probabilities are normalised over an open vocabulary.

Word counts live in a table; the most frequent words' counts travel to the workers (HEAD entries), all
others are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, most_frequent, pack_blocks, read_blocks, store, sum_blocks, texts_of

#: For each doubling of the training tokens: words more that are classes of their own, and tail classes more.
FREQUENT_STEP, TAIL_STEP = 5.0, 5.0
#: Words whose counts every worker holds.
HEAD = 100_000
DIM, NOISE, RATE = 24, 128, 0.02
#: Contexts of a training step, and the least number of passes over all contexts and of steps.
BATCH, PASSES, STEPS = 1024, 20, 1000
#: Distinct words a counting task holds before it hands them on.
HELD = 400_000

END = "\x00end"


@dataclass(frozen=True)
class Classes:
    """Words that are classes of their own, and classes of the other words; the end of a text comes after them."""

    frequent: int
    tails: int

    @classmethod
    def of(cls, tokens: int) -> Classes:
        doublings = np.log2(tokens + 2)
        return cls(int(FREQUENT_STEP * doublings), int(TAIL_STEP * doublings))

    @property
    def outputs(self) -> int:
        return self.frequent + self.tails + 1

    @property
    def cells(self) -> int:
        """Triples: contexts of two classes, each of which may also be the start, times outputs."""
        return (self.outputs + 1) ** 2 * self.outputs


def word_hash(word: bytes) -> int:
    """Signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


END_HASH = word_hash(END.encode())


def ending(word: bytes) -> int:
    """A number for a word's ending; modulo the tail classes it gives the word's."""
    return zlib.crc32(word[-2:])


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    texts = 0

    def out() -> pa.RecordBatch:
        words = list(held)
        rows = pa.record_batch([pa.array(map(word_hash, words), pa.int64()), pa.array(map(ending, words), pa.int64()), pa.array(held.values(), pa.int64())], names=["h", "ending", "c"])
        held.clear()
        return rows

    for batch in batches:
        for text in texts_of(batch):
            held.update(tokens_of(text))
            texts += 1
            if len(held) > HELD:
                yield out()
    if texts:
        yield out()
        yield pa.record_batch([pa.array([END_HASH], pa.int64()), pa.array([-1], pa.int64()), pa.array([texts], pa.int64())], names=["h", "ending", "c"])


@dataclass
class Words:
    """What workers know of the vocabulary: hashes of the HEAD words, most frequent first, their counts, and the classes."""

    hashes: np.ndarray
    counts: np.ndarray
    frequent: list[int]
    classes: Classes


class Lookup:
    """word -> slot of (class, log10(count + 1) or NaN for words outside HEAD, hash)."""

    def __init__(self, words: Words, limit: int = 300_000):
        self.head = dict(zip(words.hashes.tolist(), words.counts.tolist()))
        self.own = {h: i for i, h in enumerate(words.frequent)}
        self.classes = words.classes
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.cls, self.log, self.hash = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def _make_room(self, n: int) -> None:
        if n > len(self.cls):
            size = max(n, 2 * len(self.cls))
            self.cls, self.log, self.hash = (np.concatenate([x, np.empty(size - len(x), x.dtype)]) for x in (self.cls, self.log, self.hash))

    def learn(self, words: set[bytes]) -> None:
        first, n = len(self.slot), len(self.slot) + len(words)
        self._make_room(n)
        hashes = list(map(word_hash, words))
        frequent, tails = self.classes.frequent, self.classes.tails
        self.hash[first:n] = hashes
        self.cls[first:n] = [self.own.get(h, -1) for h in hashes]
        other = np.fromiter(map(ending, words), np.int64, len(words)) % tails + frequent
        self.cls[first:n] = np.where(self.cls[first:n] < 0, other, self.cls[first:n])
        self.log[first:n] = np.log10(np.array([self.head.get(h, np.nan) for h in hashes], np.float64) + 1)
        self.slot.update(zip(words, range(first, n)))

    def slots(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        some = set().union(*texts)
        new = some.difference(self.slot)
        if len(self.slot) + len(new) > self.limit:
            self._reset()
            new = some
        self.learn(new)
        return [np.fromiter(map(self.slot.__getitem__, t), np.int64, len(t)) for t in texts]


def contexts(cls: np.ndarray, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """Context number and class of each token of a text, its end included."""
    seq = np.empty(len(cls) + 3, np.int64)
    seq[:2] = outputs
    seq[2:-1] = cls
    seq[-1] = outputs - 1
    return seq[:-2] * (outputs + 1) + seq[1:-1], seq[2:]


def _triples(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, classes = Lookup(words.value), words.value.classes
        total = np.zeros(classes.cells, np.int32)
        for batch in batches:
            texts = [tokens_of(t) for t in texts_of(batch)]
            for at in range(0, len(texts), 64):
                slots = look.slots(texts[at : at + 64])
                cls = look.cls
                cells = []
                for s in slots:
                    ctx, out = contexts(cls[s], classes.outputs)
                    cells.append(ctx * classes.outputs + out)
                found, n = np.unique(np.concatenate(cells), return_counts=True)
                total[found] += n.astype(np.int32)
        blocks, parts, data = pack_blocks(total, TaskContext.get().partitionId())
        yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "data"])

    return run


@dataclass
class LogBilinear:
    """Class vectors of contexts, a matrix per context position, class vectors and biases of outputs."""

    context: np.ndarray
    first: np.ndarray
    second: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def predicted(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.context[a] @ self.first + self.context[b] @ self.second

    def log10_table(self) -> np.ndarray:
        """Normalised log10 probability of each class for each context; the contexts of one first class are a batch."""
        n = len(self.context)
        table = np.empty((n, n, n - 1), np.float32)
        every = np.arange(n)
        for a, rows in enumerate(table):
            rows[:] = self.predicted(np.full(n, a), every) @ self.output.T + self.bias
            rows -= rows.max(axis=1, keepdims=True)
            rows -= np.log(np.exp(rows).sum(axis=1, keepdims=True))
        table /= np.float32(np.log(10))
        return table.reshape(n * n, n - 1)


def train(counts: np.ndarray, classes: Classes, seed: int = 1) -> LogBilinear:
    """Noise-contrastive estimation on counted triples; noise is the smoothed unigram distribution of classes.

    A pass deals all contexts that occur into steps. A context with more than a step's part of all tokens is in every step
    of the pass with an even part of its counts, so that the steps weigh about alike.
    """
    rng = np.random.default_rng(seed)
    n = classes.outputs
    table = counts.reshape(-1, n)
    mass = table.sum(axis=1)
    unigram = table.sum(axis=0) + 1.0
    noise = unigram / unigram.sum()
    model = LogBilinear(rng.normal(0, 0.1, (n + 1, DIM)), np.eye(DIM) * 0.5, np.eye(DIM) * 1.0, rng.normal(0, 0.1, (n, DIM)), np.log(noise))
    seen = np.flatnonzero(mass)
    if not len(seen):
        return model
    kq = NOISE * noise
    log_kq = np.log(kq)
    deals = -(-len(seen) // BATCH)
    step_mass = mass.sum() / deals
    heavy, light = seen[mass[seen] > step_mass], seen[mass[seen] <= step_mass]
    steps = deals * max(PASSES, -(-STEPS // deals))
    names = ["context", "first", "second", "output", "bias"]
    m = {k: np.zeros_like(getattr(model, k)) for k in names}
    v = {k: np.zeros_like(getattr(model, k)) for k in names}
    for step in range(1, steps + 1):
        deal = (step - 1) % deals
        if deal == 0:
            rng.shuffle(light)
        ctx = np.concatenate([heavy, light[deal::deals]])
        part = np.ones((len(ctx), 1))
        part[: len(heavy)] /= deals
        true = table[ctx] * (part / step_mass)
        a, b = np.divmod(ctx, n + 1)
        ea, eb = model.context[a], model.context[b]
        r = ea @ model.first + eb @ model.second
        odds = r @ model.output.T + model.bias - log_kq
        ds = (true + true.sum(axis=1, keepdims=True) * kq) / (1 + np.exp(-np.clip(odds, -30, 30))) - true  # d loss / d score
        dr = ds @ model.output
        grad = {"output": ds.T @ r, "bias": ds.sum(axis=0), "first": ea.T @ dr, "second": eb.T @ dr, "context": np.zeros_like(model.context)}
        np.add.at(grad["context"], a, dr @ model.first.T)
        np.add.at(grad["context"], b, dr @ model.second.T)
        rate = RATE * (1 - step / (steps + 1)) + 1e-4
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            setattr(model, k, getattr(model, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9))
    return model


def _score(words, model, tail_log):
    """Per text: tokens, sums of what the worker knows, and the words whose counts it does not know."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, table = Lookup(words.value), model.value.log10_table()
        end_log = np.log10(look.head.get(END_HASH, 0) + 1.0)
        known_end = int(END_HASH in look.head)
        classes = words.value.classes
        share = np.concatenate([np.zeros(classes.frequent), tail_log.value])
        for batch in batches:
            keys = batch.column(0).to_pylist()
            n, known, logs, lm, hs, ns = [], [], [], [], [], []
            texts = [tokens_of(t) for t in texts_of(batch)]
            for at in range(0, len(texts), 64):
                slots = look.slots(texts[at : at + 64])
                cls, log = look.cls, look.log
                for s in slots:
                    mine, c = log[s], cls[s]
                    ctx, out = contexts(c, classes.outputs)
                    tail = np.isnan(mine)
                    n.append(len(s) + 1)
                    known.append(int((~tail).sum()) + known_end)
                    logs.append(float(mine[~tail].sum() + end_log))
                    in_tail = c >= classes.frequent
                    inside = mine[in_tail & ~tail].sum() - share[c[in_tail]].sum()
                    lm.append(float(table[ctx, out].sum(dtype=np.float64) + inside))
                    which, times = np.unique(s[tail], return_counts=True)
                    hs.append(look.hash[which].tolist())
                    ns.append(times.tolist())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(lm, pa.float64()), pa.array(hs, pa.list_(pa.int64())), pa.array(ns, pa.list_(pa.int64()))], names=["id", "n_tokens", "known", "logs", "lm", "hs", "ns"])

    return run


def score_texts(docs: DataFrame, train_filter=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_tokens, n_known, train_tokens, base_score, score.

    train_filter: condition of the rows the model learns from (default: crc32 of the id, modulo 7, is not 2). A null
    text is empty: one token, its end. Without training rows counts are zero and the model is its
    start. Repeated rows are each returned; a null id stays null.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    learn = rows.filter(crc_mod("_id", 7) != 2) if train_filter is None else docs.filter(train_filter).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    counts = arrow_map(learn, _count, "h long, ending long, c long").groupBy("h").agg(F.sum("c").alias("c"), F.first("ending").alias("ending"))
    counts = store(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    classes = Classes.of(int(total[0]))
    top = counts.orderBy(F.desc("c"), "h").limit(classes.frequent + 1).select("h", "c").collect()
    frequent = [r["h"] for r in top if r["h"] != END_HASH][: classes.frequent]
    top += most_frequent(counts, HEAD).select("h", "c").collect()
    hashes = {r["h"]: r["c"] for r in top}
    hashes |= {r["h"]: r["c"] for r in counts.filter(F.col("h") == END_HASH).select("h", "c").collect()}
    words = spark.sparkContext.broadcast(Words(np.array(list(hashes), np.int64), np.array(list(hashes.values()), np.int64), frequent, classes))
    tails = counts.filter((F.col("ending") >= 0) & ~F.col("h").isin(frequent)).groupBy((F.col("ending") % classes.tails).alias("tail")).agg((F.sum("c") + F.count("*") + 1).alias("n")).collect()
    size = np.ones(classes.tails)
    for r in tails:
        size[r["tail"]] = r["n"]
    tail_log = spark.sparkContext.broadcast(np.log10(size))
    blocks = sum_blocks(arrow_map(learn, _triples(words), "block int, part int, data binary"))
    model = spark.sparkContext.broadcast(train(read_blocks(blocks, classes.cells), classes))

    found = arrow_map(rows, _score(words, model, tail_log), "id long, n_tokens long, known long, logs double, lm double, hs array<long>, ns array<long>")
    found = store(found.withColumn("_row", F.monotonically_increasing_id()), "scored")  # numbered as written: later reads may split otherwise
    rare = found.filter(F.size("hs") > 0).select("_row", F.explode(F.arrays_zip("hs", "ns")).alias("x")).select("_row", F.col("x.hs").alias("h"), F.col("x.ns").alias("n"))
    rare = rare.join(counts.select("h", "c"), "h").groupBy("_row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare"))
    n, v = int(total[0]), int(total[1])
    out = found.select("_row", "id", "n_tokens", "known", "logs", "lm").join(rare, "_row", "left")
    rest = F.coalesce("rare", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + rest - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("lm") + rest).alias("score"),
    )
