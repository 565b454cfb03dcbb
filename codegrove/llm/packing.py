"""Packing documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most `capacity` tokens. Full pieces are sequences of their own; the others are
dealt into shards of bounded size. On each shard several islands evolve packings of
the same pieces: a crossover injects whole well-filled bins of one parent into the other, bins that
now hold duplicates are dissolved, and displaced pieces go where they fit best. Between epochs the
islands of a shard exchange their elites. Bins that stayed poorly filled meet once more in new
shards, so the loss does not grow with the number of shards.
"""

from __future__ import annotations

import math
import os
import random
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_STATE, arrow_map, store, texts_of

CAPACITY = 4096
END = 1
#: Pieces of a shard on average, islands of a shard, epochs between which elites migrate.
SHARD, ISLANDS, EPOCHS = 4096, 2, 2
POPULATION, GENERATIONS, ELITES = 5, 12, 2
#: Bins below this fill are packed again with those of other shards.
POOR = 0.97


def _slices(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Slices of data, one after another."""
    stop = np.cumsum(length)
    total = int(stop[-1]) if len(stop) else 0
    return data[np.arange(total) + np.repeat(start - (stop - length), length)]


def _blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows that end in a text, about four megabytes of text at a time."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[-1]) + 64
        if size >= 1 << 22:
            yield some
            some, size = [], 0
    if some:
        yield some


class Encoder:
    """Token ids of texts as little-endian uint32 bytes, by words that white space separates.

    The vocabulary drops white space, folds case and never merges across white space or from a letter to
    punctuation. So the ids of a text are those of its words, and those of a word that ends in
    punctuation are those of its two parts. A block of texts is split, its distinct words are found, and
    its ids are put together, each by whole columns; what is remembered of a word is a number, under which its
    ids stand in one array. Beyond `limit` words all are forgotten.
    """

    TAIL = "!\"#$%&()*+,-./:;=?@[]^_{|}~"

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {b"": 0}
        self.used = 0
        self.ids = np.zeros(1 << 16, "<u4")
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Number new words, whose ids follow one another."""
        n, used = len(self.numbers), self.used
        self.used += len(ids)
        while self.used > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[used : self.used] = ids
        self.start[n : n + len(words)] = used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.numbers.update(zip(words, range(n, n + len(words))))

    def _singly(self, words: list[bytes]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        self._add(words, np.array([i for x in found for i in x], "<u4"), np.array([len(x) for x in found], np.int64))

    def _together(self, words: list[bytes]) -> None:
        """Words of letters only: each is one run, so one token, its last, ends a word."""
        text = b" ".join(words).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            self._singly(words)
        else:
            self._add(words, ids, np.diff(ends, prepend=0))

    def _number(self, words: pa.Array, learn: Callable[[list[bytes]], None]) -> np.ndarray:
        """The numbers of words; new ones are learned 2048 at a time."""
        coded = words.dictionary_encode()
        keys = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        known = np.fromiter(map(self.numbers.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(known < 0)
        known[unknown] = np.arange(len(self.numbers), len(self.numbers) + len(unknown))
        for at in range(0, len(unknown), 2048):
            learn(keys[unknown[at : at + 2048]].tolist())
        return known[coded.indices.to_numpy()]

    def _block(self, texts: list[bytes]) -> list[bytes]:
        if len(self.numbers) > self.limit:
            self.forget()
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        core = pc.ascii_rtrim(words, characters=self.TAIL)
        plain = pc.utf8_is_alpha(core)
        of_letters = plain.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(words), 2), np.int64)  # numbers of a word's core and tail
        parts[~of_letters, 0] = self._number(words.filter(pc.invert(plain)), self._singly)
        parts[of_letters, 0] = self._number(pc.ascii_lower(core.filter(plain)), self._together)
        size = pc.binary_length(core).to_numpy()
        tailed = np.flatnonzero(of_letters & (size < pc.binary_length(words).to_numpy()))
        whole = words.take(pa.array(tailed)).cast(pa.binary()).to_numpy(zero_copy_only=False)
        tails = [w[n:] for w, n in zip(whole, size[tailed].tolist())]
        parts[tailed, 1] = self._number(pa.array(tails, pa.binary()), self._singly)
        lengths = self.length[parts]
        ids = _slices(self.ids, self.start[parts].ravel(), lengths.ravel())
        of_word = lengths.sum(axis=1)
        spans = of_word[at]
        data = _slices(ids, (np.cumsum(of_word) - of_word)[at], spans)
        bounds = (4 * np.r_[0, np.cumsum(spans)][split.offsets.to_numpy()]).tolist()
        view = memoryview(data).cast("B")
        return [bytes(view[a:b]) for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [ids for some in _blocks(zip(texts)) for ids in self._block([t for t, in some])]


def _encoder(path: str) -> Encoder:
    """One encoder per worker process: what it has learned serves the process's later tasks too."""
    kept = sys.modules.setdefault(WORKER_STATE, types.ModuleType(WORKER_STATE))
    if path not in vars(kept):
        setattr(kept, path, Encoder(path))
    return getattr(kept, path)


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = _encoder(path), np.array([end], "<u4").tobytes()
        width = 4 * capacity
        for rows in _blocks(row for batch in batches for row in zip(batch.column(0).to_pylist(), texts_of(batch))):
            ids, piece, start, length, crc, tokens = [], [], [], [], [], []
            for key, data in zip((key for key, _ in rows), encoder.encode([text for _, text in rows])):
                data += last
                for at in range(0, len(data), width):
                    part = data[at : at + width]
                    ids.append(key), piece.append(at // width), start.append(at // 4)
                    length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    tokens.append(part)
            columns = [pa.array(ids, pa.int64()), pa.array(piece, pa.int32())] + [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(tokens, pa.binary()))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    return run


class Packing:
    """Bins as lists of piece numbers, with their loads."""

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> float:
        return sum((x / capacity) ** 2 for x in self.loads) / max(1, len(self.loads))

    def key(self, capacity: int) -> tuple[int, float]:
        return (len(self.bins), -self.fitness(capacity))

    def owners(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: list[list[int]] | None = None, loads: list[int] | None = None) -> Packing:
    """Put the pieces of order, one after another, into the fullest bin that has room; else open a bin."""
    bins, loads = bins or [], loads or []
    room = sorted((capacity - x, b) for b, x in enumerate(loads))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
            loads[b] += sizes[i]
        else:
            b = len(bins)
            bins.append([i])
            loads.append(sizes[i])
        if loads[b] < capacity:
            insort(room, (capacity - loads[b], b))
    return Packing(bins, loads)


def cross(a: Packing, b: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Inject some of b's best-filled bins into a, dissolve bins with duplicates, best-fit what is displaced."""
    ranked = sorted(range(len(b.bins)), key=lambda x: -b.loads[x])
    take = ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.6)))]
    placed = {i for x in take for i in b.bins[x]}
    bins, loads = [list(b.bins[x]) for x in take], [b.loads[x] for x in take]
    loose: list[int] = []
    for items, load in zip(a.bins, a.loads):
        if placed.isdisjoint(items):
            bins.append(list(items)), loads.append(load)
        else:
            loose += [i for i in items if i not in placed]
    return best_fit(sizes, sorted(loose, key=lambda i: -sizes[i]), capacity, bins, loads)


def mutate(p: Packing, sizes: list[int], capacity: int, rng: random.Random) -> Packing:
    """Dissolve the worst bin and a few others, and best-fit their pieces in a disturbed order."""
    n = len(p.bins)
    out = set(sorted(range(n), key=lambda x: p.loads[x])[:1]) | {rng.randrange(n) for _ in range(max(1, n // 20))}
    loose = [i for x in out for i in p.bins[x]]
    loose.sort(key=lambda i: -sizes[i] * rng.uniform(0.9, 1.0))
    keep = [x for x in range(n) if x not in out]
    return best_fit(sizes, loose, capacity, [list(p.bins[x]) for x in keep], [p.loads[x] for x in keep])


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[np.ndarray], population: int = POPULATION, generations: int = GENERATIONS) -> list[Packing]:
    """The best packings of one island, from elites (owner arrays) or from scratch."""
    rng, n = random.Random(seed), len(sizes)
    least = -(-sum(sizes) // capacity)
    crowd: list[Packing] = []
    for owner in elites:
        bins: list[list[int]] = [[] for _ in range(int(owner.max()) + 1 if n else 0)]
        for i, b in enumerate(owner.tolist()):
            bins[b].append(i)
        crowd.append(Packing(bins, [sum(sizes[i] for i in x) for x in bins]))
    order = sorted(range(n), key=lambda i: -sizes[i])
    if not crowd:
        crowd.append(best_fit(sizes, order, capacity))

    def done() -> bool:
        return min(len(p.bins) for p in crowd) <= least

    while len(crowd) < population and not done():
        some = sorted(range(n), key=lambda i: -sizes[i] * rng.uniform(0.7, 1.0))
        crowd.append(best_fit(sizes, some, capacity))
    for _ in range(generations):
        if done():
            break
        crowd.sort(key=lambda p: p.key(capacity))
        crowd = crowd[: max(2, population)]
        children = []
        for _ in range(population - 1):
            a, b = rng.sample(crowd, 2) if len(crowd) > 1 else (crowd[0], crowd[0])
            child = cross(a, b, sizes, capacity, rng)
            children.append(mutate(child, sizes, capacity, rng) if rng.random() < 0.5 else child)
        crowd += children
    crowd.sort(key=lambda p: p.key(capacity))
    return crowd[:ELITES]


_ITEM = "uid long, id long, piece int, start long, length long, ids_crc32 long"


def _sizes(table: pa.Table) -> tuple[pa.Table, list[int]]:
    table = table.sort_by([("length", "descending"), ("uid", "ascending")])
    return table, table.column("length").to_pylist()


def _epoch(capacity: int, epoch: int):
    def run(key: tuple[pa.Scalar, ...], items: pa.Table, elites: pa.Table) -> pa.Table:
        shard, island = key[0].as_py(), key[1].as_py()
        _, sizes = _sizes(items)
        known = [np.frombuffer(x, np.int32) for x in elites.column("owner").to_pylist()]
        found = evolve(sizes, capacity, hash((shard, island, epoch)), known)
        return pa.table({"shard": pa.array([shard] * len(found), pa.int64()), "island": pa.array([island] * len(found), pa.int32()), "owner": pa.array([p.owners(len(sizes)).tobytes() for p in found], pa.binary())})

    return run


def _finish(capacity: int):
    def run(key: tuple[pa.Scalar, ...], items: pa.Table, elites: pa.Table) -> pa.Table:
        items, sizes = _sizes(items)
        length = np.array(sizes, np.int64)
        options = []
        for x in elites.column("owner").to_pylist():
            owner = np.frombuffer(x, np.int32)
            load = np.bincount(owner, length)
            options.append(((len(load), -float((load**2).sum()), x), owner))
        owner = min(options, key=lambda x: x[0])[1]
        load = np.bincount(owner, length).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        run_up = np.cumsum(length[order]) - length[order]
        first = np.r_[True, owner[order][1:] != owner[order][:-1]]
        offset = np.zeros(len(sizes), np.int64)
        offset[order] = run_up - np.maximum.accumulate(np.where(first, run_up, 0))
        return items.select(["uid", "id", "piece", "start", "length", "ids_crc32"]).append_column("shard", pa.array([key[0].as_py()] * len(sizes), pa.int64())).append_column("bin", pa.array(owner.astype(np.int64))).append_column("load", pa.array(load[owner])).append_column("offset", pa.array(offset))

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, salt: int = 0) -> DataFrame:
    """Stored pieces (uid, id, piece, start, length, ids_crc32) with shard, bin, load and offset."""
    n = pieces.count()
    shards = max(1, math.ceil(n / SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(shards).cast("long")))
    spread = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    elites = dealt.sparkSession.createDataFrame([], "shard long, island int, owner binary")
    for epoch in range(EPOCHS):
        if epoch:  # every island gets its own elites and those of its neighbour
            visit = elites.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
            elites = elites.unionByName(visit)
        found = spread.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island")).applyInArrow(_epoch(capacity, epoch), "shard long, island int, owner binary")
        elites = store(found, "elites")
    return dealt.groupBy("shard").cogroup(elites.groupBy("shard")).applyInArrow(_finish(capacity), _ITEM + ", shard long, bin long, load long, offset long")


def cut_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: id, piece, start, length, ids_crc32, and with_ids the ids (little-endian uint32 bytes).

    Tokens are the ids of the tokenizer file at path, then `end`. A null or empty text has that one token.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    extra = ", ids binary" if with_ids else ""
    return arrow_map(rows, _pieces(path, capacity, end, with_ids), "id long, piece int, start long, length long, ids_crc32 long" + extra, keep_state=True)


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty; rows with a null id are packed like others; repeated rows are packed
    as often as they occur. An empty table gives an empty result.
    """
    cut = cut_documents(docs, path, id_col, text_col, capacity, end)
    pieces = store(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")  # numbered as written: later reads may split otherwise
    full = pieces.filter(F.col("length") >= capacity)
    first = store(pack_pieces(store(pieces.filter(F.col("length") < capacity), "open"), capacity), "packed")
    good = first.filter(F.col("load") >= POOR * capacity)
    poor = store(first.filter(F.col("load") < POOR * capacity).select(*[c.split()[0] for c in _ITEM.split(", ")]), "poor")
    again = pack_pieces(poor, capacity, salt=1)
    at = F.col("shard") * F.lit(1 << 24).cast("long") + F.col("bin")
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    return (
        good.select(*columns, (at * 4).alias("sequence_id"), "offset")
        .unionByName(again.select(*columns, (at * 4 + 1).alias("sequence_id"), "offset"))
        .unionByName(full.select(*columns, (F.col("uid") * 4 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    )
