"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a lookup table may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

#: White space of the contracts: space and the controls from tab to carriage return.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"

_BATCH_ROWS = "512"


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so a batch of very long texts stays small in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", _BATCH_ROWS)
    return spark


def fresh(name: str, taken: list[str]) -> str:
    """A name beginning with `name` that no column has, whatever its case."""
    low = [c.lower() for c in taken]
    while any(c.startswith(name.lower()) for c in low):
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, and only in local mode, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="codegrove-")
        spark.conf.set("spark.checkpoint.dir", where)
        local = where.removeprefix("file://")

        def clean() -> None:
            import shutil

            shutil.rmtree(local, ignore_errors=True)

        atexit.register(clean)
    return where.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A stored lookup table, marked for broadcast only if its counted rows are within the bound."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of an id as text, modulo mod; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(mod).cast("long"))


def words_column(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE), lambda w: w != "")


def draw(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, those with the smallest hash of key. Partitions send about their share, not `rows` each."""
    n = df.count()
    order = F.xxhash64(F.col(key))
    if n > rows:
        df = df.filter(F.pmod(F.shiftrightunsigned(order, 40), F.lit(1 << 20).cast("long")) < int((1 << 20) * min(1.0, 1.1 * rows / n)) + 1)
    return df.orderBy(order, *df.columns).limit(rows)


def most_frequent(counts: DataFrame, rows: int, count_col: str = "c") -> DataFrame:
    """The rows of the largest counts, at most `rows` of them: a cut on the count, found from a small histogram."""
    step = F.floor(F.log2(F.col(count_col).cast("double")) * 8)
    steps = counts.filter(F.col(count_col) > 0).groupBy(step.alias("step")).count().collect()
    edge, total = None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if total + r["count"] > rows:
            break
        edge, total = r["step"], total + r["count"]
    return counts.filter(F.lit(False) if edge is None else step >= edge)


#: Name of the module object under which a worker process holds what outlives its tasks.
WORKER_STATE = "_codegrove_worker_state"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keep_state: bool = False) -> DataFrame:
    """mapInArrow over small batches. Worker processes are reused, so what another map left in one is let go first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_state:
            sys.modules.pop(WORKER_STATE, None)
        return fn(batches)

    return tune_df(df).mapInArrow(run, schema)


def tune_df(df: DataFrame) -> DataFrame:
    tune(df.sparkSession)
    return df


def texts_of(batch: pa.RecordBatch, col: str = "text") -> list[bytes]:
    """UTF-8 texts of a batch; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(col))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """word bytes -> 64-bit hash, emptied when it holds `limit` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over the whole range (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_P = np.uint64(0x100000001B3)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k word hashes."""
    n = len(h) - k + 1
    acc = h[:n].copy()
    for i in range(1, k):
        acc = acc * _P + mix64(h[i : i + n])
    return mix64(acc)


def shingle_set(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles; with fewer words the whole sequence as one; none without words."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return mix64(windows(h, n) + np.uint64(n))
    return np.unique(windows(h, k))


def sum_blocks(rows: DataFrame, fan: int = 256) -> DataFrame:
    """Add zlib-packed int64 blocks (block int, part int, data binary) by block, at most `fan` parts at a time.

    A sum has one row per block, whatever the number of parts.
    """

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total = None
        for data in table.column("data").to_pylist():
            x = np.frombuffer(zlib.decompress(data), np.int64)
            total = x.copy() if total is None else total + x
        packed = zlib.compress(total.tobytes(), 1)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([0 if len(key) < 2 else key[1].as_py()], pa.int32()), "data": pa.array([packed], pa.binary())})

    schema = "block int, part int, data binary"
    some = rows.withColumn("part", (F.col("part") / fan).cast("int")).groupBy("block", "part").applyInArrow(add, schema)
    return some.groupBy("block").applyInArrow(add, schema)


def pack_blocks(counts: np.ndarray, part: int, width: int = 8192) -> tuple[list[int], list[int], list[bytes]]:
    """Rows for sum_blocks of one dense array of counts; blocks without counts are left out."""
    blocks, parts, data = [], [], []
    for b in range(0, len(counts), width):
        x = counts[b : b + width]
        if x.any():
            blocks.append(b // width)
            parts.append(part)
            data.append(zlib.compress(x.astype(np.int64).tobytes(), 1))
    return blocks, parts, data


def read_blocks(rows: DataFrame, size: int, width: int = 8192) -> np.ndarray:
    """The dense array on the driver; its size is a parameter, not that of the data."""
    out = np.zeros(size, np.int64)
    for r in rows.select("block", "data").collect():
        x = np.frombuffer(zlib.decompress(r["data"]), np.int64)
        out[r["block"] * width : r["block"] * width + len(x)] = x
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: id, comp (smallest id reachable), for ids that have a link.

    Rounds of contraction: each id goes to its smallest neighbour, links between what remains are
    kept, and the loop ends when none is left. Minima are aggregated before the shuffle, so a star
    with a third of all ids is no hot group; joins are plain lookups that adaptive execution can split.
    """
    e = store(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "links")
    owner: DataFrame | None = None
    while True:
        both = e.select(F.col("a").alias("id"), F.col("b").alias("o")).union(e.select("b", "a"))
        step = store(both.groupBy("id").agg(F.least(F.min("o"), F.col("id")).alias("to")), "step")
        up = step.select(F.col("id").alias("to"), F.col("to").alias("top"))
        step = store(step.join(small(up), "to", "left").select("id", F.coalesce("top", "to").alias("to")), "step")
        n = step.count()
        if owner is None:
            owner = step.select("id", F.col("to").alias("comp"))
        else:
            hop = step.select(F.col("id").alias("comp"), F.col("to").alias("next"))
            owner = owner.join(small(hop, n), "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))
            owner = store(owner, "owner")
        ta, tb = step.select(F.col("id").alias("a"), F.col("to").alias("ta")), step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        e = e.join(small(ta, n), "a").join(small(tb, n), "b").select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b"))
        e = store(e.filter("a <> b").distinct(), "links")
        if e.isEmpty():
            return owner
