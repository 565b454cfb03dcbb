"""Exact near-duplicate components by a token-group matrix over word shingles.

1. Every text becomes the set of its distinct 5-word shingles (64-bit hashes). Equal sets are one
   class; from here on only one representative of each class is worked on.
2. Similar documents are partitioned into families: documents that agree on a few minima of their
   sets are compared with two leaders of that bucket (its smallest id, its best connected
   document). Pairs of moderate similarity make the families, and those over the threshold are the
   first links. Families are cut into groups of bounded size.
3. The matrix stores for each group the union of its members' prefix tokens, rarest first by a
   fixed-size frequency sketch over all documents. A document can only have a partner in a group
   of another family whose union meets its own prefix in enough tokens, so only those are opened.
   Of its own family's groups, a document opens all unless it is linked with the family's largest
   component already.
4. Opening a group: its tokens times its members are one boolean matrix. A query whose overlap
   with the union is too small is done; else the column sums are its overlaps with all members.

Prefix bound: with at least o = ceil(t * n) shared tokens, the first n - o + l tokens of two sets in
one global order share at least l. The order only changes how many candidates there are, never
the result.

Nulls: a null text has no words and links with nothing; a row with a null id is returned with a
null component. A repeated row is returned as often as it occurs; an id must not have two different texts.
An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, components, mix64, pack_blocks, read_blocks, shingle_set, small, store, sum_blocks, texts_of

SHINGLE = 5
#: Similarity as a fraction num / den.
NUM, DEN = 80, 100
#: Cells of the frequency sketch (4 MB on each worker, whatever the input).
CELLS = 1 << 20
#: Buckets per document for grouping, and minima that must agree in each.
BUCKETS, MINIMA = 6, 3
#: Sets of this size or more must share EXTRA prefix tokens with a group, smaller ones a single token.
LONG_SET, EXTRA = 50, 3
#: Bucket partners of this similarity belong to one family, whether linked or not.
FAMILY = 0.5
#: Bounds of a group (documents, tokens) and of the queries that one task asks of it.
GROUP_DOCS, GROUP_TOKENS, GROUP_QUERIES = 128, 131_072, 256

_SEEDS = mix64(np.arange(1, BUCKETS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(k: int, id_col: str):
    """Map function: a row per document, and at the end of each task the packed counts of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, cells = WordHashes(), np.zeros(CELLS, np.int64)
        mask = np.uint64(CELLS - 1)
        for batch in batches:
            ids, ns, h1, h2, bands = [], [], [], [], []
            seen = []
            for key, text in zip(batch.column(batch.schema.get_field_index(id_col)).to_pylist(), texts_of(batch)):
                s = shingle_set(cache.of(text.lower().split()), k)
                ids.append(key)
                ns.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), bands.append([])
                    continue
                seen.append(s & mask)
                h1.append(int(_signed(np.atleast_1d(np.add.reduce(mix64(s))))[0]))
                h2.append(int(_signed(np.atleast_1d(np.bitwise_xor.reduce(mix64(s + np.uint64(77)))))[0]))
                mins = np.array([(s * c).min() for c in _SEEDS], np.uint64).reshape(BUCKETS, MINIMA)
                key3 = mins[:, 0]
                for j in range(1, MINIMA):
                    key3 = mix64(key3 + mins[:, j])
                bands.append(_signed(mix64(key3 + np.arange(BUCKETS, dtype=np.uint64))).tolist())
            if seen:
                cells += np.bincount(np.concatenate(seen).astype(np.int64), minlength=CELLS)
            n = len(ids)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["id", "n", "h1", "h2", "bands", "block", "part", "data"])
        blocks, parts, data = pack_blocks(cells, TaskContext.get().partitionId())
        n = len(blocks)
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array(blocks, pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["id", "n", "h1", "h2", "bands", "block", "part", "data"])

    return run


def _needed(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def _prefixes(k: int, id_col: str, num: int, den: int, sketch):
    """Map function: id and the tokens of its prefix, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = WordHashes(), np.frombuffer(sketch.value, np.int32)
        mask = np.uint64(CELLS - 1)
        for batch in batches:
            ids, pre = [], []
            for key, text in zip(batch.column(batch.schema.get_field_index(id_col)).to_pylist(), texts_of(batch)):
                s = shingle_set(cache.of(text.lower().split()), k)
                n = len(s)
                if key is None or not n:
                    continue
                take = min(n, n - _needed(n, num, den) + (EXTRA if n >= LONG_SET else 1))
                c = counts[(s & mask).astype(np.int64)].astype(np.int64)
                if take < n:  # ties at the edge go by token, as in every other document
                    edge = np.partition(c, take - 1)[take - 1]
                    sure = s[c < edge]
                    s = np.concatenate([sure, s[c == edge][: take - len(sure)]])
                ids.append(key)
                pre.append(_signed(s).tolist())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pre, pa.list_(pa.int64()))], names=["id", "pre"])

    return run


def _pack(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col))
            yield pa.record_batch([ids.cast(pa.int64()), pa.array([zlib.compress(x, 1) for x in texts_of(batch)], pa.binary())], names=["id", "z"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    return len(x) + len(y) - len(np.union1d(x, y))


def _compare(k: int, num: int, den: int):
    """Map function over (a, b, za, zb): pairs at least FAMILY similar. Rows come sorted by b, so its set is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, kept = WordHashes(), None, None

        def of(z: bytes) -> np.ndarray:
            return shingle_set(cache.of(zlib.decompress(z).lower().split()), k)

        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            out: list[tuple[int, int, bool]] = []
            za, zb = batch.column(2), batch.column(3)
            for i in range(len(a)):
                if b[i] != last:
                    last, kept = b[i], of(zb[i].as_py())
                x = of(za[i].as_py())
                both = _overlap(x, kept)
                union = len(x) + len(kept) - both
                if both >= FAMILY * union or den * both >= num * union:
                    out.append((a[i], b[i], den * both >= num * union))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.bool_())], names=["a", "b", "near"])

    return run


def _open(k: int, num: int, den: int):
    """Map function over rows sorted by (lab, chunk, part, ask): the members of a group, then its queries.

    The group's tokens times its members are one boolean matrix; a query reads the rows of its own
    tokens, and the column sums are its overlaps with all members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at = WordHashes(), None
        ids: list[int] = []
        comps: list[int] = []
        sets: list[np.ndarray] = []
        tokens = matrix = sizes = None
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            out: list[tuple[int, int]] = []
            for lab, chunk, part, ask, rep, comp, z in zip(*(cols[n] for n in ("lab", "chunk", "part", "ask", "rep", "comp", "z"))):
                if (lab, chunk, part) != at:
                    at, ids, comps, sets, matrix = (lab, chunk, part), [], [], [], None
                s = shingle_set(cache.of(zlib.decompress(z).lower().split()), k)
                if not ask:
                    ids.append(rep), comps.append(comp), sets.append(s)
                    continue
                if matrix is None:
                    tokens = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.uint64)
                    matrix = np.zeros((len(tokens) + 1, len(sets)), np.uint8)
                    for j, x in enumerate(sets):
                        matrix[np.searchsorted(tokens, x), j] = 1
                    sizes = np.array([len(x) for x in sets], np.int64)
                    owner, names = np.array(comps, np.int64), np.array(ids, np.int64)
                if not len(tokens):
                    continue
                where = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                where = where[tokens[where] == s]
                if len(where) < _needed(len(s), num, den):  # not even the union holds enough of it
                    continue
                both = matrix[where].sum(axis=0, dtype=np.int64)
                good = (den * both >= num * (len(s) + sizes - both)) & (owner != comp)
                out += [(rep, int(x)) for x in names[good]]
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def _packed(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """id, z: the packed whole texts of the stored ids."""
    wanted = docs.join(small(ids.withColumnRenamed("id", id_col)), id_col, "left_semi").select(id_col, "text")
    return store(arrow_map(wanted, _pack(id_col), "id long, z binary").dropDuplicates(["id"]), "packed")


def verify_pairs(docs: DataFrame, pairs: DataFrame, id_col: str, k: int, num: int, den: int) -> DataFrame:
    """a, b, near: stored pairs of ids whose whole texts are at least FAMILY similar; near from num/den on."""
    packed = _packed(docs, store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids"), id_col)
    left = packed.select(F.col("id").alias("a"), F.col("z").alias("za"))
    right = packed.select(F.col("id").alias("b"), F.col("z").alias("zb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb")
    return arrow_map(both, _compare(k, num, den), "a long, b long, near boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row per input row: id, n_shingles, component_id (smallest id reachable by links of similarity >= num/den)."""
    docs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    base = store(arrow_map(docs, _sets(k, "_id"), "id long, n long, h1 long, h2 long, bands array<long>, block int, part int, data binary"), "sets")
    counts = read_blocks(sum_blocks(base.filter("block is not null").select("block", "part", "data")), CELLS)
    sketch = spark.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32).tobytes())

    rows = base.filter("block is null").select("id", "n", "h1", "h2", "bands")
    real = rows.filter("n > 0 and id is not null")
    classes = store(real.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")

    # groups of similar documents
    spread = store(classes.select("rep", F.explode("bands").alias("band")), "bands")
    sizes = store(spread.groupBy("band").agg(F.min("rep").alias("lead"), F.count("*").alias("m")).filter("m > 1"), "buckets")
    member = spread.join(sizes, "band").select("band", "rep", "lead", "m")
    member = store(member, "member")
    degree = member.groupBy("rep").agg(F.sum("m").alias("degree"))
    ranked = member.join(degree, "rep").groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("best"))
    ranked = store(ranked.select("band", (-F.col("best.minus")).alias("hub")), "hubs")
    pairs = member.join(ranked, "band").select(F.explode(F.array(F.struct(F.col("rep").alias("a"), F.col("lead").alias("b")), F.struct(F.col("rep").alias("a"), F.col("hub").alias("b")))).alias("p")).select("p.*").filter("a <> b")
    pairs = store(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    like = store(verify_pairs(docs, pairs, "_id", k, num, den), "verified")
    links = like.filter("near").select("a", "b")
    comp = store(components(links).withColumnRenamed("id", "rep"), "comps")
    family = store(components(like.select("a", "b")).select(F.col("id").alias("rep"), F.col("comp").alias("lab")), "families")
    reps = classes.select("rep", "n").join(small(comp), "rep", "left").join(small(family), "rep", "left")
    reps = store(reps.select("rep", "n", F.coalesce("comp", "rep").alias("comp"), F.coalesce("lab", "rep").alias("lab")), "reps")

    # families in groups of bounded size: lab, chunk
    width = reps.groupBy("lab").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    width = store(width.filter("m > 1").withColumn("chunks", F.ceil(F.greatest(F.col("m") / GROUP_DOCS, F.col("tokens") / GROUP_TOKENS)).cast("int")), "widths")
    reps = reps.join(small(width.select("lab", "chunks")), "lab", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    reps = store(reps.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")), "groups")

    # inside a family: whoever is not yet linked with its largest component asks all its groups
    mixed = width.filter("lo <> hi").select("lab")
    some = reps.join(small(mixed), "lab", "left_semi")
    main = some.groupBy("lab", "comp").count().groupBy("lab").agg(F.max(F.struct("count", F.col("comp"))).alias("best"))
    main = store(main.select("lab", F.col("best.comp").alias("main")), "mains")
    within = some.join(small(main), "lab").filter("comp <> main").select("rep", "lab", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    # across families: the matrix of prefix tokens and groups
    prefix = arrow_map(docs, _prefixes(k, "_id", num, den, sketch), "id long, pre array<long>")
    prefix = prefix.withColumnRenamed("id", "rep").join(reps.select("rep", "n", "lab", "chunk"), "rep").select("rep", "n", "lab", "chunk", F.explode("pre").alias("token"))
    token = "partition by token"
    shared = prefix.withColumn("lo", F.expr(f"min(lab) over ({token})")).withColumn("hi", F.expr(f"max(lab) over ({token})"))
    shared = store(shared.filter("lo <> hi").select("token", "rep", "n", "lab", "chunk").distinct(), "shared")
    must = F.when(F.col("n") >= LONG_SET, EXTRA).otherwise(1)
    matrix = shared.groupBy("token", "lab", "chunk").agg(F.min(must).alias("least"), F.min("n").alias("low"), F.max("n").alias("high"))
    matrix = store(matrix.select("token", F.col("lab").alias("open"), F.col("chunk").alias("at"), "least", "low", "high"), "matrix")
    bound = shared.join(matrix, "token").filter("open < lab").filter((den * F.col("n") >= num * F.col("low")) & (num * F.col("n") <= den * F.col("high")))
    bound = bound.groupBy("rep", "open", "at").agg(F.count("*").alias("hits"), F.min("least").alias("least"), F.first(must).alias("own"))
    across = bound.filter(F.col("hits") >= F.least("least", "own")).select("rep", F.col("open").alias("lab"), F.col("at").alias("chunk"))

    opened = store(within.union(across).distinct(), "opened")
    parts = opened.groupBy("lab", "chunk").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("parts"))
    parts = store(parts, "parts")
    members = reps.join(small(parts), ["lab", "chunk"]).select("lab", "chunk", "rep", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("ask", F.lit(False))
    asking = opened.join(small(parts), ["lab", "chunk"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    asking = asking.join(reps.select("rep", "comp"), "rep").select("lab", "chunk", "rep", "comp", "part", F.lit(True).alias("ask"))
    table = store(members.unionByName(asking), "tables")
    packed = _packed(docs, store(table.select(F.col("rep").alias("id")).distinct(), "ids"), "_id")
    table = table.join(packed.withColumnRenamed("id", "rep"), "rep").repartition("lab", "chunk", "part").sortWithinPartitions("lab", "chunk", "part", "ask")
    more = arrow_map(table.select("lab", "chunk", "part", "ask", "rep", "comp", "z"), _open(k, num, den), "a long, b long")
    links = store(links.union(more), "all_links")

    comp = components(links).withColumnRenamed("id", "rep")
    named = store(classes.join(small(comp), "rep", "left").select("n", "h1", "h2", "copies", F.coalesce("comp", "rep").alias("component_id")).filter("copies > 1 or component_id is not null"), "named")
    out = rows.join(named.select("n", "h1", "h2", "component_id"), ["n", "h1", "h2"], "left")
    own = F.when((F.col("n") == 0) | F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
