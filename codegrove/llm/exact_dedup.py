"""Exact deduplication with two passes over Bloom filters, in built-in expressions only.

Pass 1 counts one hash slot of each normalised text; slots that two or more rows hit are the bits of a filter. Pass 2 reads
the rows again: a text whose slot is unset occurs once, and its row passes straight through. Only the other rows are
shuffled, by digest. A filter has BITS_PER_ROW bits a row and no more than MOST_BITS; more rows than that has room for are
dealt, without a shuffle, into slices of the hash range, each with a filter of its own, so filters stay as selective at any
size. False hits only let rows into the shuffle; they never change the result.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, store

#: Bits of a filter: BITS_PER_ROW for each row, between the two bounds (the upper one is 16 MB).
BITS_PER_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 27

# White space that is not already one plain space.
_UNEVEN = r"(?:[\x09-\x0D]|\x20(?=[\x20\x09-\x0D]))[\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    """Text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: the array of 64-bit words of the slots that two or more of the hashes (_h) hit."""
    hit = hashes.groupBy(_slot(F.col("_h"), bits).alias("slot")).count().filter("count > 1")
    words = hit.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    dense = hashes.sparkSession.range(bits >> 6).withColumnRenamed("id", "word").join(words, "word", "left")
    parts = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    return dense.agg(F.transform(parts, lambda x: x["bits"]).alias("words"))


def _slot(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit(bits - 1).cast("long"))


def _slice(h: Column, slices: int) -> Column:
    """Slice of a hash, from bits that slots do not use."""
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(slices).cast("long")).cast("int")


def _is_set(words: Column, slot: Column) -> Column:
    return F.getbit(F.get(words, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def _sliced(rows: DataFrame, slices: int) -> list[DataFrame]:
    """The rows of each slice of the hash range (_h); written in one pass without a shuffle where there are several."""
    if slices == 1:
        return [rows]
    path = f"{shared_dir(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    rows.withColumn("_slice", _slice(F.col("_h"), slices)).write.partitionBy("_slice").parquet(path)
    back = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(path)
    return [back.filter(F.col("_slice") == s).drop("_slice") for s in range(slices)]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, wide: bool | None = None, most_bits: int = MOST_BITS, prefix: str = "") -> DataFrame:
    """Rows of docs (columns `keep`, all by default) with keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays; a null id comes last, and of rows
    that repeat the id as well exactly one stays. Null texts equal empty ones. All rows are
    returned, dropped ones too. An empty table gives an empty result. Columns of docs that have a
    name of the result's are replaced by it. wide: the kept columns hold whole texts, so rows are read
    twice rather than written (by default where text_col is kept). most_bits, a power of two, bounds one filter. prefix begins the names of the result's columns.
    """
    made = [prefix + c for c in ("keep_id", "group_size", "kept", "text_sha256")]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in made]
    n = docs.count()
    # kept columns travel as one struct, so that their names meet no others
    kept = [F.struct(*columns).alias("_all"), F.col(id_col).alias("_id")]
    if not (text_col in columns if wide is None else wide):  # normalise and hash each text once, and go on from the digests
        rows = store(docs.select(*kept, F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("_key")), "digests")
        sha = F.col("_key")
    else:
        rows = docs.select(*kept, normalised(F.col(text_col)).alias("_key"))
        sha = F.sha2(F.col("_key").cast("binary"), 256)
    rows = rows.withColumn("_h", F.xxhash64("_key"))
    slices = max(1, math.ceil(n * BITS_PER_ROW / most_bits))
    bits = min(most_bits, max(LEAST_BITS, 1 << math.ceil(math.log2(max(1, BITS_PER_ROW * n / slices)))))

    out: DataFrame | None = None
    for part in _sliced(rows, slices):
        words = store(repeated_filter(part.select("_h"), bits), "bits").scalar()
        seen = _is_set(words, _slot(F.col("_h"), bits))
        once = part.filter(~seen).select("_all.*", *(x.alias(c) for x, c in zip((F.col("_id"), F.lit(1).cast("long"), F.lit(True), sha), made)))
        # rows are numbered as they are written: a later read may split the files otherwise, and would number them otherwise
        maybe = store(part.filter(seen).select("_all", "_id", sha.alias("_sha"), F.monotonically_increasing_id().alias("_row")), "repeated")
        first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row"))
        groups = store(maybe.groupBy("_sha").agg(first.alias("_first"), F.count("*").alias("_size")), "groups")
        joined = maybe.join(groups, "_sha")
        many = joined.select("_all.*", *(x.alias(c) for x, c in zip((F.col("_first._id"), F.col("_size"), F.col("_row") == F.col("_first._row"), F.col("_sha")), made)))
        both = once.unionByName(many)
        out = both if out is None else out.unionByName(both)
    return out
