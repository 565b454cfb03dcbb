"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). On the driver, a flow
routes each pattern's tokens to the quotas of its sources; each further repetition of a document
costs more than the one before (convex), so tokens are repeated only where quotas need it. A
pattern's whole repetitions go to all its documents; the remainder goes to documents in the order of a
seeded hash, cut by cumulated sizes of hash ranges, so no group is ever sorted in one task.

Only pattern and source totals reach the driver; more than MAX_PATTERNS patterns are an error.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, fresh, small, store

#: A document is taken at most this often, and a target is at most this many times its source's size.
MOST = 3
MAX_PATTERNS = 100_000
SEED = 20
_DIGIT = 12


def text_size(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_RE)
    ends = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Shares of the total by weight; a share above most * size stops there, and the excess is shared again."""
    total, fixed, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while len(fixed) < len(sizes):
        left = total - sum(out[i] for i in fixed)
        weight = sum(weights[i] for i in range(len(sizes)) if i not in fixed)
        if weight <= 0:
            break
        for i in range(len(sizes)):
            if i not in fixed:
                out[i] = left * weights[i] / weight
        over = [i for i in range(len(sizes)) if i not in fixed and out[i] > most * sizes[i]]
        if not over:
            break
        for i in over:
            out[i] = float(most * sizes[i])
            fixed.add(i)
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[float], most: int = MOST) -> list[int]:
    """Tokens taken of each pattern ((source numbers), size) by successive cheapest paths."""
    n, m = len(patterns), len(quotas)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(a: int, b: int, capacity: int, price: int) -> None:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[x].append(len(to))
            to.append(y), room.append(c), cost.append(p)

    for i, (members, size) in enumerate(patterns):
        for k in range(most):
            arc(source, i, size, k * k)
        for s in members:
            arc(i, n + s, most * size, 0)
    for s, q in enumerate(quotas):
        arc(n + s, sink, round(q), 0)
    height = [0] * (n + m + 2)
    while True:
        best: list[float] = [float("inf")] * (n + m + 2)
        via = [-1] * (n + m + 2)
        best[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > best[x]:
                continue
            for e in graph[x]:
                if room[e] > 0 and (c := d + cost[e] + height[x] - height[to[e]]) < best[to[e]]:
                    best[to[e]], via[to[e]] = c, e
                    heapq.heappush(heap, (c, to[e]))
        if best[sink] == float("inf"):
            break
        for x in range(len(height)):
            if best[x] < float("inf"):
                height[x] += int(best[x])
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    return [sum(room[e ^ 1] for e in graph[i] if n <= to[e] < n + m) for i in range(n)]


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", size_col: str = "size", sources_col: str = "sources", seed: int = SEED, most: int = MOST, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Rows of docs(id, size long, sources array<string>; columns `keep`, all by default) with copies (0..most), source_size and target of the first source.

    A source's size counts all documents that belong to it. Sources are ordered by code point, null
    last; without weights they weigh 1, 2, 3, repeating. A null array is membership of the null
    source. Sizes of null count 0. An empty table gives an empty result; repeated rows share their
    fate, as the choice depends on id, size and sources alone. prefix begins the names of the columns made;
    columns of docs that have such a name are replaced.
    """
    spark = docs.sparkSession
    nothing = F.array(F.lit(None).cast("string"))
    made = [prefix + c for c in ("source_size", "target", "copies")]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in made]
    whole = docs.select(F.struct(*columns).alias("_all"), F.col(id_col).alias("_id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"), F.array_sort(F.array_distinct(F.coalesce(F.col(sources_col), nothing))).alias("_in"))
    whole = whole.withColumn("_key", F.to_json(F.struct("_in"), {"ignoreNullFields": "false"}))
    u = F.xxhash64(F.col("_id"), F.lit(seed))
    whole = whole.withColumn("_d1", F.shiftrightunsigned(u, 64 - _DIGIT)).withColumn("_d2", F.shiftrightunsigned(u, 64 - 2 * _DIGIT).bitwiseAND(F.lit((1 << _DIGIT) - 1).cast("long")))
    rows = store(whole.select("_key", "_in", "_size", "_d1", "_d2"), "sizes")
    found = rows.groupBy("_key").agg(F.first("_in").alias("members"), F.sum("_size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: r["_key"])
    names = sorted({x for r in found for x in r["members"]}, key=lambda x: (x is None, x or ""))
    number = {x: i for i, x in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for x in r["members"]:
            sizes[number[x]] += r["size"]
    weight = [1.0 + i % 3 for i in range(len(names))] if weights is None else [float(weights.get(x, 0)) for x in names]
    quota = targets(sizes, weight, most)
    taken = route([(tuple(number[x] for x in r["members"]), r["size"]) for r in found], quota, most)
    plan = [(r["_key"], t // r["size"] if r["size"] else 0, t % r["size"] if r["size"] else 0, sizes[number[r["members"][0]]], quota[number[r["members"][0]]]) for r, t in zip(found, taken)]
    plan = spark.createDataFrame(plan, "_key string, base long, rest long, source_size long, target double")
    plan = store(plan, "plan")

    # where the remainder ends: a range of the first digit, then one of the second
    def cut(sums: DataFrame, digit: str, rest: str) -> DataFrame:
        run = sums.withColumn("upto", F.expr(f"sum(s) over (partition by _key order by {digit})"))
        return run.filter((F.col("upto") > F.col(rest)) & (F.col("upto") - F.col("s") <= F.col(rest)))

    one = rows.groupBy("_key", "_d1").agg(F.sum("_size").alias("s")).join(small(plan), "_key")
    one = store(cut(one, "_d1", "rest").select("_key", F.col("_d1").alias("edge1"), (F.col("rest") - F.col("upto") + F.col("s")).alias("rest2")), "edge")
    two = rows.join(small(one), "_key").filter("_d1 = edge1").groupBy("_key", "_d2", "rest2").agg(F.sum("_size").alias("s"))
    two = cut(two, "_d2", "rest2").select("_key", F.when(F.col("upto") - F.col("rest2") <= F.col("rest2") - F.col("upto") + F.col("s"), F.col("_d2")).otherwise(F.col("_d2") - 1).alias("edge2"))
    edges = store(plan.join(one.select("_key", "edge1"), "_key", "left").join(two, "_key", "left"), "edges")
    more = (F.col("_d1") < F.col("edge1")) | ((F.col("_d1") == F.col("edge1")) & (F.col("_d2") <= F.col("edge2")))
    copies = F.least(F.lit(most).cast("long"), F.col("base") + F.when(more & (F.col("rest") > 0), 1).otherwise(0))
    return whole.join(small(edges), "_key").select("_all.*", *(x.alias(c) for x, c in zip((F.col("source_size"), F.col("target"), copies), made)))


def repeated(docs: DataFrame, copies: Column) -> DataFrame:
    """Rows as often as copies says (0: none)."""
    n = fresh("_n", docs.columns)
    return docs.withColumn(n, copies).filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long")))).drop(n)
