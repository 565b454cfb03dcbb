"""Call sites over the supplied tables, and the decisions on them.

A site is a (supplier, part name) pair; what is decided about it depends on its identifier and its caller's
module only. So candidates are joined to, and decided for, the distinct (module, identifier, name) keys, and sites look
up the decision on their key. The number of keys grows with modules and names, not with sites.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.functions.storage import small, stored
from codegrove.operators import graph as G
from codegrove.operators import resolution as R

C = F.col


def _root(brand: str) -> Column:
    return F.concat(F.lit("root."), C(brand))


class CallSites:
    """Relations of the call sites of one graph; each is derived once and stored where it is read again."""

    def __init__(self, g):
        self.g = g

    @cached_property
    def _shipped(self) -> DataFrame:
        """l_suppkey, p_name, p_brand, bulk: a row per shipment."""
        part = stored(self.g.part.select(C("p_partkey").alias("l_partkey"), "p_name", "p_brand"))
        items = self.g.lineitem.select("l_suppkey", "l_partkey", F.coalesce(C("l_quantity") >= 50, F.lit(False)).alias("bulk"))
        return stored(items.join(small(part), "l_partkey").drop("l_partkey"))

    @cached_property
    def _home(self) -> DataFrame:
        """l_suppkey, brand: the brand a supplier ships most often."""
        per = self._shipped.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
        return stored(per.groupBy("l_suppkey").agg(F.max(F.struct("n", "p_brand")).alias("b")).select("l_suppkey", C("b.p_brand").alias("brand")))

    @cached_property
    def _pairs(self) -> DataFrame:
        return stored(self._shipped.select("l_suppkey", "p_name").distinct().join(small(self._home), "l_suppkey"))

    @cached_property
    def sites(self) -> DataFrame:
        """site, identifier, caller_module, p_name, key."""
        full = F.concat(_root("brand"), F.lit("."), C("p_name"))
        return self._pairs.select(
            F.concat_ws("/", C("l_suppkey").cast("string"), "p_name").alias("site"), F.when(C("l_suppkey") % 2 == 0, C("p_name")).otherwise(full).alias("identifier"),
            _root("brand").alias("caller_module"), "p_name",
        ).withColumn("key", F.to_json(F.array("caller_module", "identifier", "p_name")))

    @cached_property
    def keys(self) -> DataFrame:
        """site (the key), identifier, caller_module, p_name, sites (their number)."""
        per = self.sites.groupBy("key", "identifier", "caller_module", "p_name").agg(F.count("*").alias("sites"))
        return stored(per.withColumnRenamed("key", "site"))

    @cached_property
    def parts(self) -> DataFrame:
        """p_name, candidate, n, name, module: the n parts of a name and brand, with their smallest key."""
        per = self.g.part.groupBy("p_name", "p_brand").agg(F.min(C("p_partkey").cast("string")).alias("candidate"), F.count_distinct("p_partkey").alias("n"))
        return stored(per.select("p_name", "candidate", "n", F.concat(_root("p_brand"), F.lit("."), C("p_name")).alias("name"), _root("p_brand").alias("module")))

    @cached_property
    def candidates(self) -> DataFrame:
        """site (the key), candidate, n, name, module, direct."""
        return self.keys.select("site", "p_name").join(self.parts, "p_name").select("site", "candidate", "n", "name", "module", F.lit(False).alias("direct"))

    @cached_property
    def scopes(self) -> DataFrame:
        """caller_module, module: the brands of a caller's bulk shipments."""
        bulk = self._shipped.filter("bulk").select("l_suppkey", "p_brand").distinct().join(small(self._home), "l_suppkey")
        return stored(bulk.select(_root("brand").alias("caller_module"), _root("p_brand").alias("module")).distinct())

    @cached_property
    def distances(self) -> DataFrame:
        """caller_module, module, distance of all modules reached over one import or more."""
        far = G.closure(self.scopes.select(C("caller_module").alias("src"), C("module").alias("dst")))
        return far.select(C("src").alias("caller_module"), C("dst").alias("module"), "distance")

    @cached_property
    def decisions(self) -> DataFrame:
        """The gate's decision on each key (site), with the key's identifier, caller_module and number of sites."""
        made = R.strict_gate(self.keys.select("site", "identifier", "caller_module"), self.candidates, self.scopes, self.distances)
        return stored(made.join(self.keys.drop("p_name"), "site"))

    def each(self, per_key: DataFrame, how: str = "inner") -> DataFrame:
        """A row per site from rows per key, whose column site is the key."""
        own = [c for c in per_key.columns if c != "site"]
        rows = self.sites.select("site", "key").join(small(stored(per_key.withColumnRenamed("site", "key"))), "key", how)
        return rows.select("site", *own)
