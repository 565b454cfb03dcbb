"""Strict resolution of call sites to callables, for all callers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.functions.names import ancestors, qualifier, terminal


def symbol_index(nodes: DataFrame) -> DataFrame:
    """symbol, structural_id: each callable by its qualified and its terminal name."""
    return nodes.filter("node_type = 'callable'").select("structural_id", F.explode(F.array("qualified_name", terminal(F.col("qualified_name")))).alias("symbol")).distinct()


def normalise_identifiers(sites: DataFrame, scope: list[str]) -> DataFrame:
    """An unqualified identifier becomes the one qualified form of its terminal in its scope, if there is exactly one."""
    keyed = sites.withColumn("terminal", terminal(F.col("identifier")))
    forms = keyed.filter(F.col("identifier").contains(".")).groupBy(*scope, "terminal").agg(F.min("identifier").alias("form"), F.max("identifier").alias("other")).filter("form = other").drop("other")
    plain = ~F.col("identifier").contains(".")
    return keyed.join(forms, [*scope, "terminal"], "left").withColumn("normalised", F.when(plain, F.coalesce("form", "identifier")).otherwise(F.col("identifier"))).drop("form", "terminal")


def strict_gate(sites: DataFrame, candidates: DataFrame, scopes: DataFrame, reach: DataFrame) -> DataFrame:
    """Decision per call site.

    sites(site, identifier, caller_module), candidates(site, candidate, name, module, direct),
    scopes(caller_module, module): direct imports; reach(caller_module, module): transitive ones.
    Returns site, accepted, provenance, dropped_reason, candidate_count, in_scope_count.
    n candidates that share name, module and direct may be one row with the smallest of them and a column n.

    Several exact names go to the one in the identifier's qualifier. A single candidate is
    accepted by name, by its own module, an enclosing module, or anything the caller reaches. Among several,
    one in the caller's direct scope is; a unique match on the last three segments decides a tie.
    """
    c = sites.join(candidates.distinct(), "site", "left")
    c = c.join(scopes.select("caller_module", "module").distinct().withColumn("is_direct", F.lit(True)), ["caller_module", "module"], "left")
    c = c.join(reach.select("caller_module", "module").distinct().withColumn("is_reached", F.lit(True)), ["caller_module", "module"], "left")
    dotted = F.col("identifier").contains(".")
    same = F.col("module") == F.col("caller_module")
    above = F.array_contains(ancestors(F.col("caller_module")), F.col("module"))
    near = F.coalesce(same, F.lit(False)) | F.coalesce(above, F.lit(False)) | F.coalesce("is_direct", F.lit(False))
    tail = lambda x: F.array_join(F.slice(F.split(x, r"\."), -3, 3), ".")
    long = (F.size(F.split("identifier", r"\.")) >= 3) & (F.size(F.split("name", r"\.")) >= 3)
    named = dotted & (F.col("name") == F.col("identifier"))
    weight = F.col("n") if "n" in candidates.columns else F.lit(1).cast("long")
    pick = lambda cond: (F.coalesce(F.sum(F.when(cond, weight)), F.lit(0).cast("long")), F.min(F.when(cond, F.col("candidate"))))
    parts = {"all": F.col("candidate").isNotNull(), "named": named, "owned": named & (F.col("module") == qualifier(F.col("identifier"))), "near": near & F.col("candidate").isNotNull(), "tail": near & dotted & long & (tail(F.col("name")) == tail(F.col("identifier")))}
    aggs = []
    for k, cond in parts.items():
        n, one = pick(F.coalesce(cond, F.lit(False)))
        aggs += [n.alias(f"n_{k}"), one.alias(f"c_{k}")]
    flag = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    g = c.groupBy("site", "identifier", "caller_module").agg(*aggs, flag(same).alias("same"), flag(above).alias("above"), flag(F.col("is_reached")).alias("reached"), flag(F.col("direct") & dotted).alias("by_name"))
    exact = F.lit("exact_qname")
    narrowed = F.lit("import_narrowed")
    out = F.when(F.col("n_all") == 0, F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("p"), F.lit("no_candidates").alias("d")))

    def hit(who: str, why):
        return F.struct(F.col(who).alias("a"), why.alias("p"), F.lit(None).cast("string").alias("d"))

    def drop(why: str):
        return F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("p"), F.lit(why).alias("d"))

    one = F.col("n_all") == 1
    out = (
        out.when(F.col("n_named") == 1, hit("c_named", exact)).when((F.col("n_named") > 1) & (F.col("n_owned") == 1), hit("c_owned", exact))
        .when(one & F.col("by_name"), hit("c_all", exact)).when(one & F.col("same"), hit("c_all", F.lit("module_scoped")))
        .when(one & F.col("above"), hit("c_all", narrowed)).when(one & F.col("reached"), hit("c_all", narrowed))
        .when(one, drop("unique_without_provenance"))
        .when(F.col("caller_module").isNull(), drop("ambiguous_no_caller_module"))
        .when(F.col("n_near") == 1, hit("c_near", narrowed))
        .when((F.col("n_near") > 1) & (F.col("n_tail") == 1), hit("c_tail", narrowed))
        .when(F.col("n_near") == 0, drop("ambiguous_no_in_scope_candidate"))
        .otherwise(drop("ambiguous_multiple_in_scope_candidates"))
    )
    return g.withColumn("o", out).select("site", F.col("o.a").alias("accepted"), F.col("o.p").alias("provenance"), F.col("o.d").alias("dropped_reason"), F.col("n_all").alias("candidate_count"), F.col("n_near").alias("in_scope_count"))


def best_by_path(candidates: DataFrame) -> DataFrame:
    """site, best: the candidate with the shallowest module, then by module, name and id."""
    order = F.struct(F.size(F.split("module", r"\.")), "module", "name", "candidate")
    return candidates.groupBy("site").agg(F.min_by("candidate", order).alias("best"))


def best_by_distance(candidates: DataFrame, distances: DataFrame) -> DataFrame:
    """site, best, distance: the candidate fewest imports away from the caller's module, then by depth, name and id.

    candidates(site, caller_module, candidate, name, module), distances(caller_module, module, distance).
    The caller's own module is at 0; candidates that are not reached come last, with a null distance.
    """
    d = candidates.join(distances, ["caller_module", "module"], "left")
    far = F.when(F.col("module") == F.col("caller_module"), 0).otherwise(F.col("distance"))
    order = F.struct(F.coalesce(far, F.lit(1 << 30)), F.size(F.split("name", r"\.")), F.col("name"), F.col("candidate"))
    return d.groupBy("site").agg(F.min(F.struct(order.alias("o"), far.alias("distance"))).alias("m")).select("site", F.col("m.o.candidate").alias("best"), F.col("m.distance").cast("long").alias("distance"))


def rescue(decisions: DataFrame, sites: DataFrame, candidates: DataFrame, distances: DataFrame) -> DataFrame:
    """Decisions in which an ambiguous drop goes to its nearest candidate, if the caller reaches that one's module.

    Only rows still dropped are looked at; the nearest candidate is checked again before it is accepted.
    """
    open_ = decisions.filter(F.col("dropped_reason").startswith("ambiguous")).select("site")
    c = candidates.join(open_, "site", "left_semi").join(sites.select("site", "caller_module"), "site")
    near = best_by_distance(c, distances).filter("distance is not null").select("site", "best")
    both = decisions.join(near, "site", "left")
    saved = F.col("best").isNotNull()
    return both.select(
        "site", F.coalesce("accepted", "best").alias("accepted"), F.when(saved, "import_narrowed").otherwise(F.col("provenance")).alias("provenance"),
        F.when(~saved, F.col("dropped_reason")).alias("dropped_reason"), saved.alias("rescued"),
    )
