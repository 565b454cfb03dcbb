"""The call contract: candidates of call sites, one decision per site, and what of it is kept.

Works on all sites at once. A site has an identifier and the module of its caller; candidates are found by the whole
identifier, or, where that finds none, by its last part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codegrove.functions import names as N

C = F.col

# Provenances that are kept, reasons of drops, outcomes of the gate, hints per site.
KEPT_PROVENANCE = ["exact_qname", "module_scoped", "import_narrowed", "export_chain_narrowed"]
DROP_REASONS = ["no_candidates", "unique_without_provenance", "ambiguous_no_caller_module", "ambiguous_no_in_scope_candidate", "ambiguous_multiple_in_scope_candidates"]
HINTS = 8


def symbol_keys(symbols: DataFrame) -> DataFrame:
    """symbol, candidate, name, module: each symbol by its name and its last part; a constructor by its class as well."""
    q = C("name")
    built = N.terminal(q).isin(N.CONSTRUCTORS)
    owner = F.when(built, N.qualifier(q))
    keys = F.array_compact(F.array(q, N.terminal(q), owner, F.when(built, N.terminal(owner))))
    return symbols.select(F.explode(F.array_distinct(keys)).alias("symbol"), "candidate", "name", "module")


def probe(sites: DataFrame, index: DataFrame) -> DataFrame:
    """site, candidate, name, module, direct: candidates by the whole identifier, else by its last part."""
    full = sites.join(index, C("identifier") == C("symbol")).select("site", "candidate", "name", "module", F.lit(True).alias("direct"))
    rest = sites.filter(C("identifier").contains(".")).join(index.select("symbol").distinct(), C("identifier") == C("symbol"), "left_anti")
    last = rest.select("site", N.terminal(C("identifier")).alias("symbol")).join(index, "symbol").select("site", "candidate", "name", "module", F.lit(False).alias("direct"))
    return full.unionByName(last)


def within_scope(pairs: DataFrame, scopes: DataFrame) -> DataFrame:
    """The pairs (caller_module, module) whose module, or one above it, is in the caller's scope or is the caller's module."""
    up = pairs.select("caller_module", "module", F.explode(N.prefixes(C("module"))).alias("up"))
    own = up.filter("up = caller_module").select("caller_module", "module")
    far = up.join(scopes.select("caller_module", C("module").alias("up")), ["caller_module", "up"], "left_semi").select("caller_module", "module")
    return own.unionByName(far).distinct()


def reachable_modules(callers: DataFrame, scopes: DataFrame, reach: DataFrame, barrels: DataFrame) -> DataFrame:
    """caller_module, module: a caller's own module, those above it, its direct and transitive imports, and what barrels among its own module and imports export.

    barrels(module, target). A null or empty caller module reaches nothing.
    """
    own = callers.select("caller_module").filter("caller_module <> ''").distinct()
    imports = scopes.select("caller_module", "module").unionByName(reach.select("caller_module", "module")).join(own, "caller_module", "left_semi")
    looked = own.select("caller_module", C("caller_module").alias("module")).unionByName(imports).distinct()
    above = own.select("caller_module", F.explode(N.ancestors(C("caller_module"))).alias("module"))
    exported = looked.join(barrels.select("module", "target"), "module").select("caller_module", C("target").alias("module"))
    return looked.unionByName(above).unionByName(exported).distinct()


def decide(sites: DataFrame, candidates: DataFrame, scopes: DataFrame, reach: DataFrame, descendants: bool = False) -> DataFrame:
    """site, accepted, provenance, dropped_reason, candidate_count, in_scope_count, module_hints.

    sites(site, identifier, caller_module), candidates as probe gives them; scopes and reach (caller_module, module) are
    direct and transitive imports. descendants lets modules below those in scope count among several candidates.
    """
    c = sites.join(candidates.distinct(), "site", "left")
    pairs = c.select("caller_module", "module").filter("module is not null").distinct()
    near_pairs = within_scope(pairs, scopes) if descendants else scopes.select("caller_module", "module").distinct()
    c = c.join(near_pairs.withColumn("is_direct", F.lit(True)), ["caller_module", "module"], "left")
    c = c.join(within_scope(pairs, reach).withColumn("is_reached", F.lit(True)), ["caller_module", "module"], "left")
    ident, name, module = C("identifier"), C("name"), C("module")
    dotted, same = ident.contains("."), module == C("caller_module")
    above = F.array_contains(N.ancestors(C("caller_module")), module)
    exact = dotted & (name == ident)
    near = F.coalesce(same, F.lit(False)) | F.coalesce(above, F.lit(False)) | F.coalesce("is_direct", F.lit(False))
    shaped = dotted & (N.is_constructor_of(name, ident) | N.same_proxy(name, ident) | F.coalesce(N.carried(name, ident, module), F.lit(False)) | C("direct"))
    sets = {"all": C("candidate").isNotNull(), "named": exact, "owned": exact & (module == N.qualifier(ident)), "near": near & C("candidate").isNotNull(), "tail": near & dotted & N.same_tail(name, ident)}
    aggs = []
    for k, cond in sets.items():
        cond = F.coalesce(cond, F.lit(False))
        aggs += [F.count_if(cond).alias(f"n_{k}"), F.min(F.when(cond, C("candidate"))).alias(f"c_{k}"), F.min(F.when(cond, module)).alias(f"m_{k}")]
    flags = [F.coalesce(F.bool_or(x), F.lit(False)).alias(a) for a, x in (("same", same), ("above", above), ("reached", C("is_reached")), ("shaped", shaped))]
    g = c.groupBy("site", "identifier", "caller_module").agg(*aggs, *flags)

    def took(who: str, why: Column | str) -> Column:
        return F.struct(C(who).alias("a"), (F.lit(why) if isinstance(why, str) else why).alias("p"), F.lit(None).cast("string").alias("d"), F.lit(1).cast("long").alias("n"))

    def left(why: str, n: Column | int = 0) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(none.alias("a"), none.alias("p"), F.lit(why).alias("d"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))

    one = C("n_all") == 1
    ladder = [
        (C("n_all") == 0, left("no_candidates")), (C("n_named") == 1, took("c_named", "exact_qname")), ((C("n_named") > 1) & (C("n_owned") == 1), took("c_owned", "exact_qname")),
        (one & C("shaped"), took("c_all", "exact_qname")), (one & C("same"), took("c_all", "module_scoped")), (one & (C("above") | C("reached")), took("c_all", "import_narrowed")),
        (one, left("unique_without_provenance")), (C("caller_module").isNull(), left("ambiguous_no_caller_module")), (C("n_near") == 1, took("c_near", "import_narrowed")),
        ((C("n_near") > 1) & (C("n_tail") == 1), took("c_tail", F.when(C("m_tail") == C("caller_module"), "module_scoped").otherwise("import_narrowed"))),
        (C("n_near") == 0, left("ambiguous_no_in_scope_candidate")),
    ]
    out = F.when(*ladder[0])
    for cond, what in ladder[1:]:
        out = out.when(cond, what)
    out = out.otherwise(left("ambiguous_multiple_in_scope_candidates", C("n_near")))
    first = W.partitionBy("site").orderBy("module")
    shown = candidates.filter("module is not null").select("site", "module").distinct().withColumn("k", F.row_number().over(first)).filter(C("k") <= HINTS)
    shown = shown.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("module")), ",").alias("module_hints"))
    made = g.withColumn("o", out).select("site", "identifier", "caller_module", C("o.a").alias("accepted"), C("o.p").alias("provenance"), C("o.d").alias("dropped_reason"), C("n_all").alias("candidate_count"), C("o.n").alias("in_scope_count"))
    return made.join(shown, "site", "left").withColumn("module_hints", F.coalesce("module_hints", F.lit("")))


def gate_reason(status: Column, accepted: Column, provenance: Column, dropped: Column, candidates: Column, in_repo: Column) -> Column:
    """Why an observation is not kept; null for one that is."""
    bad = F.lit("invalid_observation_shape")
    ok = status == "accepted"
    drop = status == "dropped"
    return (
        F.when(candidates <= 0, "no_in_repo_candidate").when(ok & (F.coalesce(accepted, F.lit("")).eqNullSafe(F.lit("")) | dropped.isNotNull()), bad)
        .when(ok & ~F.coalesce(provenance.isin(KEPT_PROVENANCE), F.lit(False)), bad).when(ok & ~F.coalesce(in_repo, F.lit(False)), "outside_in_repo_scope")
        .when(ok, F.lit(None).cast("string")).when(drop & (accepted.isNotNull() | provenance.isNotNull() | dropped.isNull()), bad)
        .when(drop & ~dropped.isin(DROP_REASONS), bad).when(drop, "insufficient_static_evidence").otherwise(bad)
    )
