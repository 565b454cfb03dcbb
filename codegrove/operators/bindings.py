"""Local binding facts of call sites: which one an identifier matches, and the names they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegrove.functions import names as N

C = F.col

# Kinds of bindings by what they do with the rest of an identifier; stages in order.
ALIAS_KINDS = ["module_alias", "namespace_alias", "static_member_receiver"]
CLASS_KIND = "constructor_or_classifier_import"
DIRECT_KINDS = ["direct_import_symbol", "destructured_static_member", "static_export_surface", "static_import_member"]
STAGES = ["receiver_typed_or_instance_mapped", "import_or_member_alias_narrowing", "classifier_scoped_fallback", "module_scoped_fallback"]
LAST_STAGE = "terminal_fallback"


def _head(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def matches(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """id, symbol, target, binding_kind: the first fact on an identifier's first part, else the first on its last part.

    sites(id, scope, identifier), facts(scope, pos, symbol, target, binding_kind). Identifiers without a fact have no row.
    """
    name = F.trim("identifier")
    keys = F.array_distinct(F.array(F.struct(_head(name).alias("symbol"), F.lit(1).alias("stage")), F.struct(N.terminal(name).alias("symbol"), F.when(_head(name) == N.terminal(name), 1).otherwise(2).alias("stage"))))
    asked = sites.filter(F.coalesce(name, F.lit("")) != "").select("id", "scope", F.explode(keys).alias("k")).select("id", "scope", "k.symbol", "k.stage")
    both = asked.join(facts, ["scope", "symbol"])
    first = both.groupBy("id").agg(F.min(F.struct("stage", "pos", "symbol", "target", "binding_kind")).alias("f"))
    return first.select("id", "f.symbol", "f.target", "f.binding_kind")


def candidates(sites: DataFrame, facts: DataFrame) -> DataFrame:
    """id, candidate: names that the facts on an identifier lead to.

    Aliases carry on with the rest of a dotted identifier, classes with or without one; direct imports hold for
    undotted identifiers only.
    """
    name = F.trim("identifier")
    asked = sites.filter(F.coalesce(name, F.lit("")) != "").select("id", "scope", _head(name).alias("symbol"), F.when(name.contains("."), F.expr("substr(trim(identifier), instr(trim(identifier), '.') + 1)")).alias("rest"))
    both = asked.join(facts.filter(F.trim(F.coalesce("target", F.lit(""))) != ""), ["scope", "symbol"])
    kind, rest = C("binding_kind"), C("rest")
    full = F.concat_ws(".", "target", "rest")
    made = F.when(kind.isin(ALIAS_KINDS) & rest.isNotNull(), full).when(kind == CLASS_KIND, full).when(kind.isin(DIRECT_KINDS) & rest.isNull(), C("target"))
    return both.select("id", made.alias("candidate")).filter("candidate is not null").distinct()


def first_stage(found: dict[str, Column], terminal: Column) -> Column:
    """candidate and stage of the first stage that found a name; the last part of the identifier where none did."""
    made = [F.when(F.coalesce(found[s], F.lit("")) != "", F.struct(found[s].alias("candidate"), F.lit(s).alias("stage"))) for s in STAGES if s in found]
    return F.coalesce(*made, F.struct(terminal.alias("candidate"), F.lit(LAST_STAGE).alias("stage")))
