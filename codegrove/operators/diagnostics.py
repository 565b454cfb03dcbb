"""Why call sites were rejected: ladders over an identifier, its file and the reason of its drop."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegrove.functions.names import RECEIVERS, fixture_path, repeats_segment, terminal

# Names and parts of identifiers the ladders look for.
CHAIN_PARTS = [".then", ".catch"]
MEMBER_PARTS = [".finally", ".in(", ".emit"]
MEMBER_TERMINALS = ["filter", "find", "flatMap", "forEach", "includes", "map", "reduce", "slice", "some", "has", "keys", "values", "entries"]
NAMESPACE_PARTS = [".server.", ".notifications.", ".tools."]
INDEX_PART = ".index."
OUTSIDE = ["fixture_or_generated_shape", "fluent_or_promise_chain_shape", "dynamic_member_terminal_shape", "runtime_composed_surface_shape"]
THIN = ["namespace_or_module_object_miss_shape", "no_in_repo_callable_target"]


def _any_part(text: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def drop_bucket(identifier: Column, fixture: Column, reason: Column, candidates: Column) -> Column:
    """Bucket of a persisted drop; fixture says whether its file is a fixture or generated."""
    name, why = F.coalesce(identifier, F.lit("")), F.coalesce(reason, F.lit(""))
    n = F.coalesce(candidates, F.lit(0))
    return (
        F.when(fixture, "fixture_or_generated_shape").when(_any_part(name, CHAIN_PARTS), "fluent_or_promise_chain_shape")
        .when(_any_part(name, MEMBER_PARTS) | terminal(name).isin(MEMBER_TERMINALS), "dynamic_member_terminal_shape")
        .when(_any_part(name, NAMESPACE_PARTS), "namespace_or_module_object_miss_shape")
        .when((why == "unique_without_provenance") & (n == 1) & name.contains(INDEX_PART), "runtime_composed_surface_shape")
        .when((why == "no_candidates") | (n <= 0), "no_in_repo_callable_target").otherwise("unclassified_persisted_drop")
    )


def public_bucket(bucket: Column, reason: Column) -> Column:
    """The reported bucket of a drop bucket."""
    why = F.coalesce(reason, F.lit(""))
    return (
        F.when(bucket.isin(OUTSIDE), "outside_static_contract").when(bucket.isin(THIN), "insufficient_static_evidence")
        .when(why == "invalid_observation_shape", "structural_mismatch").when(why != "", "insufficient_static_evidence").otherwise("unclassified")
    )


def name_signals(identifier: Column) -> Column:
    """Sorted tags of an identifier's form: its depth, whether it is qualified, and how its owner is written."""
    parts = F.filter(F.split(identifier, r"\."), lambda p: p != "")
    n = F.size(parts)
    owner = F.substring(F.get(parts, n - 2), 1, 1)
    typed = (owner != F.lower(owner)) & (owner == F.upper(owner))
    tags = F.array(
        F.when(n > 0, F.concat(F.lit("identifier_depth:"), n.cast("string"))),
        F.when(identifier.contains("."), "qualified_identifier").otherwise("terminal_identifier"),
        F.when((n >= 2) & typed, "owner_segment:type_like").when(n >= 2, "owner_segment:value_like"),
    )
    return F.array_sort(F.array_compact(tags))

# Terminals of dynamic members, and of fluent chains; roots of dynamic receivers.
DYNAMIC_TERMINALS = ["then", "catch", "finally", "map", "filter", "reduce", "slice", "some", "has", "keys", "values", "entries", "includes", "push", "pop", "clear"]
FLUENT_TERMINALS = ["then", "catch", "finally"]


def is_inline_chain(identifier: Column) -> Column:
    return identifier.contains(".in(") | (identifier.contains("(") & identifier.contains(")."))


def has_inline_call(identifier: Column) -> Column:
    return identifier.contains(".") & (identifier.contains("(") | identifier.contains("[") | identifier.contains("]"))


def binding_reason(target: Column, kind: Column, dropped: Column, positive: bool) -> Column:
    """Reason of a miss that a local binding backs; null without a binding target."""
    base = F.when(F.coalesce(kind, F.lit("")) != "", F.concat(F.lit("binding_backed_"), kind)).otherwise("binding_backed_local_binding")
    tails = {"ambiguous_multiple_in_scope_candidates": "_ambiguous", "ambiguous_no_in_scope_candidate": "_out_of_scope_after_narrowing", "unique_without_provenance": "_without_provenance", "no_candidates": "_no_candidates"}
    tail = F.lit("")
    for why, end in tails.items() if positive else ():
        tail = F.when(F.trim(dropped) == why, end).otherwise(tail)
    return F.when(F.coalesce(target, F.lit("")) != "", F.concat(base, tail))


def _ladder(steps: list[tuple[Column, str, Column | str]], last: tuple[str, str]) -> Column:
    made = lambda bucket, why: F.struct(F.lit(bucket).alias("bucket"), (F.lit(why) if isinstance(why, str) else why).alias("reason"))
    out = None
    for cond, bucket, why in steps:
        out = F.when(cond, made(bucket, why)) if out is None else out.when(cond, made(bucket, why))
    return out.otherwise(made(*last))


def missed(identifier: Column, path: Column, callee_kind: Column, prefixes: Column, reachable: Column, overlap: Column, has_hints: Column, target: Column, kind: Column) -> Column:
    """bucket and reason of a site without candidates: prefixes counts the repository's names that begin the identifier."""
    name = F.trim(F.coalesce(identifier, F.lit("")))
    last = terminal(name)
    bound = binding_reason(target, kind, F.lit(""), False)
    owned, qualified, dotted = prefixes > 0, callee_kind == "qualified", name.contains(".")
    return _ladder(
        [
            ((name == "") | (F.coalesce(path, F.lit("")) == ""), "parser_extraction_mismatch", "missing_identifier_or_file_path"),
            (fixture_path(path), "dynamic_or_indirect_shape", "fixture_or_generated_path"),
            (repeats_segment(name), "parser_extraction_mismatch", "repeated_qualified_segment"),
            (has_inline_call(name), "dynamic_or_indirect_shape", "inline_dynamic_call_chain"),
            (last.isin(FLUENT_TERMINALS), "dynamic_or_indirect_shape", "fluent_terminal"),
            (bound.isNotNull(), "unindexed_symbol_shape", bound),
            (owned & qualified & reachable, "unindexed_symbol_shape", "reachable_repo_owned_prefix"),
            (owned & qualified & overlap, "unindexed_symbol_shape", "repo_hint_overlap"),
            (owned & qualified & (prefixes == 1), "external_dependency_shape", "shallow_non_reachable_repo_prefix"),
            (owned & qualified, "unindexed_symbol_shape", "repo_owned_qualified_prefix"),
            (owned, "dynamic_or_indirect_shape", "repo_owned_terminal_call_shape"),
            (dotted & F.substring_index(name, ".", 1).isin(RECEIVERS), "dynamic_or_indirect_shape", "dynamic_receiver_root"),
            (dotted & overlap, "unindexed_symbol_shape", "repo_hint_overlap"),
            (dotted & has_hints, "external_dependency_shape", "qualified_identifier_with_external_module_hints"),
            (dotted, "external_dependency_shape", "qualified_identifier_without_repo_candidate"),
        ],
        ("unindexed_symbol_shape", "terminal_identifier_without_repo_candidate"),
    )


def rejected(identifier: Column, path: Column, dropped: Column, target: Column, kind: Column) -> Column:
    """bucket and reason of a site whose candidates were all rejected."""
    why = F.trim(F.coalesce(dropped, F.lit("")))
    bound = binding_reason(target, kind, why, True)
    last = F.lower(F.trim(terminal(identifier)))
    reasons = [
        ("ambiguous_multiple_in_scope_candidates", "unindexed_symbol_shape", "positive_candidate_ambiguous"),
        ("ambiguous_no_in_scope_candidate", "unindexed_symbol_shape", "positive_candidate_out_of_scope_after_narrowing"),
        ("ambiguous_no_caller_module", "unindexed_symbol_shape", "positive_candidate_without_caller_module"),
        ("unique_without_provenance", "unindexed_symbol_shape", "positive_candidate_without_provenance"),
        ("no_candidates", "no_clear_in_repo_target", "positive_candidate_no_candidates"),
    ]
    return _ladder(
        [
            (fixture_path(path), "dynamic_or_indirect_shape", "fixture_or_generated_path"),
            (is_inline_chain(identifier), "dynamic_or_indirect_shape", "inline_dynamic_call_chain"),
            (last.isin(DYNAMIC_TERMINALS), "dynamic_or_indirect_shape", "positive_candidate_dynamic_member_terminal"),
            ((why == "unique_without_provenance") & identifier.contains(INDEX_PART), "dynamic_or_indirect_shape", "runtime_composed_index_surface"),
            (why == "invalid_observation_shape", "parser_extraction_mismatch", "positive_candidate_invalid_shape"),
            (bound.isNotNull(), "unindexed_symbol_shape", bound),
            *[(why == d, bucket, reason) for d, bucket, reason in reasons],
        ],
        ("unindexed_symbol_shape", "positive_candidate_rejected"),
    )
