"""Forms of identifiers and paths, and what is said of call sites that found no target."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.functions import names as N
from codegrove.operators import diagnostics as X
from codegrove.plans.registry import query

C = F.col

#: Identifiers of many forms, an order each; one expression for both sides.
_FORM = """CASE o_orderkey % 13 WHEN 0 THEN 'pkg.index.m' || o_custkey WHEN 1 THEN 'a.a.b.b.f' || o_custkey WHEN 2 THEN 'self.repo.save' WHEN 3 THEN 'm' || o_custkey WHEN 4 THEN 'x.module.exports.go' WHEN 5 THEN 'a.b.a'
WHEN 6 THEN 'a.b.a.b' WHEN 7 THEN 'lib.index' WHEN 8 THEN 'items.then' WHEN 9 THEN 'f(1).in(x).g' WHEN 10 THEN '' WHEN 11 THEN 'ASIA.run' ELSE 'ASIA.NATION_2.index.run' END"""
_PATH = "CASE o_custkey % 5 WHEN 0 THEN 'src/fixtures/a.py' WHEN 1 THEN 'src/__init__.py' WHEN 2 THEN 'src/pkg/__init__.py' WHEN 3 THEN '' ELSE 'src/pkg/mod.test.ts' END"
_WHY = "CASE o_orderkey % 7 WHEN 0 THEN 'no_candidates' WHEN 1 THEN 'unique_without_provenance' WHEN 2 THEN 'ambiguous_no_caller_module' WHEN 3 THEN 'ambiguous_no_in_scope_candidate' WHEN 4 THEN 'ambiguous_multiple_in_scope_candidates' WHEN 5 THEN 'invalid_observation_shape' ELSE '' END"
_HINTS = "CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' a, ,b' || o_custkey || ',' ELSE 'one' END"
_TARGET = "CASE WHEN o_custkey % 17 = 0 THEN 'pkg.target' END"
_KIND = "CASE WHEN o_custkey % 2 = 0 THEN 'module_alias' ELSE '' END"
_IDS = f"(SELECT o_orderkey AS id, {_FORM} AS name, {_PATH} AS path, {_WHY} AS why, {_HINTS} AS csv, {_TARGET} AS target, {_KIND} AS kind, o_custkey FROM orders)"


def _ids(g):
    return g.orders.selectExpr("o_orderkey AS id", f"{_FORM} AS name", f"{_PATH} AS path", f"{_WHY} AS why", f"{_HINTS} AS csv", f"{_TARGET} AS target", f"{_KIND} AS kind", "o_custkey")


_LAST = "regexp_extract(name, '[^.]*$')"
_HEAD = "CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)[.][^.]*$', 1) ELSE '' END"


@query("F5_proxy_names", f"SELECT id, substr(replace(replace('.' || name, '.index.', '.'), '.module.exports.', '.'), 2) AS collapsed FROM {_IDS} x")
def f5(g):
    return _ids(g).select("id", F.array_join(N.proxy_parts(C("name")), ".").alias("collapsed"))


@query("F6_repeated_variants", f"SELECT id, coalesce(array_to_string(list_transform(list_filter(range(1, len(p)), lambda i: p[i] = p[i + 1]), lambda i: array_to_string(list_concat(list_slice(p, 1, i - 1), list_slice(p, i + 1, len(p))), '.') || '.' || t), '|'), '') AS variants FROM (SELECT id, string_split({_HEAD}, '.') AS p, {_LAST} AS t FROM {_IDS} x) y")
def f6(g):
    return _ids(g).select("id", F.array_join(N.repeated_variants(C("name")), "|").alias("variants"))


@query("F7_collapsed_index", f"SELECT id, regexp_replace(replace(name, '.index.', '.'), '[.]index$', '') AS module FROM {_IDS} x")
def f7(g):
    return _ids(g).select("id", N.collapsed_index(C("name")).alias("module"))


@query("F8_module_of_path", f"SELECT id, CASE WHEN m = 'src' OR starts_with(m, 'src.') THEN m WHEN m = '' THEN 'src' ELSE 'src.' || m END AS module FROM (SELECT id, replace(regexp_replace(regexp_replace(path, '[.][^./]+$', ''), '/__init__$', ''), '/', '.') AS m FROM {_IDS} x) y")
def f8(g):
    return _ids(g).select("id", N.module_of_path(C("path"), "src").alias("module"))


@query("F9_callee_shape", f"SELECT id, nullif(split_part({_HEAD}, '.', 1), '') AS receiver, CASE WHEN {_HEAD} = '' THEN 'unqualified' WHEN split_part({_HEAD}, '.', 1) IN ('self', 'cls', 'this', 'super') THEN 'receiver' ELSE 'member' END AS kind FROM {_IDS} x")
def f9(g):
    return _ids(g).select("id", F.get(N.segments(N.qualifier(C("name"))), F.lit(0)).alias("receiver"), N.callee_kind(C("name")).alias("kind"))


@query("F10_normalised_callees", "SELECT id, replace(replace(replace(name || '?.x!.y::z', '?.', '.'), '!.', '.'), '::', '.') AS callee FROM " + _IDS + " x")
def f10(g):
    return _ids(g).select("id", N.normalised_callee(F.concat(C("name"), F.lit("?.x!.y::z"))).alias("callee"))


@query("F11_signatures", f"SELECT id, {_LAST} || '(' || array_to_string(list_transform(range(id % 4), lambda i: 'p' || i), ', ') || ')' AS signature FROM {_IDS} x")
def f11(g):
    n = (C("id") % 4).cast("int")
    return _ids(g).select("id", N.signature(C("name"), F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.lit("p"), i.cast("string")))).otherwise(F.array().cast("array<string>"))).alias("signature"))


@query("F12_module_hints", f"SELECT id, coalesce(array_to_string(list_filter(list_transform(string_split(coalesce(csv, ''), ','), lambda x: trim(x)), lambda x: x <> ''), '|'), '') AS hints FROM {_IDS} x")
def f12(g):
    return _ids(g).select("id", F.array_join(N.hints(C("csv")), "|").alias("hints"))


@query("F13_overlay_values", "SELECT event_id, CASE WHEN json_valid(v) THEN json_extract_string(v, '$.k') END AS k FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{' || props ELSE props END AS v FROM events) x")
def f13(g):
    v = F.when(C("event_id") % 7 == 0, F.concat(F.lit("{"), C("props"))).otherwise(C("props"))
    return g.events.select("event_id", F.get_json_object(v, "$.k").alias("k"))


@query("F14_latest_by_iso_text", "SELECT o_custkey, max(CAST(o_orderdate AS VARCHAR)) AS latest FROM orders GROUP BY 1")
def f14(g):
    return g.orders.groupBy("o_custkey").agg(F.max(C("o_orderdate").cast("string")).alias("latest"))


def _prefix_matches(g):
    """id, prefix: the names before an identifier's last part that begin a module's name."""
    known = g.nodes.filter("node_type = 'module'").select(F.explode(N.prefixes(C("qualified_name"))).alias("prefix")).distinct()
    return _ids(g).select("id", F.explode(N.ancestors(C("name"))).alias("prefix")).join(known, "prefix")


_MATCHES = f"(SELECT id, prefix FROM (SELECT id, unnest(list_transform(range(1, len(string_split(name, '.'))), lambda i: array_to_string(list_slice(string_split(name, '.'), 1, i), '.'))) AS prefix FROM {_IDS} x) y WHERE prefix IN (SELECT qualified_name FROM @nodes n WHERE node_type = 'module'))"


@query("E16_repo_prefixes", f"SELECT id, string_agg(prefix, '|' ORDER BY length(prefix)) AS matches, count(*) AS depth FROM {_MATCHES} m GROUP BY id")
def e16(g):
    rows = F.array_sort(F.collect_list(F.struct(F.length("prefix").alias("n"), "prefix")))  # at most as many as an identifier has parts
    return _prefix_matches(g).groupBy("id").agg(F.array_join(F.transform(rows, lambda x: x["prefix"]), "|").alias("matches"), F.count("*").alias("depth"))


_REPEATS = "(len(p) >= 2 AND (len(list_filter(range(1, len(p)), lambda i: p[i] = p[i + 1])) > 0 OR (len(p) >= 3 AND p[-1] = p[-3]) OR (len(p) >= 4 AND p[-1] = p[-3] AND p[-2] = p[-4])))"
_PARTS = "list_filter(string_split(name, '.'), lambda s: s <> '') AS p"


@query("E17_identifier_predicates", f"SELECT id, {_REPEATS} AS repeats, contains(name, '.in(') OR (contains(name, '(') AND contains(name, ').')) AS inline_chain, contains(name, '.') AND regexp_matches(name, '[][(]') AS inline_call, lower({_LAST}) IN ({', '.join(repr(x) for x in X.DYNAMIC_TERMINALS)}) AS dynamic_terminal FROM (SELECT *, {_PARTS} FROM {_IDS} x) y")
def e17(g):
    n = C("name")
    return _ids(g).select("id", N.repeats_segment(n).alias("repeats"), X.is_inline_chain(n).alias("inline_chain"), X.has_inline_call(n).alias("inline_call"), F.lower(N.terminal(n)).isin(X.DYNAMIC_TERMINALS).alias("dynamic_terminal"))


_FIX = f"len(list_filter(string_split(lower(path), '/'), lambda s: s IN ({', '.join(repr(x) for x in N.FIXTURE_SEGMENTS)}))) > 0"


@query("P18_fixture_segments", f"SELECT id, {_FIX} AS fixture FROM {_IDS} x")
def p18_all(g):
    return _ids(g).select("id", N.fixture_path(C("path")).alias("fixture"))


_X2 = f"""SELECT id, CASE WHEN name = '' OR path = '' THEN 'parser_extraction_mismatch' WHEN {_FIX} THEN 'dynamic_or_indirect_shape' WHEN {_REPEATS} THEN 'parser_extraction_mismatch' WHEN contains(name, '.') AND regexp_matches(name, '[][(]') THEN 'dynamic_or_indirect_shape'
WHEN {_LAST} IN ('then', 'catch', 'finally') THEN 'dynamic_or_indirect_shape' WHEN target IS NOT NULL THEN 'unindexed_symbol_shape' WHEN depth > 0 AND contains(name, '.') AND o_custkey % 4 = 0 THEN 'unindexed_symbol_shape' WHEN depth = 1 AND contains(name, '.') THEN 'external_dependency_shape'
WHEN depth > 0 AND contains(name, '.') THEN 'unindexed_symbol_shape' WHEN depth > 0 THEN 'dynamic_or_indirect_shape' WHEN contains(name, '.') AND split_part(name, '.', 1) IN ('self', 'cls', 'this', 'super') THEN 'dynamic_or_indirect_shape' WHEN contains(name, '.') THEN 'external_dependency_shape' ELSE 'unindexed_symbol_shape' END AS bucket,
CASE WHEN name = '' OR path = '' THEN 'missing_identifier_or_file_path' WHEN {_FIX} THEN 'fixture_or_generated_path' WHEN {_REPEATS} THEN 'repeated_qualified_segment' WHEN contains(name, '.') AND regexp_matches(name, '[][(]') THEN 'inline_dynamic_call_chain'
WHEN {_LAST} IN ('then', 'catch', 'finally') THEN 'fluent_terminal' WHEN target IS NOT NULL THEN 'binding_backed_' || CASE WHEN kind <> '' THEN kind ELSE 'local_binding' END WHEN depth > 0 AND contains(name, '.') AND o_custkey % 4 = 0 THEN 'reachable_repo_owned_prefix' WHEN depth = 1 AND contains(name, '.') THEN 'shallow_non_reachable_repo_prefix'
WHEN depth > 0 AND contains(name, '.') THEN 'repo_owned_qualified_prefix' WHEN depth > 0 THEN 'repo_owned_terminal_call_shape' WHEN contains(name, '.') AND split_part(name, '.', 1) IN ('self', 'cls', 'this', 'super') THEN 'dynamic_receiver_root'
WHEN contains(name, '.') AND csv IS NOT NULL THEN 'qualified_identifier_with_external_module_hints' WHEN contains(name, '.') THEN 'qualified_identifier_without_repo_candidate' ELSE 'terminal_identifier_without_repo_candidate' END AS reason
FROM (SELECT x.*, {_PARTS}, coalesce(depth, 0) AS depth FROM {_IDS} x LEFT JOIN (SELECT id, count(*) AS depth FROM {_MATCHES} m GROUP BY id) d ON x.id = d.id) y"""


def _missed(g):
    depth = _prefix_matches(g).groupBy("id").agg(F.count("*").alias("depth"))
    rows = _ids(g).join(depth, "id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    kind = F.when(C("name").contains("."), "qualified").otherwise("terminal")
    return rows.withColumn("x", X.missed(C("name"), C("path"), kind, C("depth"), C("o_custkey") % 4 == 0, F.lit(False), F.size(N.hints(C("csv"))) > 0, C("target"), C("kind")))


@query("X2_missed_sites", _X2)
def x2(g):
    return _missed(g).select("id", "x.bucket", "x.reason")


@query("A24_bucket_totals", f"SELECT CASE WHEN split_part(path, '/', 2) = 'fixtures' THEN 'fixtures' ELSE 'other' END AS scope, bucket, count(*) AS sites FROM ({_X2.replace('SELECT id, CASE', 'SELECT path, CASE', 1)}) z GROUP BY GROUPING SETS ((scope, bucket), (bucket), ())")
def a24(g):
    scope = F.when(F.get(F.split("path", "/"), F.lit(1)) == "fixtures", "fixtures").otherwise("other")
    return _missed(g).select(scope.alias("scope"), C("x.bucket").alias("bucket")).groupingSets([["scope", "bucket"], ["bucket"], []], "scope", "bucket").agg(F.count("*").alias("sites"))


_B = "CASE WHEN target IS NOT NULL THEN 'binding_backed_' || CASE WHEN kind <> '' THEN kind ELSE 'local_binding' END || CASE why WHEN 'ambiguous_multiple_in_scope_candidates' THEN '_ambiguous' WHEN 'ambiguous_no_in_scope_candidate' THEN '_out_of_scope_after_narrowing' WHEN 'unique_without_provenance' THEN '_without_provenance' WHEN 'no_candidates' THEN '_no_candidates' ELSE '' END END"


@query("X4_rejected_sites", f"""SELECT id, CASE WHEN {_FIX} OR contains(name, '.in(') OR (contains(name, '(') AND contains(name, ').')) OR lower({_LAST}) IN ({', '.join(repr(x) for x in X.DYNAMIC_TERMINALS)}) OR (why = 'unique_without_provenance' AND contains(name, '.index.')) THEN 'dynamic_or_indirect_shape'
WHEN why = 'invalid_observation_shape' THEN 'parser_extraction_mismatch' WHEN target IS NULL AND why = 'no_candidates' THEN 'no_clear_in_repo_target' ELSE 'unindexed_symbol_shape' END AS bucket,
CASE WHEN {_FIX} THEN 'fixture_or_generated_path' WHEN contains(name, '.in(') OR (contains(name, '(') AND contains(name, ').')) THEN 'inline_dynamic_call_chain' WHEN lower({_LAST}) IN ({', '.join(repr(x) for x in X.DYNAMIC_TERMINALS)}) THEN 'positive_candidate_dynamic_member_terminal'
WHEN why = 'unique_without_provenance' AND contains(name, '.index.') THEN 'runtime_composed_index_surface' WHEN why = 'invalid_observation_shape' THEN 'positive_candidate_invalid_shape' WHEN target IS NOT NULL THEN {_B} ELSE CASE why WHEN 'ambiguous_multiple_in_scope_candidates' THEN 'positive_candidate_ambiguous'
WHEN 'ambiguous_no_in_scope_candidate' THEN 'positive_candidate_out_of_scope_after_narrowing' WHEN 'ambiguous_no_caller_module' THEN 'positive_candidate_without_caller_module' WHEN 'unique_without_provenance' THEN 'positive_candidate_without_provenance' WHEN 'no_candidates' THEN 'positive_candidate_no_candidates' ELSE 'positive_candidate_rejected' END END AS reason FROM {_IDS} x""")
def x4(g):
    return _ids(g).withColumn("x", X.rejected(C("name"), C("path"), C("why"), C("target"), C("kind"))).select("id", "x.bucket", "x.reason")


_FACT = f"(SELECT o_custkey AS scope, k AS pos, CASE k WHEN 0 THEN 'pkg' WHEN 1 THEN 'm' || o_custkey WHEN 2 THEN 'self' ELSE 'a' END AS symbol, 'repo.t' || k AS target, CASE k WHEN 0 THEN 'module_alias' WHEN 1 THEN 'direct_import_symbol' WHEN 2 THEN 'constructor_or_classifier_import' ELSE 'namespace_alias' END AS binding_kind FROM (SELECT DISTINCT o_custkey FROM orders) s, (SELECT unnest([0, 1, 2, 3]) AS k) f)"


def _facts(g):
    rows = g.orders.select(C("o_custkey").alias("scope")).distinct().select("scope", F.explode(F.array(*map(F.lit, range(4)))).alias("pos"))
    pick = lambda *x: F.when(C("pos") == 0, x[0]).when(C("pos") == 1, x[1]).when(C("pos") == 2, x[2]).otherwise(x[3])
    return rows.select(
        "scope", "pos", pick(F.lit("pkg"), F.concat(F.lit("m"), C("scope").cast("string")), F.lit("self"), F.lit("a")).alias("symbol"), F.concat(F.lit("repo.t"), C("pos").cast("string")).alias("target"),
        pick(F.lit("module_alias"), F.lit("direct_import_symbol"), F.lit("constructor_or_classifier_import"), F.lit("namespace_alias")).alias("binding_kind"),
    )


@query("C5_binding_matches", f"SELECT id, arg_min(target, (stage, pos)) AS target, arg_min(binding_kind, (stage, pos)) AS binding_kind FROM (SELECT id, f.*, CASE WHEN symbol = split_part(name, '.', 1) THEN 1 ELSE 2 END AS stage FROM {_IDS} x JOIN {_FACT} f ON scope = o_custkey AND (symbol = split_part(name, '.', 1) OR (contains(name, '.') AND symbol = {_LAST})) WHERE name <> '') y GROUP BY id")
def c5(g):
    from codegrove.operators.bindings import matches

    return matches(_ids(g).select("id", C("name").alias("identifier"), C("o_custkey").alias("scope")), _facts(g)).select("id", "target", "binding_kind")


@query("C6_binding_candidates", f"SELECT DISTINCT id, CASE WHEN binding_kind IN ('module_alias', 'namespace_alias') OR (binding_kind = 'constructor_or_classifier_import' AND contains(name, '.')) THEN f.target || substr(name, strpos(name, '.')) ELSE f.target END AS candidate FROM {_IDS} x JOIN {_FACT} f ON scope = o_custkey AND symbol = split_part(name, '.', 1) WHERE name <> '' AND (contains(name, '.') AND binding_kind IN ('module_alias', 'namespace_alias') OR binding_kind = 'constructor_or_classifier_import' OR (binding_kind = 'direct_import_symbol' AND NOT contains(name, '.')))")
def c6(g):
    from codegrove.operators.bindings import candidates

    return candidates(_ids(g).select("id", C("name").alias("identifier"), C("o_custkey").alias("scope")), _facts(g)).select("id", "candidate")


@query("C3_stage_ladder", f"SELECT id, coalesce(CASE WHEN starts_with(name, 'self.') THEN 'typed.' || {_LAST} END, CASE WHEN id % 2 = 0 AND contains(name, '.') THEN 'alias.' || name END, CASE WHEN id % 3 = 0 AND name <> '' THEN 'module.' || name END, {_LAST}) AS candidate, CASE WHEN starts_with(name, 'self.') THEN 'receiver_typed_or_instance_mapped' WHEN id % 2 = 0 AND contains(name, '.') THEN 'import_or_member_alias_narrowing' WHEN id % 3 = 0 AND name <> '' THEN 'module_scoped_fallback' ELSE 'terminal_fallback' END AS stage FROM {_IDS} x")
def c3(g):
    from codegrove.operators.bindings import first_stage

    n, last = C("name"), N.terminal(C("name"))
    return _ids(g).withColumn("s", first_stage({
        "receiver_typed_or_instance_mapped": F.when(n.startswith("self."), F.concat(F.lit("typed."), last)),
        "import_or_member_alias_narrowing": F.when((C("id") % 2 == 0) & n.contains("."), F.concat(F.lit("alias."), n)),
        "classifier_scoped_fallback": F.lit(None).cast("string"),
        "module_scoped_fallback": F.when((C("id") % 3 == 0) & (n != ""), F.concat(F.lit("module."), n)),
    }, last)).select("id", C("s.candidate").alias("candidate"), C("s.stage").alias("stage"))
