"""The catalogue's reducers: the flat relation under each report."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.functions import names as N
from codegrove.operators import graph as G
from codegrove.operators import rollups as R
from codegrove.plans.aggregates import _A6, _A7, _FAN, _LOOKUP, class_lookup, fans, module_lookup
from codegrove.plans.registry import query

C = F.col


def _named(rows, nodes, key, label):
    return rows.join(nodes.select(C("structural_id").alias(key), C("qualified_name").alias(label)), key, "left")


@query("R1_snapshot_provenance", "SELECT o_orderkey AS snapshot_id, o_orderstatus AS source FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def r1(g):
    return g.orders.filter("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select(C("o_orderkey").alias("snapshot_id"), C("o_orderstatus").alias("source"))


@query("R2_structural_index", f"SELECT m.qualified_name AS module, count(DISTINCT n.file_path) AS files, count(*) FILTER (WHERE n.node_type = 'classifier') AS classifiers, count(*) FILTER (WHERE n.node_type = 'callable') AS callables FROM @nodes n JOIN {_LOOKUP} l ON n.structural_id = l.id JOIN @nodes m ON l.owner = m.structural_id GROUP BY 1")
def r2(g):
    n = g.nodes.join(module_lookup(g), C("structural_id") == C("id")).groupBy("owner")
    per = n.agg(F.count_distinct("file_path").alias("files"), F.count_if(C("node_type") == "classifier").alias("classifiers"), F.count_if(C("node_type") == "callable").alias("callables"))
    return _named(per, g.nodes, "owner", "module").drop("owner")


@query("R3_module_overview", "SELECT node_type, language, count(*) AS n, count(DISTINCT file_path) AS files FROM @nodes n WHERE qualified_name = 'EUROPE' OR starts_with(qualified_name, 'EUROPE.') GROUP BY 1, 2")
def r3(g):
    return g.nodes.filter(N.within(C("qualified_name"), "EUROPE")).groupBy("node_type", "language").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


@query("R4_callable_overview", "SELECT n.structural_id, regexp_extract(n.qualified_name, '[^.]*$') AS name, p.node_type AS parent_type, p.qualified_name AS parent, CASE WHEN p.node_type = 'classifier' THEN 'bound' WHEN p.node_type = 'callable' THEN 'nested' ELSE 'declared' END AS role FROM @nodes n JOIN @contains e ON dst = n.structural_id JOIN @nodes p ON src = p.structural_id WHERE n.node_type = 'callable' AND n.language = '1-URGENT'")
def r4(g):
    n = g.nodes.filter("node_type = 'callable' and language = '1-URGENT'").select("structural_id", N.terminal(C("qualified_name")).alias("name"))
    e = g.contains.select(C("dst").alias("structural_id"), "src")
    p = g.nodes.select(C("structural_id").alias("src"), C("node_type").alias("parent_type"), C("qualified_name").alias("parent"))
    role = F.when(C("parent_type") == "classifier", "bound").when(C("parent_type") == "callable", "nested").otherwise("declared")
    return n.join(e, "structural_id").join(p, "src").select("structural_id", "name", "parent_type", "parent", role.alias("role"))


@query("R5_callable_source", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), CAST(1 + doc_id % 3 AS BIGINT), CAST(3 + doc_id % 3 AS BIGINT)), chr(10)) AS source FROM documents")
def r5(g):
    start = (1 + C("doc_id") % 3).cast("int")
    return g.documents.select("doc_id", F.array_join(F.slice(F.split("text", "\n"), start, F.lit(3)), "\n").alias("source"))


@query("R6_classifier_overview", "SELECT c.structural_id, c.qualified_name, count(dst) AS methods FROM @nodes c LEFT JOIN @contains e ON src = c.structural_id WHERE c.node_type = 'classifier' GROUP BY 1, 2")
def r6(g):
    per = g.contains.groupBy(C("src").alias("structural_id")).agg(F.count("*").alias("m"))
    return g.nodes.filter("node_type = 'classifier'").join(per, "structural_id", "left").select("structural_id", "qualified_name", F.coalesce("m", F.lit(0)).alias("methods"))


@query("R7_classifier_inheritance", "SELECT a.qualified_name AS classifier, 'base' AS side, b.qualified_name AS other FROM @extends e JOIN @nodes a ON src = a.structural_id JOIN @nodes b ON dst = b.structural_id UNION ALL SELECT b.qualified_name, 'derived', a.qualified_name FROM @extends e JOIN @nodes a ON src = a.structural_id JOIN @nodes b ON dst = b.structural_id")
def r7(g):
    both = _named(_named(g.extends, g.nodes, "src", "a"), g.nodes, "dst", "b")
    rows = F.array(F.struct(C("a").alias("classifier"), F.lit("base").alias("side"), C("b").alias("other")), F.struct(C("b").alias("classifier"), F.lit("derived").alias("side"), C("a").alias("other")))
    return both.select(F.explode(rows).alias("r")).select("r.*")


@query("R8_concatenated_source", "SELECT source, count(*) AS files, CAST(sum(CASE WHEN strlen(text) <= 20000 THEN strlen(text) ELSE 0 END) AS BIGINT) AS bytes, sha256(string_agg(CASE WHEN strlen(text) <= 20000 THEN md5(text) ELSE 'skipped' END, chr(10) ORDER BY doc_id)) AS digest FROM documents WHERE lang = 'de' GROUP BY source")
def r8(g):
    size = F.octet_length("text")
    part = F.struct("doc_id", F.when(size <= 20000, F.md5(C("text").cast("binary"))).otherwise("skipped").alias("h"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["h"]), "\n")
    return g.documents.filter("lang = 'de'").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.when(size <= 20000, size).otherwise(0)).alias("bytes"), F.sha2(text.cast("binary"), 256).alias("digest"))


@query("R9_file_outline", "SELECT file_path, string_agg(start_line || ':' || qualified_name, '|' ORDER BY start_line, qualified_name) AS outline FROM @nodes n WHERE node_type IN ('module', 'callable') AND starts_with(qualified_name, 'AFRICA') GROUP BY file_path")
def r9(g):
    n = g.nodes.filter(C("node_type").isin("module", "callable") & C("qualified_name").startswith("AFRICA"))
    rows = F.array_sort(F.collect_list(F.struct("start_line", "qualified_name")))
    return n.groupBy("file_path").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["start_line"], x["qualified_name"])), "|").alias("outline"))


@query("R10_dependency_edges", "SELECT a.qualified_name AS from_module, b.qualified_name AS to_module FROM @imports e JOIN @nodes a ON src = a.structural_id JOIN @nodes b ON dst = b.structural_id WHERE a.qualified_name LIKE 'ASIA.%' ORDER BY 1, 2 LIMIT 50")
def r10(g):
    both = _named(_named(g.imports, g.nodes, "src", "from_module"), g.nodes, "dst", "to_module")
    return both.filter(C("from_module").startswith("ASIA.")).select("from_module", "to_module").orderBy("from_module", "to_module").limit(50)


@query("R11_ownership_summary", "SELECT a.qualified_name AS module, b.qualified_name AS other, split_part(a.qualified_name, '.', 1) = split_part(b.qualified_name, '.', 1) AS is_internal, count(*) AS edges FROM @few_imports e JOIN @nodes a ON src = a.structural_id JOIN @nodes b ON dst = b.structural_id GROUP BY 1, 2, 3")
def r11(g):
    both = _named(_named(g.few_imports, g.nodes, "src", "module"), g.nodes, "dst", "other")
    same = F.substring_index("module", ".", 1) == F.substring_index("other", ".", 1)
    return both.groupBy("module", "other", same.alias("is_internal")).agg(F.count("*").alias("edges"))


@query("R12_module_call_graph", f"SELECT a.qualified_name AS src_module, b.qualified_name AS dst_module, call_count FROM {_A6} x JOIN @nodes a ON src_module_id = a.structural_id JOIN @nodes b ON dst_module_id = b.structural_id ORDER BY call_count DESC, 1, 2 LIMIT 20")
def r12(g):
    per = R.lifted_calls(g.calls, module_lookup(g), "s", "d")
    return _named(_named(per, g.nodes, "s", "src_module"), g.nodes, "d", "dst_module").select("src_module", "dst_module", "call_count").orderBy(F.desc("call_count"), "src_module", "dst_module").limit(20)


@query("R13_classifier_call_graph", f"SELECT src_class_id, dst_class_id, call_count FROM {_A7} x ORDER BY call_count DESC, 1, 2 LIMIT 20")
def r13(g):
    return R.lifted_calls(g.calls, class_lookup(g), "src_class_id", "dst_class_id").orderBy(F.desc("call_count"), "src_class_id", "dst_class_id").limit(20)


@query("R14_fan_summary", f"SELECT node_id, qualified_name, edge_kind, fan_in, fan_out FROM (SELECT * FROM {_FAN} f WHERE greatest(fan_in, fan_out) >= 3 ORDER BY greatest(fan_in, fan_out) DESC, node_id, edge_kind LIMIT 50) x LEFT JOIN @nodes n ON node_id = structural_id")
def r14(g):
    most = F.greatest("fan_in", "fan_out")
    top = fans(g).filter(most >= 3).orderBy(F.desc(most), "node_id", "edge_kind").limit(50)
    return _named(top, g.nodes, "node_id", "qualified_name").select("node_id", "qualified_name", "edge_kind", "fan_in", "fan_out")


@query("R15_hotspot_summary", f"SELECT * FROM (SELECT 'size' AS board, m.qualified_name AS name, count(*) AS n FROM {_LOOKUP} l JOIN @nodes m ON l.owner = m.structural_id GROUP BY 2 ORDER BY n DESC, name LIMIT 5) a UNION ALL SELECT * FROM (SELECT 'import_fan_in' AS board, m.qualified_name AS name, count(*) AS n FROM @few_imports e JOIN @nodes m ON dst = m.structural_id GROUP BY 2 ORDER BY n DESC, name LIMIT 5) b")
def r15(g):
    size = module_lookup(g).groupBy("owner").agg(F.count("*").alias("n"))
    into = g.few_imports.groupBy("dst").agg(F.count("*").alias("n"))
    board = lambda rows, key, name: _named(rows, g.nodes, key, "name").select(F.lit(name).alias("board"), "name", "n").orderBy(F.desc("n"), "name").limit(5)
    return board(size, "owner", "size").unionByName(board(into, "dst", "import_fan_in"))


_SCORE = "CASE WHEN lower(qualified_name) = 'nation_1' THEN 1.0 WHEN lower(regexp_extract(qualified_name, '[^.]*$')) = 'nation_1' THEN 0.9 WHEN lower(qualified_name) LIKE '%.nation_1' THEN 0.8 WHEN lower(qualified_name) LIKE 'nation_1%' THEN 0.75 WHEN lower(qualified_name) LIKE '%nation_1%' THEN 0.6 ELSE 0.5 END"
_FOUND = f"(SELECT structural_id, qualified_name, CAST({_SCORE} AS DOUBLE) AS score FROM (SELECT * FROM @nodes n WHERE contains(lower(qualified_name), 'nation_1') ORDER BY qualified_name, file_path, structural_id LIMIT 50) p ORDER BY score DESC, qualified_name, structural_id LIMIT 10)"


def _found(g):
    first = g.nodes.filter(F.lower("qualified_name").contains("nation_1")).orderBy("qualified_name", "file_path", "structural_id").limit(50)
    return first.select("structural_id", "qualified_name", N.match_score("NATION_1", C("structural_id"), C("qualified_name")).alias("score")).orderBy(F.desc("score"), "qualified_name", "structural_id").limit(10)


@query("R16_symbol_lookup", f"SELECT * FROM {_FOUND} x")
def r16(g):
    return _found(g)


@query("R17_symbol_references", f"SELECT structural_id, 'out' AS direction, dst AS other, edge_type FROM {_FOUND} x JOIN (SELECT * FROM @structure s UNION ALL SELECT * FROM @calls c) e ON src = structural_id UNION ALL SELECT structural_id, 'in', src, edge_type FROM {_FOUND} x JOIN (SELECT * FROM @structure s UNION ALL SELECT * FROM @calls c) e ON dst = structural_id")
def r17(g):
    hit = _found(g).select("structural_id")
    e = g.structure.unionByName(g.calls)
    out = e.join(hit, C("src") == C("structural_id")).select("structural_id", F.lit("out").alias("direction"), C("dst").alias("other"), "edge_type")
    return out.unionByName(e.join(hit, C("dst") == C("structural_id")).select("structural_id", F.lit("in").alias("direction"), C("src").alias("other"), "edge_type"))


@query("R18_integrity_summary", "SELECT 'duplicates' AS fault, count(*) AS n FROM (SELECT p_name FROM part GROUP BY 1 HAVING count(*) > 1) a UNION ALL SELECT 'orphans', count(*) FROM @nodes n WHERE node_type <> 'module' AND structural_id NOT IN (SELECT dst FROM @contains e) UNION ALL SELECT 'inheritance_cycles', count(*) FROM (SELECT a.src, a.dst FROM @extends a JOIN @extends b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst GROUP BY 1, 2) c")
def r18(g):
    count = lambda rows, name: rows.agg(F.lit(name).alias("fault"), F.count("*").alias("n"))
    e = g.extends
    return count(g.part.groupBy("p_name").count().filter("count > 1"), "duplicates").unionByName(count(G.orphans(g.nodes, g.contains), "orphans")).unionByName(count(G.short_cycles(e.unionByName(e.select(C("dst").alias("src"), C("src").alias("dst"), "edge_type")).join(e.select(C("dst").alias("src"), C("src").alias("dst")), ["src", "dst"], "left_semi")), "inheritance_cycles"))


@query("R20_projection_status", "SELECT * FROM (VALUES ('callable_overview', 'patched'), ('overlay_impact_summary', 'projection_not_patched'), ('ownership_summary', 'projection_not_patched'), ('structural_index', 'patched')) t(projection, state)")
def r20(g):
    names = ["callable_overview", "overlay_impact_summary", "ownership_summary", "structural_index"]
    rows = g.spark.createDataFrame([(n,) for n in names], "projection string")
    return rows.select("projection", F.when(C("projection").isin("callable_overview", "structural_index"), "patched").otherwise("projection_not_patched").alias("state"))
