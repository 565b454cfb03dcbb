"""Joins, rollups and ranked reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.functions import names as N
from codegrove.functions.storage import small, stored
from codegrove.operators import rollups as R
from codegrove.plans.registry import query

C = F.col


@query("J2_module_imports", "SELECT a.qualified_name AS from_module, b.qualified_name AS to_module FROM @imports e JOIN @nodes a ON src = a.structural_id JOIN @nodes b ON dst = b.structural_id")
def j2(g):
    m = g.nodes.filter("node_type = 'module'")
    a, b = m.select(C("structural_id").alias("src"), C("qualified_name").alias("from_module")), m.select(C("structural_id").alias("dst"), C("qualified_name").alias("to_module"))
    return g.imports.join(a, "src").join(b, "dst").select("from_module", "to_module")


@query("J3_children", "SELECT src AS parent_id, structural_id, qualified_name FROM @contains e JOIN @nodes n ON dst = structural_id WHERE node_type = 'classifier'")
def j3(g):
    return g.contains.join(g.nodes.filter("node_type = 'classifier'"), C("dst") == C("structural_id")).select(C("src").alias("parent_id"), "structural_id", "qualified_name")


_LOOKUP = "(SELECT n.structural_id AS id, m.structural_id AS owner FROM @nodes n JOIN @nodes m ON m.node_type = 'module' AND m.qualified_name = array_to_string(list_slice(string_split(n.qualified_name, '.'), 1, 2), '.'))"


def module_lookup(g):
    """id, owner: the module with the longest name that encloses each node.

    One lookup for each depth that module names have, deepest first; where the modules are within the broadcast bound,
    nodes are neither exploded nor shuffled.
    """
    m = stored(g.nodes.filter("node_type = 'module'").select("qualified_name", C("structural_id").alias("module"), N.depth(C("qualified_name")).alias("depth")))
    n = g.nodes.select(C("structural_id").alias("id"), "qualified_name")
    found = []
    for r in m.select("depth").distinct().orderBy(F.desc("depth")).collect():  # as many rows as names have depths
        d = r["depth"]
        at = small(m.filter(C("depth") == d).select(C("qualified_name").alias(f"p{d}"), C("module").alias(f"m{d}")))
        n = n.join(at, F.substring_index("qualified_name", ".", d) == C(f"p{d}"), "left")
        found.append(C(f"m{d}"))
    if not found:
        return n.select("id", F.lit(None).cast("string").alias("owner")).limit(0)
    return n.select("id", F.coalesce(*found).alias("owner")).filter("owner is not null")


def class_lookup(g):
    c = g.nodes.filter("node_type = 'classifier'").select(C("structural_id").alias("src"))
    return g.contains.join(c, "src", "left_semi").select(C("dst").alias("id"), C("src").alias("owner"))


@query("J14_module_of_node", f"SELECT id, owner FROM {_LOOKUP} x")
def j14(g):
    return module_lookup(g)


@query("J12_names_or_ids", "SELECT s_suppkey, coalesce(n_name, CAST(s_nationkey AS VARCHAR)) AS label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def j12(g):
    n = g.nation.filter("n_regionkey < 3").select(C("n_nationkey").alias("s_nationkey"), "n_name")
    return g.supplier.join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", C("s_nationkey").cast("string")).alias("label"))


@query("J19_unique_names", "SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_partkey % 20 = 0 GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1")
def j19(g):
    return g.part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"), F.max("p_partkey").alias("other")).filter("p_partkey = other").drop("other")


@query("J22_enclosing_span", "SELECT file_path, s, arg_min(qualified_name, (end_line - start_line, qualified_name)) AS enclosing FROM (SELECT DISTINCT file_path, start_line + 1 AS s FROM @nodes a WHERE node_type = 'callable') c JOIN @nodes n USING (file_path) WHERE n.node_type = 'callable' AND start_line <= s AND end_line >= s GROUP BY file_path, s")
def j22(g):
    n = g.nodes.filter("node_type = 'callable'")
    sites = n.select("file_path", (C("start_line") + 1).alias("s")).distinct()
    near = sites.join(n.select("file_path", "start_line", "end_line", "qualified_name"), "file_path").filter("start_line <= s and end_line >= s")
    best = near.groupBy("file_path", "s").agg(F.min(F.struct(C("end_line") - C("start_line"), "qualified_name")).alias("b"))
    return best.select("file_path", "s", C("b.qualified_name").alias("enclosing"))


@query("A1_nodes_per_language", "SELECT language, count(DISTINCT file_path) AS files, count(DISTINCT structural_id) AS nodes FROM @nodes n GROUP BY language")
def a1(g):
    return g.nodes.groupBy("language").agg(F.count_distinct("file_path").alias("files"), F.count_distinct("structural_id").alias("nodes"))


@query("A2_nodes_per_file", "SELECT language, file_path, count(*) AS nodes FROM @nodes n GROUP BY language, file_path")
def a2(g):
    return g.nodes.groupBy("language", "file_path").agg(F.count("*").alias("nodes"))


@query("A3_edges_per_language", "SELECT language, count(*) AS edges FROM (SELECT * FROM @structure e UNION ALL SELECT * FROM @calls c) x JOIN @nodes n ON src = structural_id GROUP BY language")
def a3(g):
    per = g.structure.unionByName(g.calls).groupBy("src").agg(F.count("*").alias("n"))
    return per.join(g.nodes.select(C("structural_id").alias("src"), "language"), "src").groupBy("language").agg(F.sum("n").alias("edges"))


@query("A4_duplicate_names", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 ORDER BY n DESC, p_name LIMIT 25")
def a4(g):
    return g.part.groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "p_name").limit(25)


_FAN = "(SELECT node_id, edge_kind, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node_id, edge_type AS edge_kind, 0 AS i, 1 AS o FROM @all UNION ALL SELECT dst, edge_type, 1, 0 FROM @all) d GROUP BY node_id, edge_kind)".replace("@all", "(SELECT * FROM @structure e UNION ALL SELECT * FROM @calls c) z")


def fans(g):
    return R.fan_stats(g.structure.unionByName(g.calls))


@query("A5_fan_stats", f"SELECT * FROM {_FAN} f")
def a5(g):
    return fans(g)


_A6 = f"(SELECT a.owner AS src_module_id, b.owner AS dst_module_id, count(*) AS call_count FROM @calls c JOIN {_LOOKUP} a ON c.src = a.id JOIN {_LOOKUP} b ON c.dst = b.id GROUP BY 1, 2)"


@query("A6_module_calls", f"SELECT * FROM {_A6} x")
def a6(g):
    return R.lifted_calls(g.calls, module_lookup(g), "src_module_id", "dst_module_id")


_OWNS = "(SELECT dst AS id, src AS owner FROM @contains e JOIN @nodes n ON src = structural_id WHERE node_type = 'classifier')"
_A7 = f"(SELECT a.owner AS src_class_id, b.owner AS dst_class_id, count(*) AS call_count FROM @calls c JOIN {_OWNS} a ON c.src = a.id JOIN {_OWNS} b ON c.dst = b.id GROUP BY 1, 2)"


@query("A7_class_calls", f"SELECT * FROM {_A7} x")
def a7(g):
    return R.lifted_calls(g.calls, class_lookup(g), "src_class_id", "dst_class_id")


@query("A8_calls_per_caller", "SELECT src, count(*) AS calls FROM @calls c GROUP BY src")
def a8(g):
    return g.calls.groupBy("src").agg(F.count("*").alias("calls"))


@query("A9_module_counts", f"SELECT owner AS module_id, count(DISTINCT file_path) AS files, count(*) FILTER (WHERE node_type = 'classifier') AS classifiers, count(*) FILTER (WHERE node_type = 'callable') AS callables FROM @nodes n JOIN {_LOOKUP} l ON n.structural_id = l.id GROUP BY owner")
def a9(g):
    n = g.nodes.join(module_lookup(g), C("structural_id") == C("id"))
    return n.groupBy(C("owner").alias("module_id")).agg(F.count_distinct("file_path").alias("files"), F.count_if(C("node_type") == "classifier").alias("classifiers"), F.count_if(C("node_type") == "callable").alias("callables"))


@query("A11_majority_language", "SELECT file_path, arg_max(language, (n, language)) AS language FROM (SELECT file_path, language, count(*) AS n FROM @nodes a GROUP BY 1, 2) x GROUP BY file_path")
def a11(g):
    n = g.nodes.groupBy("file_path", "language").agg(F.count("*").alias("n"))
    return n.groupBy("file_path").agg(F.max(F.struct("n", "language")).alias("b")).select("file_path", "b.language")


@query("A12_modules_per_package", "SELECT split_part(qualified_name, '.', 1) AS package, count(*) AS modules FROM @nodes n WHERE node_type = 'module' GROUP BY 1")
def a12(g):
    return g.nodes.filter("node_type = 'module'").groupBy(F.substring_index("qualified_name", ".", 1).alias("package")).agg(F.count("*").alias("modules"))


@query("A13_counterparts", "WITH f AS (SELECT structural_id AS id FROM @nodes n WHERE node_type = 'module' AND qualified_name LIKE 'ASIA.%'), x AS (SELECT dst AS id, 0 AS i, 1 AS o FROM @imports e WHERE src IN (SELECT id FROM f) UNION ALL SELECT src, 1, 0 FROM @imports e WHERE dst IN (SELECT id FROM f)) SELECT qualified_name, CAST(sum(i) AS BIGINT) AS incoming, CAST(sum(o) AS BIGINT) AS outgoing, count(*) AS edge_count FROM x JOIN @nodes m ON x.id = m.structural_id GROUP BY qualified_name")
def a13(g):
    m = g.nodes.filter("node_type = 'module'")
    return R.counterparts(g.imports, m, m.filter(C("qualified_name").startswith("ASIA.")).select(C("structural_id").alias("id")))


@query("A14_dependency_buckets", "SELECT split_part(b.qualified_name, '.', 1) AS package, split_part(a.qualified_name, '.', 1) = split_part(b.qualified_name, '.', 1) AS is_internal, count(*) AS n FROM @few_imports e JOIN @nodes a ON src = a.structural_id JOIN @nodes b ON dst = b.structural_id GROUP BY 1, 2")
def a14(g):
    m = g.nodes.filter("node_type = 'module'").select("structural_id", F.substring_index("qualified_name", ".", 1).alias("package"))
    a, b = m.select(C("structural_id").alias("src"), C("package").alias("own")), m.withColumnRenamed("structural_id", "dst")
    return g.few_imports.join(a, "src").join(b, "dst").groupBy("package", (C("own") == C("package")).alias("is_internal")).agg(F.count("*").alias("n"))


@query("A15_low_node_files", "SELECT coalesce(language, 'total') AS language, count(*) AS files, count(*) FILTER (WHERE n <= 1) AS low_files, round_even(count(*) FILTER (WHERE n <= 1) / count(*), 4) AS ratio, count(*) >= 200 AND round_even(count(*) FILTER (WHERE n <= 1) / count(*), 4) >= 0.6 AS warning FROM (SELECT language, file_path, count(*) AS n FROM @nodes a GROUP BY 1, 2) x GROUP BY ROLLUP (language)")
def a15(g):
    return R.low_node_files(g.nodes)


@query("A18_status_totals", "SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS scope, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))")
def a18(g):
    return g.documents.cube("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("scope"), "files", "chars")


@query("A20_candidate_histogram", "SELECT n AS candidates, count(*) AS names FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1) x GROUP BY n")
def a20(g):
    return g.part.groupBy("p_name").agg(F.count("*").alias("candidates")).groupBy("candidates").agg(F.count("*").alias("names"))


@query("A21_callsite_flow", "SELECT coalesce(event_type, 'total') AS caller, count(*) AS observed, count(*) FILTER (WHERE value > 50) AS persisted, greatest(0, count(*) - count(*) FILTER (WHERE value > 50)) AS filtered FROM events GROUP BY ROLLUP (event_type)")
def a21(g):
    kept = F.count_if(C("value") > 50)
    return g.events.rollup("event_type").agg(F.count("*").alias("observed"), kept.alias("persisted"), F.greatest(F.lit(0), F.count("*") - kept).alias("filtered")).withColumn("caller", F.coalesce("event_type", F.lit("total"))).drop("event_type")


@query("A22_pair_expansion", "SELECT count(*) FILTER (WHERE n = 1) AS one_pair, count(*) FILTER (WHERE n > 1) AS many_pairs, max(n) AS most FROM (SELECT src, count(*) AS n FROM @calls c GROUP BY src) x")
def a22(g):
    return g.calls.groupBy("src").agg(F.count("*").alias("n")).agg(F.count_if(C("n") == 1).alias("one_pair"), F.count_if(C("n") > 1).alias("many_pairs"), F.max("n").alias("most"))


@query("A26_types_per_file", "SELECT file_path, count(*) FILTER (WHERE node_type = 'module') AS module, count(*) FILTER (WHERE node_type = 'classifier') AS classifier, count(*) FILTER (WHERE node_type = 'callable') AS callable FROM @nodes n GROUP BY file_path")
def a26(g):
    return g.nodes.groupBy("file_path").pivot("node_type", ["module", "classifier", "callable"]).count().na.fill(0)


@query("A29_guardrails", "SELECT lang, count(quality) AS eligible, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 1) >= 0.85 * count(quality) AS passed FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a29(g):
    per = g.documents.select("doc_id", "lang").join(g.labels, "doc_id").groupBy("lang").agg(F.count("quality").alias("eligible"), F.count_if(C("quality") == 1).alias("accepted"))
    return per.withColumn("passed", C("accepted") >= 0.85 * C("eligible"))


@query("T3_fan_top", f"SELECT * FROM (SELECT 'in' AS side, node_id, fan_in AS n FROM {_FAN} f WHERE edge_kind = 'CALLS' AND fan_in > 0 ORDER BY n DESC, node_id LIMIT 5) a UNION ALL SELECT * FROM (SELECT 'out' AS side, node_id, fan_out AS n FROM {_FAN} f WHERE edge_kind = 'CALLS' AND fan_out > 0 ORDER BY n DESC, node_id LIMIT 5) b")
def t3(g):
    f = R.fan_stats(g.calls)
    side = lambda name, col: f.filter(C(col) > 0).select(F.lit(name).alias("side"), "node_id", C(col).alias("n")).orderBy(F.desc("n"), "node_id").limit(5)
    return side("in", "fan_in").unionByName(side("out", "fan_out"))


@query("T10_top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def t10(g):
    return g.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)
