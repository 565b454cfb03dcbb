"""Graph queries: reachability, cycles, integrity, unions of edge sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegrove.operators import graph as G
from codegrove.plans.registry import query

C = F.col


@query("U2_unified_edges", "SELECT DISTINCT src, dst, edge_type FROM (SELECT * FROM @structure a UNION ALL SELECT * FROM @calls b) x")
def u2(g):
    return g.structure.unionByName(g.calls).distinct()


@query("U3_edges_both_ways", "WITH f AS (SELECT structural_id FROM @nodes n WHERE qualified_name LIKE 'EUROPE.%') SELECT src, dst FROM @few_imports e WHERE src IN (SELECT * FROM f) UNION SELECT src, dst FROM @few_imports e WHERE dst IN (SELECT * FROM f)")
def u3(g):
    f = g.nodes.filter(C("qualified_name").startswith("EUROPE.")).select("structural_id")
    e = g.few_imports.select("src", "dst")
    a = e.join(f.withColumnRenamed("structural_id", "src"), "src", "left_semi").select("src", "dst")
    return a.unionByName(e.join(f.withColumnRenamed("structural_id", "dst"), "dst", "left_semi").select("src", "dst")).distinct()


@query("U6_intersected_filters", "SELECT structural_id FROM @nodes n WHERE language = 'BUILDING' INTERSECT SELECT structural_id FROM @nodes n WHERE contains(qualified_name, 'ASIA')")
def u6(g):
    n = g.nodes
    return n.filter("language = 'BUILDING'").select("structural_id").intersect(n.filter(C("qualified_name").contains("ASIA")).select("structural_id"))


@query("G3_descendants", "WITH RECURSIVE t AS (SELECT structural_id AS root, structural_id AS id, CAST(0 AS BIGINT) AS depth FROM @nodes n WHERE qualified_name = 'ASIA' UNION ALL SELECT root, dst, depth + 1 FROM t JOIN @contains e ON t.id = e.src) SELECT root, id, depth FROM t WHERE depth > 0")
def g3(g):
    return G.descendants(g.contains, g.nodes.filter("qualified_name = 'ASIA'").select(C("structural_id").alias("id")))


_CLOSED = "WITH RECURSIVE e AS (SELECT src, dst FROM @edges x), t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON t.dst = e.src)"


@query("G4_import_cycles", _CLOSED.replace("@edges", "@imports") + " SELECT id, min(other) AS component FROM (SELECT a.src AS id, a.dst AS other FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src) x GROUP BY id HAVING count(DISTINCT other) > 1")
def g4(g):
    return G.strong_components(g.imports)


@query("G4_few_import_cycles", _CLOSED.replace("@edges", "@few_imports") + " SELECT id, min(other) AS component FROM (SELECT a.src AS id, a.dst AS other FROM t a JOIN t b ON a.src = b.dst AND a.dst = b.src) x GROUP BY id HAVING count(DISTINCT other) > 1")
def g4_few(g):
    return G.strong_components(g.few_imports)


@query("G5_import_closure", _CLOSED.replace("@edges", "@few_imports") + " SELECT src, dst FROM t")
def g5(g):
    return G.closure(g.few_imports).select("src", "dst")


@query("G6_bounded_reach", "WITH RECURSIVE e AS (SELECT src, dst FROM @few_imports x), t AS (SELECT src, dst, CAST(1 AS BIGINT) AS d FROM e UNION SELECT t.src, e.dst, d + 1 FROM t JOIN e ON t.dst = e.src WHERE d < 4) SELECT src, dst, min(d) AS distance FROM t WHERE src <> dst GROUP BY src, dst")
def g6(g):
    return G.closure(g.few_imports, 4).filter("src <> dst")


@query("G7_module_distance", "WITH RECURSIVE e AS (SELECT src, dst FROM @few_imports x), t AS (SELECT src, dst, CAST(1 AS BIGINT) AS d FROM e UNION SELECT t.src, e.dst, d + 1 FROM t JOIN e ON t.dst = e.src WHERE d < 6), m AS (SELECT src, dst, min(d) AS d FROM t GROUP BY 1, 2), n AS (SELECT structural_id AS id FROM @nodes q WHERE node_type = 'module' AND contains(qualified_name, '.')) SELECT a.id AS src, b.id AS dst, CASE WHEN a.id = b.id THEN 0 ELSE coalesce(d, 106) END AS distance FROM n a JOIN n b ON true LEFT JOIN m ON a.id = m.src AND b.id = m.dst WHERE a.id <= b.id")
def g7(g):
    near = G.closure(g.few_imports, 6)
    n = g.nodes.filter((C("node_type") == "module") & C("qualified_name").contains(".")).select(C("structural_id").alias("id"))
    all_ids = n.agg(F.array_sort(F.collect_set("id")).alias("all")).scalar()  # modules that import anything are few beside nodes
    pairs = n.select(C("id").alias("src"), F.explode(all_ids).alias("dst")).filter("src <= dst")
    return pairs.join(near, ["src", "dst"], "left").select("src", "dst", F.when(C("src") == C("dst"), 0).otherwise(F.coalesce("distance", F.lit(106))).alias("distance"))


@query("G8_inheritance_cycles", "SELECT DISTINCT a.src, a.dst FROM @extends a JOIN @extends b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst UNION SELECT src, dst FROM @extends e WHERE src = dst")
def g8(g):
    e = g.extends.select("src", "dst")
    back = e.select(C("dst").alias("src"), C("src").alias("dst"))
    two = e.filter("src < dst").join(back, ["src", "dst"], "left_semi")
    return two.unionByName(e.filter("src = dst")).distinct()


@query("G9_lexical_orphans", "SELECT structural_id FROM @nodes n WHERE node_type <> 'module' AND structural_id NOT IN (SELECT dst FROM @contains e WHERE src IN (SELECT structural_id FROM @nodes m WHERE language <> 'MACHINERY'))")
def g9(g):
    n = g.nodes
    kept = g.contains.join(n.filter("language <> 'MACHINERY'").select(C("structural_id").alias("src")), "src", "left_semi")
    return G.orphans(n, kept).select("structural_id")


@query("G9_dangling_edges", "SELECT DISTINCT src, dst, edge_type FROM @contains e WHERE src NOT IN (SELECT structural_id FROM @nodes n WHERE language <> 'MACHINERY') OR dst NOT IN (SELECT structural_id FROM @nodes n WHERE language <> 'MACHINERY')")
def g9_dangling(g):
    return G.dangling(g.contains, g.nodes.filter("language <> 'MACHINERY'"))


@query("G10_containment_faults", "SELECT c.structural_id, 'span' AS fault FROM @contains e JOIN @nodes c ON dst = c.structural_id JOIN @nodes p ON src = p.structural_id WHERE p.node_type = 'classifier' AND (c.start_line < p.start_line OR c.end_line > 900) UNION ALL SELECT dst, 'several_parents' FROM @contains e GROUP BY dst HAVING count(*) > 1 UNION ALL SELECT c.structural_id, 'module_target' FROM @contains e JOIN @nodes c ON dst = c.structural_id JOIN @nodes p ON src = p.structural_id WHERE c.node_type = 'module' AND p.node_type <> 'module'")
def g10(g):
    n = g.nodes.withColumn("end_line", F.when(C("node_type") == "classifier", 900).otherwise(C("end_line")))
    return G.containment_faults(n, g.contains)


@query("G13_symbol_index", "SELECT DISTINCT structural_id, qualified_name AS symbol FROM @nodes n WHERE node_type = 'callable' UNION SELECT structural_id, regexp_extract(qualified_name, '[^.]*$') FROM @nodes n WHERE node_type = 'callable'")
def g13(g):
    from codegrove.operators.resolution import symbol_index

    return symbol_index(g.nodes)
