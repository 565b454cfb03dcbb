"""Status, structure and reference reports over the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from codegrove.functions import names as N
from codegrove.functions.storage import small, stored
from codegrove.operators import graph as G
from codegrove.operators import overlay as V
from codegrove.plans.aggregates import _FAN, _LOOKUP, class_lookup, fans, module_lookup
from codegrove.plans.overlays import _CHANGES, _NEW, _OLD, _changes, _sides
from codegrove.plans.patches import _DIFF, _ROWS, _call_changes, _rows
from codegrove.plans.registry import query
from codegrove.plans.structure import _CLOSED

C = F.col

_ALL = "(SELECT * FROM @structure s UNION ALL SELECT * FROM @calls c)"


def _modules(g):
    return g.nodes.filter("node_type = 'module'").select("structural_id", "qualified_name", "language")


def _top(rows, n, *order):
    return rows.orderBy(*order).limit(n)


# joins

@query("J4_class_relations", "SELECT src AS classifier, dst AS other, 'out' AS direction FROM @extends e UNION ALL SELECT dst, src, 'in' FROM @extends e")
def j4(g):
    ends = F.array(F.struct(C("src").alias("classifier"), C("dst").alias("other"), F.lit("out").alias("direction")), F.struct(C("dst").alias("classifier"), C("src").alias("other"), F.lit("in").alias("direction")))
    return g.extends.select(F.explode(ends).alias("e")).select("e.*")


@query("J5_calls_with_modules", f"SELECT src, dst, a.owner AS src_module, b.owner AS dst_module FROM @calls c JOIN {_LOOKUP} a ON src = a.id JOIN {_LOOKUP} b ON dst = b.id")
def j5(g):
    m = module_lookup(g)
    return g.calls.join(m.select(C("id").alias("src"), C("owner").alias("src_module")), "src").join(m.select(C("id").alias("dst"), C("owner").alias("dst_module")), "dst").select("src", "dst", "src_module", "dst_module")


_CLASS = "(SELECT dst AS id, src AS owner FROM @contains e JOIN @nodes n ON src = structural_id WHERE node_type = 'classifier')"


@query("J6_calls_with_classes", f"SELECT src, dst, a.owner AS src_class, b.owner AS dst_class FROM @calls c JOIN {_CLASS} a ON src = a.id JOIN {_CLASS} b ON dst = b.id")
def j6(g):
    m = class_lookup(g)
    return g.calls.join(m.select(C("id").alias("src"), C("owner").alias("src_class")), "src").join(m.select(C("id").alias("dst"), C("owner").alias("dst_class")), "dst").select("src", "dst", "src_class", "dst_class")


@query("J7_fan_with_kind", f"SELECT node_id, node_type AS node_kind, edge_kind, fan_in, fan_out FROM {_FAN} f JOIN @nodes n ON node_id = structural_id")
def j7(g):
    return fans(g).join(g.nodes.select(C("structural_id").alias("node_id"), C("node_type").alias("node_kind")), "node_id").select("node_id", "node_kind", "edge_kind", "fan_in", "fan_out")


@query("J15_module_inside_name", "WITH m AS (SELECT DISTINCT split_part(qualified_name, '.', 2) AS name FROM @nodes n WHERE node_type = 'module' AND contains(qualified_name, '.') UNION SELECT qualified_name FROM @nodes n WHERE node_type = 'module'), q AS (SELECT o_orderkey AS id, 'repo.' || r_name || '.' || n_name || '.x' AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT id, arg_max(m.name, (len(string_split(m.name, '.')), m.name)) AS module FROM q JOIN m ON contains('.' || q.name || '.', '.' || m.name || '.') GROUP BY id")
def j15(g):
    """Names are cut into all runs of their parts; as these are few kinds beside rows, modules are looked up by run."""
    m = g.nodes.filter("node_type = 'module'").select("qualified_name")
    m = m.select(F.explode(F.array_distinct(F.array("qualified_name", N.terminal(C("qualified_name"))))).alias("run")).distinct()
    place = g.nation.join(g.region, C("n_regionkey") == C("r_regionkey")).select(C("n_nationkey").alias("c_nationkey"), F.concat(F.lit("repo."), "r_name", F.lit("."), "n_name", F.lit(".x")).alias("name"))
    names = place.select("name").distinct()
    parts, n = F.split("name", r"\."), F.size(F.split("name", r"\."))
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "."))))
    hit = names.select("name", F.explode(runs).alias("run")).join(m, "run")
    best = hit.groupBy("name").agg(F.max(F.struct(N.depth(C("run")).alias("d"), "run")).alias("b")).select("name", C("b.run").alias("module"))
    ids = g.orders.join(g.customer.select(C("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(place, "c_nationkey").select(C("o_orderkey").alias("id"), "name")
    return ids.join(best, "name").select("id", "module")


@query("J17_unique_bindings", "SELECT o_orderkey, CASE WHEN n = 1 THEN one ELSE o_orderpriority END AS target FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, CAST(min(l_suppkey) AS VARCHAR) AS one FROM lineitem GROUP BY 1) f ON o_orderkey = l_orderkey")
def j17(g):
    facts = g.lineitem.groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("one"), F.max("l_suppkey").alias("other")).filter("one = other")
    return g.orders.join(facts, "o_orderkey", "left").select("o_orderkey", F.coalesce(C("one").cast("string"), "o_orderpriority").alias("target"))


# aggregates

@query("A10_callable_totals", f"SELECT m.qualified_name AS module, n.language, count(*) AS callables FROM @nodes n JOIN {_LOOKUP} l ON n.structural_id = l.id JOIN @nodes m ON l.owner = m.structural_id WHERE n.node_type = 'callable' GROUP BY GROUPING SETS ((module), (n.language))")
def a10(g):
    own = module_lookup(g).join(_modules(g).select(C("structural_id").alias("owner"), C("qualified_name").alias("module")), "owner").select(C("id").alias("structural_id"), "module")
    n = g.nodes.filter("node_type = 'callable'").select("structural_id", "language").join(own, "structural_id")
    return n.groupingSets([["module"], ["language"]], "module", "language").agg(F.count("*").alias("callables"))


@query("A16_reconciled_files", "SELECT lang, discovered, indexed, discovered - indexed AS missing, round_even((discovered - indexed) / discovered, 4) AS ratio, discovered >= 200 AND round_even((discovered - indexed) / discovered, 4) >= 0.4 AS warning FROM (SELECT lang, count(*) AS discovered, count(l.doc_id) AS indexed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang) x")
def a16(g):
    known = g.labels.select("doc_id", F.lit(1).alias("known"))
    per = g.documents.select("doc_id", "lang").join(known, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("discovered"), F.count("known").alias("indexed"))
    gone = C("discovered") - C("indexed")
    ratio = F.bround(gone / C("discovered"), 4)
    return per.select("lang", "discovered", "indexed", gone.alias("missing"), ratio.alias("ratio"), ((C("discovered") >= 200) & (ratio >= 0.4)).alias("warning"))


@query("A17_structural_density", "SELECT * FROM (SELECT 'total' AS directory, count(*) AS files, round_even(sum(n) / count(*), 4) AS nodes_per_file, count(*) FILTER (WHERE n <= 1) AS low_files FROM (SELECT file_path, count(*) AS n FROM @nodes a GROUP BY 1) x) t UNION ALL SELECT * FROM (SELECT array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') AS directory, count(*) AS files, round_even(sum(n) / count(*), 4) AS nodes_per_file, count(*) FILTER (WHERE n <= 1) AS low_files FROM (SELECT file_path, count(*) AS n FROM @nodes a GROUP BY 1) x GROUP BY 1 ORDER BY low_files DESC, directory LIMIT 5) d")
def a17(g):
    files = stored(g.nodes.groupBy("file_path").agg(F.count("*").alias("n")))
    made = [F.count("*").alias("files"), F.bround(F.sum("n") / F.count("*"), 4).alias("nodes_per_file"), F.count_if(C("n") <= 1).alias("low_files")]
    by = _top(files.groupBy(N.directory_bucket(C("file_path")).alias("directory")).agg(*made), 5, F.desc("low_files"), "directory")
    return files.agg(*made).select(F.lit("total").alias("directory"), "files", "nodes_per_file", "low_files").unionByName(by)


@query("A19_changes_by_type", f"SELECT node_type, count(*) FILTER (WHERE row_origin = 'overlay_added') AS add, count(*) FILTER (WHERE row_origin = 'overlay_changed') AS modify, count(*) FILTER (WHERE row_origin = 'overlay_removed') AS remove FROM {_ROWS} x WHERE row_origin <> 'committed' GROUP BY 1")
def a19(g):
    rows = _rows(g).filter("row_origin <> 'committed'").groupBy("node_type").pivot("row_origin", ["overlay_added", "overlay_changed", "overlay_removed"]).count().na.fill(0)
    return rows.select("node_type", C("overlay_added").alias("add"), C("overlay_changed").alias("modify"), C("overlay_removed").alias("remove"))


@query("A27_child_languages", "WITH m AS (SELECT structural_id AS id FROM @nodes n WHERE qualified_name = 'ASIA.NATION_2' OR (node_type = 'module' AND starts_with(qualified_name, 'EUROPE.'))), a AS (SELECT m.id, dst FROM m JOIN @contains e ON src = m.id), b AS (SELECT a.id, e.dst FROM a JOIN @nodes n ON a.dst = structural_id AND node_type = 'classifier' JOIN @contains e ON e.src = a.dst) SELECT id, node_type, language, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x JOIN @nodes n ON dst = structural_id GROUP BY 1, 2, 3")
def a27(g):
    m = g.nodes.filter((C("qualified_name") == "ASIA.NATION_2") | ((C("node_type") == "module") & C("qualified_name").startswith("EUROPE."))).select(C("structural_id").alias("src"), C("structural_id").alias("id"))
    n, e = g.nodes.select(C("structural_id").alias("dst"), "node_type", "language"), g.contains.select("src", "dst")
    one = e.join(m, "src").select("id", "dst").join(n, "dst")
    two = one.filter("node_type = 'classifier'").select("id", C("dst").alias("src")).join(e, "src").select("id", "dst").join(n, "dst")
    return one.unionByName(two).groupBy("id", "node_type", "language").agg(F.count("*").alias("n"))


@query("A28_import_fans", "SELECT 'in' AS side, dst AS module, count(*) AS n FROM @imports e GROUP BY dst UNION ALL SELECT 'out', src, count(*) FROM @imports e GROUP BY src")
def a28(g):
    ends = F.array(F.struct(F.lit("in").alias("side"), C("dst").alias("module")), F.struct(F.lit("out").alias("side"), C("src").alias("module")))
    return g.imports.select(F.explode(ends).alias("e")).groupBy("e.side", "e.module").agg(F.count("*").alias("n"))


@query("A30_origin_counts", f"SELECT row_origin, count(*) AS n FROM {_ROWS} x GROUP BY 1")
def a30(g):
    return _rows(g).groupBy("row_origin").agg(F.count("*").alias("n"))


@query("A31_committed_snapshots", "SELECT count(*) AS snapshots FROM orders WHERE o_orderstatus = 'F'")
def a31(g):
    return g.orders.filter("o_orderstatus = 'F'").agg(F.count("*").alias("snapshots"))


@query("A9_functions_and_methods", f"SELECT l.owner AS module_id, count(*) FILTER (WHERE p.node_type = 'classifier') AS methods, count(*) FILTER (WHERE p.node_type <> 'classifier') AS functions FROM @nodes n JOIN @contains e ON e.dst = n.structural_id JOIN @nodes p ON e.src = p.structural_id JOIN {_LOOKUP} l ON n.structural_id = l.id WHERE n.node_type = 'callable' GROUP BY 1")
def a9_kinds(g):
    kind = g.nodes.select(C("structural_id").alias("src"), (C("node_type") == "classifier").alias("method"))
    c = g.nodes.filter("node_type = 'callable'").select(C("structural_id").alias("dst"))
    rows = g.contains.select("src", "dst").join(c, "dst", "left_semi").join(kind, "src").select(C("dst").alias("id"), "method")
    return rows.join(module_lookup(g), "id").groupBy(C("owner").alias("module_id")).agg(F.count_if("method").alias("methods"), F.count_if(~C("method")).alias("functions"))


@query("A12_modules_per_language", "SELECT language, count(*) AS modules FROM @nodes n WHERE node_type = 'module' GROUP BY 1")
def a12_languages(g):
    return g.nodes.filter("node_type = 'module'").groupBy("language").agg(F.count("*").alias("modules"))


@query("A22_pairs_of_all_callers", "SELECT count(*) FILTER (WHERE k = 0) AS no_pair, count(*) FILTER (WHERE k = 1) AS one_pair, count(*) FILTER (WHERE k > 1) AS many_pairs, max(k) AS most FROM (SELECT structural_id, coalesce(n, 0) AS k FROM @nodes a LEFT JOIN (SELECT src, count(*) AS n FROM @calls c GROUP BY src) x ON src = structural_id WHERE node_type = 'callable') y")
def a22_all(g):
    per = g.calls.groupBy(C("src").alias("structural_id")).agg(F.count("*").alias("n"))
    k = F.coalesce("n", F.lit(0))
    return g.nodes.filter("node_type = 'callable'").select("structural_id").join(per, "structural_id", "left").agg(F.count_if(k == 0).alias("no_pair"), F.count_if(k == 1).alias("one_pair"), F.count_if(k > 1).alias("many_pairs"), F.max(k).alias("most"))


# windows, orders and limits

@query("W7_first_parents", "SELECT dst AS structural_id, arg_min(src, (edge_type, src)) AS parent FROM @structure e GROUP BY dst")
def w7(g):
    return g.structure.groupBy(C("dst").alias("structural_id")).agg(F.min(F.struct("edge_type", "src")).alias("p")).select("structural_id", C("p.src").alias("parent"))


@query("T1_ordered_modules", "SELECT structural_id, row_number() OVER (ORDER BY coalesce(qualified_name, ''), structural_id) AS place FROM @nodes n WHERE node_type = 'module'")
def t1(g):
    return _modules(g).select("structural_id", F.row_number().over(W.orderBy(F.coalesce("qualified_name", F.lit("")), "structural_id")).cast("long").alias("place"))


@query("T2_ordered_edges", "SELECT src, dst, edge_type, row_number() OVER (ORDER BY src, dst, edge_type) AS place FROM @imports e")
def t2(g):
    return g.imports.withColumn("place", F.row_number().over(W.orderBy("src", "dst", "edge_type")).cast("long"))


@query("T6_submodules", "SELECT a.qualified_name AS module, b.qualified_name AS submodule, row_number() OVER (PARTITION BY a.qualified_name ORDER BY len(string_split(b.qualified_name, '.')), b.qualified_name) AS place FROM @nodes a JOIN @nodes b ON starts_with(b.qualified_name, a.qualified_name || '.') WHERE a.node_type = 'module' AND b.node_type = 'module'")
def t6(g):
    m = _modules(g).select("qualified_name")
    below = m.select(C("qualified_name").alias("submodule"), F.explode(N.ancestors(C("qualified_name"))).alias("module")).join(m.withColumnRenamed("qualified_name", "module"), "module", "left_semi")
    return below.withColumn("place", F.row_number().over(W.partitionBy("module").orderBy(N.depth(C("submodule")), "submodule")).cast("long"))


_PREVIEW = 3


@query("T7_import_previews", f"SELECT src, count(*) AS total, least(count(*), {_PREVIEW}) AS shown, count(*) > {_PREVIEW} AS truncated, array_to_string(list_slice(list_sort(array_agg(dst)), 1, {_PREVIEW}), '|') AS entries FROM @imports e GROUP BY src")
def t7(g):
    return V.previews(g.imports, "src", "dst", _PREVIEW)


@query("T8_module_coverage", f"SELECT m.qualified_name AS module, CASE WHEN count(*) <= 0 THEN 1.0 ELSE round_even(count(*) FILTER (WHERE n.node_type = 'callable') / count(*), 4) END AS coverage FROM @nodes n JOIN {_LOOKUP} l ON n.structural_id = l.id JOIN @nodes m ON l.owner = m.structural_id GROUP BY 1")
def t8(g):
    n = g.nodes.select(C("structural_id").alias("id"), "node_type").join(module_lookup(g), "id").groupBy("owner").agg(F.count_if(C("node_type") == "callable").alias("part"), F.count("*").alias("whole"))
    return n.join(_modules(g).select(C("structural_id").alias("owner"), C("qualified_name").alias("module")), "owner").select("module", N.coverage(C("part"), C("whole")).alias("coverage"))


@query("T11_ordered_changes", f"SELECT structural_id, row_origin, row_number() OVER (PARTITION BY row_origin ORDER BY file_path, qualified_name, structural_id) AS place FROM {_ROWS} x WHERE row_origin <> 'committed' AND node_type = 'classifier' OR row_origin = 'overlay_removed'")
def t11(g):
    rows = _rows(g).filter("row_origin <> 'committed' and node_type = 'classifier' or row_origin = 'overlay_removed'")
    return rows.select("structural_id", "row_origin", F.row_number().over(W.partitionBy("row_origin").orderBy("file_path", "qualified_name", "structural_id")).cast("long").alias("place"))


@query("U7_shared_bindings", "SELECT DISTINCT a.l_suppkey AS one, b.l_suppkey AS other FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey WHERE b.l_suppkey = a.l_suppkey + 1")
def u7(g):
    e = g.lineitem.select("l_suppkey", "l_orderkey").distinct()
    return e.select(C("l_suppkey").alias("one"), "l_orderkey").join(e.select((C("l_suppkey") - 1).alias("one"), "l_orderkey", C("l_suppkey").alias("other")), ["one", "l_orderkey"]).select("one", "other").distinct()


@query("U8_first_occurrences", "SELECT conv_id, string_agg(role, '|' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) x GROUP BY conv_id")
def u8(g):
    """Distinct roles of a conversation in the order of their first turns; aggregated before they are listed."""
    first = g.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    return first.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]), "|").alias("roles"))


# graph

@query("G12_module_bindings", f"SELECT DISTINCT owner AS module, regexp_extract(qualified_name, '[^.]*$') AS binding FROM {_LOOKUP} l JOIN @nodes n ON id = structural_id WHERE node_type = 'classifier'")
def g12(g):
    n = g.nodes.filter("node_type = 'classifier'").select(C("structural_id").alias("id"), N.terminal(C("qualified_name")).alias("binding"))
    return module_lookup(g).join(n, "id").select(C("owner").alias("module"), "binding").distinct()


@query("G14_module_context", _CLOSED.replace("@edges", "@imports") + " SELECT qualified_name AS module, (SELECT count(*) FROM e WHERE e.src = structural_id) AS imported, (SELECT count(*) FROM t WHERE t.src = structural_id) AS reached, len(string_split(qualified_name, '.')) - 1 AS ancestors, file_path FROM @nodes n WHERE node_type = 'module'")
def g14(g):
    m = g.nodes.filter("node_type = 'module'").select("structural_id", "qualified_name", "file_path")
    far = G.closure(g.imports)
    per = far.groupBy(C("src").alias("structural_id")).agg(F.count_if(C("distance") == 1).alias("imported"), F.count("*").alias("reached"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return m.join(per, "structural_id", "left").select(C("qualified_name").alias("module"), zero("imported"), zero("reached"), F.size(N.ancestors(C("qualified_name"))).cast("long").alias("ancestors"), "file_path")


@query("G11_barrel_exports", "WITH RECURSIVE e AS (SELECT src, dst FROM @imports x), t AS (SELECT src, dst, 1 AS d FROM e UNION SELECT t.src, e.dst, d + 1 FROM t JOIN e ON t.dst = e.src WHERE d < 4), b AS (SELECT n.structural_id AS module, k.language AS label FROM @nodes n JOIN @contains c ON c.src = n.structural_id JOIN @nodes k ON k.structural_id = c.dst WHERE n.node_type = 'module' AND k.node_type = 'classifier') SELECT DISTINCT x.module AS barrel, y.module AS exported FROM (SELECT DISTINCT module, label FROM b) x JOIN (SELECT DISTINCT src, dst FROM t) r ON r.src = x.module AND r.dst <> x.module JOIN (SELECT DISTINCT module, label FROM b) y ON y.module = r.dst AND y.label = x.label")
def g11(g):
    """A module exports the modules within four imports that share one of its binding labels."""
    n = g.nodes.select("structural_id", "node_type", "language")
    kids = n.filter("node_type = 'classifier'").select(C("structural_id").alias("dst"), C("language").alias("label"))
    b = g.contains.select("src", "dst").join(kids, "dst").select(C("src").alias("module"), "label").distinct().join(n.filter("node_type = 'module'").select(C("structural_id").alias("module")), "module", "left_semi")
    b = stored(b)
    r = G.closure(g.imports, 4).select(C("src").alias("barrel"), C("dst").alias("exported")).filter("barrel <> exported")
    return r.join(b.select(C("module").alias("barrel"), "label"), "barrel").join(b.select(C("module").alias("exported"), "label"), ["exported", "label"]).select("barrel", "exported").distinct()


# stored rows and point lookups

@query("K2_new_ids", "SELECT DISTINCT structural_id FROM @nodes n WHERE node_type = 'classifier' AND structural_id NOT IN (SELECT src FROM @extends e)")
def k2(g):
    return g.nodes.filter("node_type = 'classifier'").select("structural_id").distinct().join(g.extends.select(C("src").alias("structural_id")), "structural_id", "left_anti")


@query("K3_call_dump", "SELECT src, dst FROM @calls c")
def k3(g):
    return g.calls.select("src", "dst")


@query("K8_calls_without_callers", "SELECT src, dst FROM @calls c WHERE src NOT IN (SELECT structural_id FROM @nodes n WHERE node_type = 'callable' AND start_line % 5 = 0)")
def k8(g):
    listed = g.nodes.filter("node_type = 'callable' and start_line % 5 = 0").select(C("structural_id").alias("src"))
    return g.calls.join(listed, "src", "left_anti").select("src", "dst")


@query("K10_content_hashes", "SELECT structural_id, sha1(file_path || ':' || start_line || '-' || end_line) AS content_hash FROM @nodes n WHERE node_type <> 'module' AND file_path <> ''")
def k10(g):
    span = F.concat("file_path", F.lit(":"), C("start_line").cast("string"), F.lit("-"), C("end_line").cast("string"))
    return g.nodes.filter("node_type <> 'module' and file_path <> ''").select("structural_id", F.sha1(span.cast("binary")).alias("content_hash"))


@query("K12_caller_metadata", "SELECT DISTINCT structural_id, language, qualified_name, file_path FROM @nodes n WHERE structural_id IN (SELECT src FROM @calls c)")
def k12(g):
    callers = g.calls.select(C("src").alias("structural_id")).distinct()
    return g.nodes.join(callers, "structural_id", "left_semi").select("structural_id", "language", "qualified_name", "file_path")


@query("K13_newest_snapshots", "SELECT o_orderkey AS snapshot_id, o_orderstatus = 'F' AS is_committed, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def k13(g):
    top = _top(g.orders.select(C("o_orderkey").alias("snapshot_id"), (C("o_orderstatus") == "F").alias("is_committed"), "o_orderdate"), 20, F.desc("o_orderdate"), F.desc("snapshot_id"))
    return top.select("snapshot_id", "is_committed", F.row_number().over(W.orderBy(F.desc("o_orderdate"), F.desc("snapshot_id"))).cast("long").alias("place"))


@query("K14_overlay_metadata", f"SELECT c.src, c.dst, x.qualified_name, x.end_line FROM {_DIFF} c JOIN {_ROWS} x ON c.src = x.structural_id")
def k14(g):
    meta = _rows(g).select(C("structural_id").alias("src"), "qualified_name", "end_line")
    return _call_changes(g).select("src", "dst").join(meta, "src").select("src", "dst", "qualified_name", "end_line")


@query("K17_module_contents", f"SELECT owner AS module, 'file' AS kind, file_path AS item FROM {_LOOKUP} l JOIN @nodes n ON id = structural_id GROUP BY 1, 3 UNION ALL SELECT src, 'import', dst FROM @imports e")
def k17(g):
    files = module_lookup(g).join(g.nodes.select(C("structural_id").alias("id"), "file_path"), "id").select(C("owner").alias("module"), F.lit("file").alias("kind"), C("file_path").alias("item")).distinct()
    return files.unionByName(g.imports.select(C("src").alias("module"), F.lit("import").alias("kind"), C("dst").alias("item")))


@query("K17_methods", "SELECT m.src AS module, k.dst AS method FROM @contains m JOIN @nodes c ON m.dst = c.structural_id AND c.node_type = 'classifier' JOIN @contains k ON k.src = c.structural_id")
def k17_methods(g):
    e = g.contains.select("src", "dst")
    c = g.nodes.filter("node_type = 'classifier'").select(C("structural_id").alias("cls"))
    one = e.select(C("src").alias("module"), C("dst").alias("cls")).join(c, "cls", "left_semi")
    return one.join(e.select(C("src").alias("cls"), C("dst").alias("method")), "cls").select("module", "method")


@query("K18_module_graph", "SELECT DISTINCT split_part(a.qualified_name, '.', 2) AS module, split_part(b.qualified_name, '.', 2) AS neighbour FROM @imports e JOIN @nodes a ON src = a.structural_id JOIN @nodes b ON dst = b.structural_id WHERE a.structural_id <> b.structural_id")
def k18(g):
    m = _modules(g).select("structural_id", F.get(F.split("qualified_name", r"\."), F.lit(1)).alias("name"))
    e = g.imports.filter("src <> dst").join(m.select(C("structural_id").alias("src"), C("name").alias("module")), "src")
    return e.join(m.select(C("structural_id").alias("dst"), C("name").alias("neighbour")), "dst").select("module", "neighbour").distinct()


@query("K20_import_references", "WITH h AS (SELECT structural_id AS id FROM @nodes n WHERE node_type = 'module' AND contains(lower(qualified_name), 'asia')) SELECT id, 'out' AS direction, dst AS other FROM h JOIN @imports e ON src = id UNION ALL SELECT id, 'in', src FROM h JOIN @imports e ON dst = id")
def k20(g):
    h = small(stored(_modules(g).filter(F.lower("qualified_name").contains("asia")).select(C("structural_id").alias("id"))))
    e = g.imports.select("src", "dst")
    out = e.join(h, C("src") == C("id")).select("id", F.lit("out").alias("direction"), C("dst").alias("other"))
    return out.unionByName(e.join(h, C("dst") == C("id")).select("id", F.lit("in").alias("direction"), C("src").alias("other")))


@query("K22_stored_diagnostics", "SELECT user_id, CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE user_id IN (SELECT min(user_id) FROM events UNION ALL SELECT max(user_id) FROM events) GROUP BY user_id")
def k22(g):
    asked = g.events.agg(F.array(F.min("user_id"), F.max("user_id")).alias("u")).select(F.explode("u").alias("user_id"))
    rows = g.events.join(asked.distinct(), "user_id", "left_semi")
    return rows.groupBy("user_id").agg(F.sum(F.from_json("props", "k long")["k"]).alias("total"))


# secondary reports

@query("E2_fan_entries", f"SELECT node_id, coalesce(qualified_name, node_id) AS name, n, row_number() OVER (ORDER BY n DESC, node_id) AS place FROM (SELECT node_id, fan_in AS n FROM {_FAN} f WHERE edge_kind = 'CALLS' ORDER BY n DESC, node_id LIMIT 10) x LEFT JOIN @nodes a ON node_id = structural_id")
def e2(g):
    top = _top(fans(g).filter("edge_kind = 'CALLS'").select("node_id", C("fan_in").alias("n")), 10, F.desc("n"), "node_id")
    named = top.join(g.nodes.select(C("structural_id").alias("node_id"), "qualified_name"), "node_id", "left")
    return named.select("node_id", F.coalesce("qualified_name", "node_id").alias("name"), "n", F.row_number().over(W.orderBy(F.desc("n"), "node_id")).cast("long").alias("place"))


@query("E4_duplicate_callers", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def e4(g):
    return g.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("E12_diagnostics_by_language", "SELECT lang, count(*) AS files, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, count(*) = 0 AS nothing_found FROM documents GROUP BY lang")
def e12(g):
    t = C("text")
    return g.documents.groupBy("lang").agg(F.count("*").alias("files"), F.count_if(t.isNull() | (t == "")).alias("empty"), F.coalesce(F.sum(F.length(t)), F.lit(0)).alias("chars"), (F.count("*") == 0).alias("nothing_found"))


@query("E19_changed_modules", f"SELECT array_to_string(list_slice(string_split(qualified_name, '.'), 1, 2), '.') AS module, count(*) AS changes FROM {_ROWS} x WHERE row_origin <> 'committed' GROUP BY 1")
def e19(g):
    return _rows(g).filter("row_origin <> 'committed'").groupBy(F.substring_index("qualified_name", ".", 2).alias("module")).agg(F.count("*").alias("changes"))


@query("E20_call_edge_entries", f"SELECT src, dst, CASE diff_kind WHEN 'add' THEN 'overlay_added' ELSE 'overlay_removed' END AS row_origin FROM {_DIFF} x ORDER BY src, dst, diff_kind LIMIT 100")
def e20(g):
    rows = _call_changes(g)
    origin = F.when(C("diff_kind") == "add", "overlay_added").otherwise("overlay_removed")
    return _top(rows, 100, "src", "dst", "diff_kind").select("src", "dst", origin.alias("row_origin"))


@query("E25_repository_status", "SELECT count(*) AS snapshots, count(*) FILTER (WHERE o_orderstatus = 'F') AS committed, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders")
def e25(g):
    return g.orders.agg(F.count("*").alias("snapshots"), F.count_if(C("o_orderstatus") == "F").alias("committed"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("E26_ranked_search", "SELECT structural_id, qualified_name, CAST(CASE WHEN lower(qualified_name) = 'asia' THEN 1.0 WHEN lower(regexp_extract(qualified_name, '[^.]*$')) = 'asia' THEN 0.9 WHEN lower(qualified_name) LIKE '%.asia' THEN 0.8 WHEN lower(qualified_name) LIKE 'asia%' THEN 0.75 WHEN contains(lower(qualified_name), 'asia') THEN 0.6 ELSE 0.5 END AS DOUBLE) AS score FROM @nodes n WHERE node_type = 'module' AND contains(lower(qualified_name), 'asia') ORDER BY score DESC, qualified_name, structural_id LIMIT 5")
def e26(g):
    hit = _modules(g).filter(F.lower("qualified_name").contains("asia"))
    return _top(hit.select("structural_id", "qualified_name", N.match_score("asia", C("structural_id"), C("qualified_name")).alias("score")), 5, F.desc("score"), "qualified_name", "structural_id")


@query("E27_assembled_references", "SELECT 'CALLS' AS edge_type, src, dst FROM @calls c WHERE dst IN (SELECT structural_id FROM @nodes n WHERE ends_with(qualified_name, '.P1')) UNION ALL SELECT edge_type, src, dst FROM @imports e WHERE dst IN (SELECT structural_id FROM @nodes n WHERE qualified_name = 'ASIA.NATION_2')")
def e27(g):
    n = g.nodes.select("structural_id", "qualified_name")
    calls = g.calls.join(n.filter(C("qualified_name").endswith(".P1")).select(C("structural_id").alias("dst")), "dst", "left_semi")
    imports = g.imports.join(n.filter("qualified_name = 'ASIA.NATION_2'").select(C("structural_id").alias("dst")), "dst", "left_semi")
    return calls.select("edge_type", "src", "dst").unionByName(imports.select("edge_type", "src", "dst"))


@query("E28_module_roots", "SELECT DISTINCT qualified_name AS module, regexp_replace(file_path, '/[^/]*$', '') AS root FROM @nodes n WHERE node_type = 'module'")
def e28(g):
    return g.nodes.filter("node_type = 'module'").select(C("qualified_name").alias("module"), F.regexp_replace("file_path", "/[^/]*$", "").alias("root")).distinct()


@query("P8_sole_callables", "SELECT file_path, min(structural_id) AS callable_id FROM @nodes n WHERE node_type = 'callable' GROUP BY file_path HAVING count(*) = 1")
def p8(g):
    per = g.nodes.filter("node_type = 'callable'").groupBy("file_path").agg(F.min("structural_id").alias("callable_id"), F.count("*").alias("n"))
    return per.filter("n = 1").drop("n")


@query("P9_min_fan", f"SELECT k, count(*) AS nodes FROM {_FAN} f, (VALUES (1), (3), (5), (8)) t(k) WHERE greatest(fan_in, fan_out) >= k GROUP BY k")
def p9(g):
    asked = F.explode(F.filter(F.array(*map(F.lit, (1, 3, 5, 8))), lambda k: F.greatest("fan_in", "fan_out") >= k))
    return fans(g).select(asked.alias("k")).groupBy("k").agg(F.count("*").alias("nodes"))


@query("P16_affected_modules", f"WITH x AS (SELECT * FROM {_ROWS} r WHERE row_origin <> 'committed') SELECT n.qualified_name AS module, bool_or(x.structural_id IS NOT NULL) AS affected, count(DISTINCT x.file_path) AS files FROM @nodes n LEFT JOIN x ON x.qualified_name = n.qualified_name OR starts_with(x.qualified_name, n.qualified_name || '.') WHERE n.node_type = 'module' GROUP BY 1")
def p16(g):
    x = _rows(g).filter("row_origin <> 'committed'").select("file_path", F.explode(N.prefixes(C("qualified_name"))).alias("qualified_name"))
    per = x.join(small(stored(_modules(g).select("qualified_name"))), "qualified_name", "left_semi").groupBy("qualified_name").agg(F.count_distinct("file_path").alias("files"))
    return _modules(g).join(per, "qualified_name", "left").select(C("qualified_name").alias("module"), C("files").isNotNull().alias("affected"), F.coalesce("files", F.lit(0)).alias("files"))


@query("D16_patched_dependencies", f"SELECT coalesce(a.o_custkey, b.o_custkey) AS src, coalesce(a.o_orderkey, b.o_orderkey) AS dst, CASE WHEN a.o_orderkey IS NULL THEN 'overlay_added' WHEN b.o_orderkey IS NULL THEN 'overlay_removed' ELSE 'committed' END AS row_origin FROM (SELECT DISTINCT o_custkey, o_orderkey FROM {_OLD} o) a FULL JOIN (SELECT DISTINCT o_custkey, o_orderkey FROM {_NEW} n) b ON a.o_custkey = b.o_custkey AND a.o_orderkey = b.o_orderkey")
def d16_patched(g):
    old, new = (s.select(C("o_custkey").alias("src"), C("o_orderkey").alias("dst")).distinct() for s in _sides(g))
    return V.patched_edges(old, new, ["src", "dst"])


@query("D1_change_set", "SELECT path, kind FROM (SELECT 'old/' || o_orderkey AS path, 'remove' AS kind FROM orders WHERE o_orderstatus IN ('O') UNION ALL SELECT 'new/' || o_orderkey, 'add' FROM orders WHERE o_orderstatus IN ('O', 'P') UNION ALL SELECT 'old/' || o_orderkey, 'modify' FROM orders WHERE o_orderstatus = 'F') x")
def d1(g):
    s = C("o_orderstatus")
    status = F.when(s == "O", "R100").when(s == "P", "A").when(s == "F", "M")
    rows = g.orders.select(status.alias("status"), F.concat(F.lit("old/"), C("o_orderkey").cast("string")).alias("old_path"), F.concat(F.lit("new/"), C("o_orderkey").cast("string")).alias("new_path"))
    rows = rows.withColumn("old_path", F.when(C("status") == "A", F.lit(None)).otherwise(C("old_path")))
    return V.change_set(rows).select("path", "kind")


@query("D23_overlay_rows", f"SELECT snapshot, count(*) AS n_rows, count(DISTINCT o_orderkey) AS nodes FROM (SELECT 's' || o_orderkey % 3 AS snapshot, * FROM {_CHANGES} c) x WHERE snapshot <> 's1' GROUP BY 1")
def d23(g):
    """Overlay rows written by snapshot, one snapshot cleared, and what is left read back."""
    from codegrove.sources import sinks

    table = sinks.Table(g.spark, "overlay", "snapshot")
    table.write(_changes(g).withColumn("snapshot", F.concat(F.lit("s"), (C("o_orderkey") % 3).cast("string"))))
    table.clear("s1")
    return table.read().groupBy("snapshot").agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("nodes"))


@query("R19_overlay_impact", f"SELECT true AS overlay_available, (SELECT count(*) FROM {_CHANGES} x) AS node_change_count, (SELECT count(*) FROM {_DIFF} y) AS call_change_count")
def r19(g):
    n = _changes(g).agg(F.count("*").alias("node_change_count"))
    c = _call_changes(g).agg(F.count("*").alias("call_change_count"))
    return n.select(F.lit(True).alias("overlay_available"), "node_change_count", F.lit(1).alias("one")).join(c.withColumn("one", F.lit(1)), "one").drop("one")


# Projections, what scope they have, what changes affect them; those without any are not patched.
PROFILE = [
    ("callable_overview", "callable", "nodes"), ("callable_source", "callable", ""), ("classifier_call_graph_summary", "classifier", "calls"), ("classifier_inheritance", "classifier", ""),
    ("classifier_overview", "classifier", "nodes"), ("concatenated_source", "unknown", ""), ("dependency_edges", "module", "edges"), ("fan_summary", "fan", "calls,edges"), ("file_outline", "file", "nodes"),
    ("hotspot_summary", "codebase", "nodes,edges"), ("module_call_graph_summary", "module", "calls"), ("module_overview", "module", "nodes,edges"), ("snapshot_provenance", "unknown", ""),
    ("structural_index", "codebase", "nodes,edges"), ("symbol_lookup", "query", "nodes"), ("symbol_references", "query", "nodes"),
]
_PROFILE_SQL = ", ".join(f"('{p}', '{s}', '{a}')" for p, s, a in PROFILE)


@query("R20_projection_profile", f"SELECT projection, scope_type, affected_by, affected_by <> '' AS supports_patch, CASE WHEN NOT dirty THEN 'committed_only' WHEN NOT available THEN 'overlay_unavailable' WHEN affected_by <> '' THEN 'patchable' ELSE 'metadata_only' END AS current_state, dirty, available FROM (VALUES {_PROFILE_SQL}) t(projection, scope_type, affected_by), (VALUES (false, false), (true, false), (true, true)) s(dirty, available)")
def r20_all(g):
    rows = g.spark.createDataFrame(PROFILE, "projection string, scope_type string, affected_by string")
    states = F.explode(F.array(*[F.struct(F.lit(d).alias("dirty"), F.lit(a).alias("available")) for d, a in ((False, False), (True, False), (True, True))]))
    rows = rows.withColumn("supports_patch", C("affected_by") != "").withColumn("s", states).select("projection", "scope_type", "affected_by", "supports_patch", "s.dirty", "s.available")
    state = F.when(~C("dirty"), "committed_only").when(~C("available"), "overlay_unavailable").when(C("supports_patch"), "patchable").otherwise("metadata_only")
    return rows.withColumn("current_state", state)
