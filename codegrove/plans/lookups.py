"""Scans, point lookups, searches and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codegrove.functions import names as N
from codegrove.plans.registry import query

C = F.col
FOCUS = "ASIA"
NODE = ["structural_id", "node_type", "language", "qualified_name", "file_path"]


@query("S3_language_of_extension", "SELECT url, CASE WHEN ext IN ('fr','en') THEN 'western' WHEN ext = 'de' THEN 'central' ELSE 'other' END AS routed FROM (SELECT url, split_part(split_part(url, '.example.', 2), '/', 2) AS ext FROM pages)")
def s3(g):
    ext = F.get(F.split(F.get(F.split("url", r"\.example\."), F.lit(1)), "/"), F.lit(1))
    return g.pages.select("url", F.when(ext.isin("fr", "en"), "western").when(ext == "de", "central").otherwise("other").alias("routed"))


@query("S4_file_snapshots", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, greatest(1, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END) AS line_count FROM documents WHERE text IS NOT NULL")
def s4(g):
    t = C("text")
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"))) + F.when(t.endswith("\n"), 0).otherwise(1)
    return g.documents.filter(t.isNotNull()).select("doc_id", F.octet_length(t).cast("long").alias("size"), F.greatest(F.lit(1), lines).cast("long").alias("line_count"))


@query("S5_discovery_counters", "SELECT lang, count(*) AS candidates, count(*) FILTER (WHERE source NOT IN ('src0','src1')) AS discovered, count(*) FILTER (WHERE source IN ('src0','src1')) AS excluded FROM documents GROUP BY lang")
def s5(g):
    out = C("source").isin("src0", "src1")
    return g.documents.groupBy("lang").agg(F.count("*").alias("candidates"), F.count_if(~out).alias("discovered"), F.count_if(out).alias("excluded"))


@query("S6_languages_present", "SELECT DISTINCT lang FROM documents")
def s6(g):
    return g.documents.select("lang").distinct()


@query("S7_nodes_by_type", f"SELECT {', '.join(NODE)} FROM @nodes n WHERE node_type IN ('module', 'classifier')")
def s7(g):
    return g.nodes.filter(C("node_type").isin("module", "classifier")).select(*NODE)


@query("S8_edges_of_sources", "SELECT src, dst, edge_type FROM @structure e WHERE edge_type = 'IMPORTS_DECLARED' AND src IN (SELECT structural_id FROM @nodes n WHERE qualified_name LIKE 'ASIA.%')")
def s8(g):
    ids = g.nodes.filter(C("qualified_name").startswith("ASIA.")).select(C("structural_id").alias("src"))
    return g.structure.filter("edge_type = 'IMPORTS_DECLARED'").join(ids, "src", "left_semi").select("src", "dst", "edge_type")


@query("S9_nodes_of_files", "SELECT structural_id, qualified_name FROM @nodes n WHERE file_path IN (SELECT file_path FROM @nodes m WHERE node_type = 'classifier' AND language = 'MACHINERY')")
def s9(g):
    paths = g.nodes.filter("node_type = 'classifier' and language = 'MACHINERY'").select("file_path").distinct()
    return g.nodes.join(paths, "file_path", "left_semi").select("structural_id", "qualified_name")


@query("S10_edges_by_kind", "SELECT src, dst, edge_type FROM (SELECT * FROM @structure e UNION ALL SELECT * FROM @calls c) x WHERE edge_type IN ('CALLS', 'EXTENDS')")
def s10(g):
    return g.structure.unionByName(g.calls).filter(C("edge_type").isin("CALLS", "EXTENDS"))


@query("S12_typed_values", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS non_negative FROM events")
def s12(g):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return g.events.select("event_id", k.alias("k"), F.when(k >= 0, k).alias("non_negative"))


@query("S13_source_lines", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS snippet FROM documents")
def s13(g):
    return g.documents.select("doc_id", F.array_join(F.slice(F.split("text", "\n"), 2, 3), "\n").alias("snippet"))


@query("S14_bounded_dump", "SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) > 20000 THEN 'skipped_too_large' ELSE 'ok' END AS status, CASE WHEN strlen(text) <= 20000 THEN text END AS content FROM documents")
def s14(g):
    size = F.octet_length("text")
    return g.documents.select("doc_id", F.when(C("text").isNull(), "missing").when(size > 20000, "skipped_too_large").otherwise("ok").alias("status"), F.when(size <= 20000, C("text")).alias("content"))


@query("S17_latest_values", "SELECT user_id, arg_max(event_type, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def s17(g):
    return g.events.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("value"), F.max("event_id").alias("seq"))


@query("S19_calls_of_removed", "SELECT src, dst FROM @calls c WHERE src NOT IN (SELECT structural_id FROM @nodes n WHERE language = '1-URGENT') AND dst NOT IN (SELECT structural_id FROM @nodes n WHERE language = '1-URGENT')")
def s19(g):
    gone = g.nodes.filter("language = '1-URGENT'").select("structural_id")
    return g.calls.join(gone.withColumnRenamed("structural_id", "src"), "src", "left_anti").join(gone.withColumnRenamed("structural_id", "dst"), "dst", "left_anti").select("src", "dst")


@query("P1_lookup_by_name", "SELECT structural_id, language, file_path FROM @nodes n WHERE node_type = 'module' AND qualified_name = 'ASIA'")
def p1(g):
    return g.nodes.filter((C("node_type") == "module") & (C("qualified_name") == FOCUS)).select("structural_id", "language", "file_path")


@query("P2_lookup_by_id", "SELECT structural_id, qualified_name FROM @nodes n WHERE structural_id = sha1('module:ASIA:ASIA') AND node_type IN ('module','classifier')")
def p2(g):
    sid = N.structural_id(F.lit("module"), F.lit(FOCUS), F.lit(FOCUS))
    return g.nodes.filter((C("structural_id") == sid) & C("node_type").isin("module", "classifier")).select("structural_id", "qualified_name")


@query("P3_search", "SELECT structural_id, qualified_name FROM @nodes n WHERE lower(qualified_name) LIKE '%000001%' ORDER BY qualified_name, file_path, structural_id LIMIT 5")
def p3(g):
    return g.nodes.filter(F.lower("qualified_name").contains("000001")).orderBy("qualified_name", "file_path", "structural_id").limit(5).select("structural_id", "qualified_name")


@query("P4_module_or_below", "SELECT structural_id FROM @nodes n WHERE qualified_name = 'ASIA' OR starts_with(qualified_name, 'ASIA.')")
def p4(g):
    return g.nodes.filter(N.within(C("qualified_name"), FOCUS)).select("structural_id")


@query("P5_module_substring", "SELECT structural_id FROM @nodes n WHERE node_type = 'module' AND contains(lower(qualified_name), 'ia')")
def p5(g):
    return g.nodes.filter((C("node_type") == "module") & F.lower("qualified_name").contains("ia")).select("structural_id")


_P6 = """WITH q AS (SELECT * FROM (VALUES ('ASIA'), ('customer#000000007'), ('nothing')) t(query)),
m AS (SELECT query, structural_id, CASE WHEN structural_id = query THEN 1 WHEN qualified_name = query THEN 2 ELSE 3 END AS stage
 FROM q JOIN @nodes n ON structural_id = query OR qualified_name = query OR contains(lower(qualified_name), lower(query)) WHERE node_type <> 'callable'),
b AS (SELECT query, min(stage) AS stage FROM m GROUP BY query),
s AS (SELECT m.query, m.stage, count(*) AS n, min(structural_id) AS one FROM m JOIN b ON m.query = b.query AND m.stage = b.stage GROUP BY m.query, m.stage)
SELECT q.query, CASE WHEN n IS NULL THEN 'missing' WHEN stage < 3 AND n = 1 THEN 'exact' ELSE 'ambiguous' END AS status, CASE WHEN stage < 3 AND n = 1 THEN one END AS resolved, coalesce(n, 0) AS candidates
FROM q LEFT JOIN s ON q.query = s.query"""


@query("P6_resolve_identifier", _P6)
def p6(g):
    asked = ["ASIA", "customer#000000007", "nothing"]
    n = g.nodes.filter("node_type <> 'callable'")
    stage = lambda q: F.when(C("structural_id") == q, 1).when(C("qualified_name") == q, 2).when(F.lower("qualified_name").contains(q.lower()), 3)
    hits = n.select("structural_id", F.explode(F.array(*[F.struct(F.lit(q).alias("query"), stage(q).alias("stage")) for q in asked])).alias("h")).select("structural_id", "h.*").filter("stage is not null")
    best = hits.groupBy("query", "stage").agg(F.count("*").alias("n"), F.min("structural_id").alias("one"))
    best = best.groupBy("query").agg(F.min(F.struct("stage", "n", "one")).alias("b")).select("query", "b.*")
    exact = (C("stage") < 3) & (C("n") == 1)
    all_q = g.spark.createDataFrame([(q,) for q in asked], "query string")
    return all_q.join(best, "query", "left").select("query", F.when(C("n").isNull(), "missing").when(exact, "exact").otherwise("ambiguous").alias("status"), F.when(exact, C("one")).alias("resolved"), F.coalesce("n", F.lit(0)).alias("candidates"))


@query("P7_id_or_name", "SELECT structural_id FROM @nodes n WHERE structural_id = 'EUROPE' OR qualified_name = 'EUROPE' ORDER BY structural_id LIMIT 1")
def p7(g):
    return g.nodes.filter((C("structural_id") == "EUROPE") | (C("qualified_name") == "EUROPE")).orderBy("structural_id").limit(1).select("structural_id")


@query("P10_under_roots", "SELECT DISTINCT file_path FROM @nodes n WHERE starts_with(file_path, 'ASIA/') OR starts_with(file_path, 'EUROPE/')")
def p10(g):
    return g.nodes.filter(C("file_path").startswith("ASIA/") | C("file_path").startswith("EUROPE/")).select("file_path").distinct()


@query("P11_scope_bucket", "SELECT url, CASE WHEN list_contains(string_split(url, '/'), 'test') OR list_contains(string_split(url, '/'), 'tests') THEN 'tests' ELSE 'non_tests' END AS scope FROM pages")
def p11(g):
    return g.pages.select("url", N.tests_bucket(C("url")).alias("scope"))


@query("P12_directory_bucket", "SELECT array_to_string(list_slice(string_split(file_path, '/'), 1, 2), '/') AS directory, count(*) AS n FROM @nodes n GROUP BY 1")
def p12(g):
    return g.nodes.groupBy(N.directory_bucket(C("file_path")).alias("directory")).agg(F.count("*").alias("n"))


@query("P13_relative_depth", "SELECT structural_id, len(string_split(qualified_name, '.')) - 1 AS depth FROM @nodes n WHERE starts_with(qualified_name, 'ASIA.') AND len(string_split(qualified_name, '.')) - 1 <= 2")
def p13(g):
    d = N.depth(C("qualified_name")) - 1
    return g.nodes.filter(C("qualified_name").startswith("ASIA.") & (d <= 2)).select("structural_id", d.alias("depth"))


@query("P17_all_tokens", "SELECT structural_id FROM @nodes n WHERE (contains(lower(qualified_name), 'asia') OR contains(lower(file_path), 'asia')) AND (contains(lower(qualified_name), '00001') OR contains(lower(file_path), '00001'))")
def p17(g):
    both = F.concat_ws("\n", F.lower("qualified_name"), F.lower("file_path"))
    return g.nodes.filter(F.forall(F.array(F.lit("asia"), F.lit("00001")), lambda t: F.contains(both, t))).select("structural_id")


@query("P18_fixture_paths", "SELECT url, len(list_filter(string_split(lower(url), '/'), lambda x: x IN ('fr', 'generated', 'fixtures', 'vendor'))) > 0 AS fixture FROM pages")
def p18(g):
    return g.pages.select("url", F.arrays_overlap(F.split(F.lower("url"), "/"), F.array(*map(F.lit, ["fr", "generated", "fixtures", "vendor"]))).alias("fixture"))


@query("F1_name_parts", "SELECT structural_id, regexp_extract(qualified_name, '[^.]*$') AS terminal, CASE WHEN contains(qualified_name, '.') THEN regexp_extract(qualified_name, '^(.*)[.][^.]*$', 1) ELSE '' END AS qualifier, CAST(len(string_split(qualified_name, '.')) AS BIGINT) AS depth FROM @nodes n")
def f1(g):
    q = C("qualified_name")
    return g.nodes.select("structural_id", N.terminal(q).alias("terminal"), N.qualifier(q).alias("qualifier"), N.depth(q).alias("depth"))


@query("F2_ancestors", "SELECT structural_id, array_to_string(list_transform(range(len(string_split(qualified_name, '.')) - 1, 0, -1), lambda i: array_to_string(list_slice(string_split(qualified_name, '.'), 1, i), '.')), '|') AS ancestors FROM @nodes n")
def f2(g):
    return g.nodes.select("structural_id", F.array_join(N.ancestors(C("qualified_name")), "|").alias("ancestors"))


@query("F3_edge_keys", "SELECT sha1(src || ':' || dst || ':' || edge_type) AS edge_key FROM @imports e")
def f3(g):
    return g.imports.select(N.edge_key(C("src"), C("dst"), C("edge_type")).alias("edge_key"))


@query("F4_span_hash", "SELECT doc_id, sha1(array_to_string(list_slice(string_split(regexp_replace(text, chr(13) || chr(10), chr(10), 'g'), chr(10)), 1, 3), chr(10))) AS line_span_hash FROM documents")
def f4(g):
    lines = F.split(F.replace(C("text"), F.lit("\r\n"), F.lit("\n")), "\n")
    return g.documents.select("doc_id", F.sha1(F.array_join(F.slice(lines, 1, 3), "\n").cast("binary")).alias("line_span_hash"))


@query("W1_sibling_numbers", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS occurrence FROM orders")
def w1(g):
    return g.orders.select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")).cast("long").alias("occurrence"))


@query("W3_call_ordinals", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ordinal, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS role_ordinal FROM conversations")
def w3(g):
    a, b = W.partitionBy("conv_id").orderBy("turn", "role", "text"), W.partitionBy("conv_id", "role").orderBy("turn", "text")
    return g.conversations.select("conv_id", "turn", F.row_number().over(a).cast("long").alias("ordinal"), F.row_number().over(b).cast("long").alias("role_ordinal"))


@query("W6_latest_snapshot", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def w6(g):
    return g.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey", "o_orderdate")


@query("K1_as_of_snapshot", "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) < (SELECT (o_orderdate, o_orderkey) FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def k1(g):
    o = g.orders.select("o_orderdate", "o_orderkey")
    at = o.agg(F.max_by(F.struct("o_orderdate", "o_orderkey"), "o_orderkey").alias("at")).scalar()
    return o.filter(F.struct("o_orderdate", "o_orderkey") < at).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(1).select("o_orderkey")


@query("K11_structural_hash", "SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS structural_hash FROM (SELECT 'N|' || structural_id || '|' || node_type || '|' || qualified_name AS line FROM @nodes n WHERE node_type = 'module' UNION ALL SELECT 'P|' || src || '|' || dst FROM @imports e) x")
def k11(g):
    n = g.nodes.filter("node_type = 'module'").select(F.concat(F.lit("N|"), F.concat_ws("|", "structural_id", "node_type", "qualified_name")).alias("line"))
    lines = n.unionByName(g.imports.select(F.concat(F.lit("P|"), F.concat_ws("|", "src", "dst")).alias("line")))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n").cast("binary"), 256).alias("structural_hash"))
