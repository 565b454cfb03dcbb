"""The call contract over the supplied tables, whole tables on both sides.

Symbols are the distinct names of parts inside modules of brands (some in the root module, in a module below a brand, in a
class, or constructors); a site is a supplier's shipment of a part under an identifier of one of several forms. A brand
imports the brand with the next number if one of its suppliers ships that in bulk.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from codegrove.functions import names as N
from codegrove.functions.storage import small, stored
from codegrove.operators import contract as K
from codegrove.operators import graph as G
from codegrove.plans.registry import query

C = F.col

_T = "p_name || '_' || CAST(p_partkey % 40 AS VARCHAR)"
_SYMBOL = """sha1('callable:part:' || name) AS candidate, name, module FROM (SELECT DISTINCT module, CASE WHEN k % 19 = 0 THEN module || '.' || t || '.__init__' WHEN k % 17 = 0 THEN module || '.Cls.' || t ELSE module || '.' || t END AS name
FROM (SELECT p_partkey AS k, @t AS t, CASE WHEN p_partkey % 13 = 0 THEN 'root' WHEN p_partkey % 11 = 0 THEN 'root.' || p_brand || '.sub' ELSE 'root.' || p_brand END AS module FROM part) a) b""".replace("@t", _T)
_BASE = f"""WITH RECURSIVE li AS (SELECT l_suppkey, {_T} AS t, p_brand, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
home AS (SELECT l_suppkey, arg_max(p_brand, (n, p_brand)) AS brand FROM (SELECT l_suppkey, p_brand, count(*) AS n FROM li GROUP BY 1, 2) x GROUP BY 1),
site AS (SELECT CAST(l_suppkey AS VARCHAR) || '/' || t AS site, 'root.' || brand AS caller_module, CASE l_suppkey % 7 WHEN 0 THEN t WHEN 1 THEN 'root.' || brand || '.' || t WHEN 2 THEN 'root.index.' || brand || '.' || t
 WHEN 3 THEN 'pkg.root.' || brand || '.' || t WHEN 4 THEN 'missing.' || t || 'x' WHEN 5 THEN brand || '.' || t ELSE 'root.' || t END AS identifier FROM (SELECT DISTINCT l_suppkey, t FROM li) x JOIN home USING (l_suppkey)),
sym AS (SELECT {_SYMBOL}),
idx AS (SELECT name AS symbol, * FROM sym UNION SELECT regexp_extract(name, '[^.]*$'), * FROM sym UNION SELECT regexp_replace(name, '[.]__init__$', ''), * FROM sym WHERE ends_with(name, '.__init__')
 UNION SELECT regexp_extract(regexp_replace(name, '[.]__init__$', ''), '[^.]*$'), * FROM sym WHERE ends_with(name, '.__init__')),
d AS (SELECT DISTINCT 'root.' || brand AS caller_module, 'root.' || p_brand AS module FROM li JOIN home USING (l_suppkey) WHERE l_quantity >= 50 AND CAST(regexp_extract(p_brand, '[0-9]+') AS INT) = CAST(regexp_extract(brand, '[0-9]+') AS INT) + 1),
reach AS (SELECT caller_module, module FROM d UNION SELECT reach.caller_module, d.module FROM reach JOIN d ON reach.module = d.caller_module),
key AS (SELECT DISTINCT caller_module, identifier FROM site),
cand AS (SELECT key.*, candidate, name, module, true AS direct FROM key JOIN idx ON identifier = symbol
 UNION ALL SELECT key.*, candidate, name, module, false FROM key JOIN idx ON regexp_extract(identifier, '[^.]*$') = symbol WHERE contains(identifier, '.') AND identifier NOT IN (SELECT symbol FROM idx)),
c AS (SELECT key.caller_module, key.identifier, candidate, name, cand.module, direct, contains(key.identifier, '.') AS dotted, coalesce(name = key.identifier, false) AS named,
 coalesce(cand.module = key.caller_module, false) AS same, coalesce(cand.module = 'root', false) AS above,
 coalesce(cand.module = key.caller_module OR cand.module = 'root' OR (key.caller_module, cand.module) IN (SELECT caller_module, module FROM d), false) AS near,
 coalesce(cand.module = key.caller_module OR starts_with(cand.module, key.caller_module || '.') OR (key.caller_module, regexp_replace(cand.module, '[.]sub$', '')) IN (SELECT caller_module, module FROM reach), false) AS reached,
 coalesce(direct OR name = key.identifier || '.__init__' OR replace(key.identifier, '.index.', '.') = name OR (regexp_replace(name, '[.]Cls[.]', '.') = replace(key.identifier, '.index.', '.') AND contains(name, '.Cls.')), false) AS shaped,
 coalesce(len(string_split(name, '.')) >= 3 AND len(string_split(key.identifier, '.')) >= 3 AND list_slice(string_split(name, '.'), -3, -1) = list_slice(string_split(key.identifier, '.'), -3, -1), false) AS tail
 FROM key LEFT JOIN cand ON key.caller_module = cand.caller_module AND key.identifier = cand.identifier),
g AS (SELECT caller_module, identifier, count(candidate) AS n, min(candidate) AS one, count(*) FILTER (WHERE dotted AND named) AS nn, min(candidate) FILTER (WHERE dotted AND named) AS cn,
 count(*) FILTER (WHERE near) AS nr, min(candidate) FILTER (WHERE near) AS cr, count(*) FILTER (WHERE near AND dotted AND tail) AS nt, min(candidate) FILTER (WHERE near AND dotted AND tail) AS ct,
 min(module) FILTER (WHERE near AND dotted AND tail) AS mt, bool_or(same) AS same, bool_or(above) AS above, bool_or(reached) AS reached, bool_or(dotted AND shaped) AS shaped,
 coalesce(array_to_string(list_slice(list_sort(list_distinct(array_agg(module) FILTER (WHERE module IS NOT NULL))), 1, 8), ','), '') AS module_hints FROM c GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN n = 0 THEN 'no_candidates' WHEN nn = 1 THEN '+exact_qname' WHEN n = 1 AND shaped THEN '+exact_qname' WHEN n = 1 AND same THEN '+module_scoped' WHEN n = 1 AND (above OR reached) THEN '+import_narrowed'
 WHEN n = 1 THEN 'unique_without_provenance' WHEN nr = 1 THEN '+import_narrowed' WHEN nr > 1 AND nt = 1 THEN CASE WHEN mt = caller_module THEN '+module_scoped' ELSE '+import_narrowed' END
 WHEN nr = 0 THEN 'ambiguous_no_in_scope_candidate' ELSE 'ambiguous_multiple_in_scope_candidates' END AS o FROM g),
decision AS (SELECT caller_module, identifier, CASE WHEN o NOT LIKE '+%' THEN NULL WHEN nn = 1 THEN cn WHEN n = 1 THEN one WHEN nr = 1 THEN cr ELSE ct END AS accepted, CASE WHEN o LIKE '+%' THEN substr(o, 2) END AS provenance,
 CASE WHEN o NOT LIKE '+%' THEN o END AS dropped_reason, n AS candidate_count, CASE WHEN o LIKE '+%' THEN 1 WHEN o = 'ambiguous_multiple_in_scope_candidates' THEN nr ELSE 0 END AS in_scope_count, module_hints FROM o),
row AS (SELECT site, decision.* FROM site JOIN decision USING (caller_module, identifier)),
gated AS (SELECT *, CASE WHEN candidate_count <= 0 THEN 'no_in_repo_candidate' WHEN accepted IS NULL THEN 'insufficient_static_evidence' WHEN substr(accepted, 1, 1) = '0' THEN 'outside_in_repo_scope' END AS gate_reason FROM row)
"""


class Contract:
    """Sites, keys and decisions; a decision is made for each distinct caller module and identifier."""

    def __init__(self, g):
        self.g = g

    @cached_property
    def _li(self):
        part = stored(self.g.part.select(C("p_partkey").alias("l_partkey"), F.concat_ws("_", "p_name", (C("p_partkey") % 40).cast("string")).alias("t"), "p_brand"))
        bulk = F.coalesce(C("l_quantity") >= 50, F.lit(False)).alias("bulk")
        return stored(self.g.lineitem.select("l_suppkey", "l_partkey", bulk).join(small(part), "l_partkey").select("l_suppkey", "t", "p_brand", "bulk"))

    @cached_property
    def _home(self):
        per = self._li.groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
        return stored(per.groupBy("l_suppkey").agg(F.max(F.struct("n", "p_brand")).alias("b")).select("l_suppkey", C("b.p_brand").alias("brand")))

    @cached_property
    def sites(self):
        """site, key, caller_module, identifier."""
        t, module = C("t"), F.concat(F.lit("root."), C("brand"))
        forms = [t, F.concat(module, F.lit("."), t), F.concat(F.lit("root.index."), C("brand"), F.lit("."), t), F.concat(F.lit("pkg."), module, F.lit("."), t), F.concat(F.lit("missing."), t, F.lit("x")), F.concat(C("brand"), F.lit("."), t)]
        form = F.concat(F.lit("root."), t)
        for k, f in reversed(list(enumerate(forms))):
            form = F.when(C("l_suppkey") % 7 == k, f).otherwise(form)
        rows = self._li.select("l_suppkey", "t").distinct().join(small(self._home), "l_suppkey")
        rows = rows.select(F.concat_ws("/", C("l_suppkey").cast("string"), t).alias("site"), module.alias("caller_module"), form.alias("identifier"))
        return stored(rows.withColumn("key", F.to_json(F.array("caller_module", "identifier"))))

    @cached_property
    def keys(self):
        """site (the key), caller_module, identifier, sites."""
        return stored(self.sites.groupBy(C("key").alias("site"), "caller_module", "identifier").agg(F.count("*").alias("sites")))

    @cached_property
    def symbols(self):
        k, brand = C("p_partkey"), F.concat(F.lit("root."), C("p_brand"))
        t = F.concat_ws("_", "p_name", (k % 40).cast("string"))
        rows = self.g.part.select(k, t.alias("t"), F.when(k % 13 == 0, "root").when(k % 11 == 0, F.concat(brand, F.lit(".sub"))).otherwise(brand).alias("module"))
        in_ = lambda *x: F.concat(C("module"), *[F.lit(y) if isinstance(y, str) else y for y in x])
        name = F.when(k % 19 == 0, in_(".", C("t"), ".__init__")).when(k % 17 == 0, in_(".Cls.", C("t"))).otherwise(in_(".", C("t")))
        rows = rows.select(name.alias("name"), "module").distinct()
        return stored(rows.select(F.sha1(F.concat(F.lit("callable:part:"), C("name")).cast("binary")).alias("candidate"), "name", "module"))

    @cached_property
    def index(self):
        return stored(K.symbol_keys(self.symbols))

    @cached_property
    def candidates(self):
        return stored(K.probe(self.keys.select("site", "identifier"), self.index))

    @cached_property
    def scopes(self):
        number = lambda c: F.regexp_extract(c, "[0-9]+", 0).try_cast("int")
        bulk = self._li.filter("bulk").select("l_suppkey", "p_brand").distinct().join(small(self._home), "l_suppkey").filter(number("p_brand") == number("brand") + 1)
        return stored(bulk.select(F.concat(F.lit("root."), C("brand")).alias("caller_module"), F.concat(F.lit("root."), C("p_brand")).alias("module")).distinct())

    @cached_property
    def reach(self):
        far = G.closure(self.scopes.select(C("caller_module").alias("src"), C("module").alias("dst")))
        return far.select(C("src").alias("caller_module"), C("dst").alias("module"))

    @cached_property
    def decisions(self):
        """Per key, with its number of sites and the gate's reason; callables whose id begins with 0 stand for those outside."""
        made = stored(K.decide(self.keys.select("site", "identifier", "caller_module"), self.candidates, self.scopes, self.reach).join(self.keys.select("site", "sites"), "site"))
        a, d = C("accepted"), C("dropped_reason")
        reason = K.gate_reason(F.when(d.isNull(), "accepted").otherwise("dropped"), a, C("provenance"), d, C("candidate_count"), ~a.startswith("0"))
        return made.withColumn("gate_reason", reason)

    def each(self, per_key, *cols):
        rows = self.sites.select("site", "key").join(small(stored(per_key.select(C("site").alias("key"), *cols))), "key")
        return rows.select("site", *cols)


@query("C7_contract_decisions", _BASE + "SELECT site, accepted, provenance, dropped_reason, candidate_count, in_scope_count, module_hints FROM row")
def c7_contract(g):
    k = Contract(g)
    return k.each(k.decisions, "accepted", "provenance", "dropped_reason", "candidate_count", "in_scope_count", "module_hints")


@query("C15_static_gate", _BASE + "SELECT site, gate_reason IS NULL AS persist, gate_reason, dropped_reason AS raw_drop_reason FROM gated")
def c15_static(g):
    k = Contract(g)
    return k.each(k.decisions, "gate_reason", "dropped_reason").select("site", C("gate_reason").isNull().alias("persist"), "gate_reason", C("dropped_reason").alias("raw_drop_reason"))


@query("A23_gate_reasons", _BASE + "SELECT gate_reason, count(*) AS sites FROM gated WHERE gate_reason IS NOT NULL GROUP BY 1")
def a23(g):
    return Contract(g).decisions.filter("gate_reason is not null").groupBy("gate_reason").agg(F.sum("sites").alias("sites"))


@query("C16_accepted_and_rejected", _BASE + "SELECT 'accepted' AS side, site, identifier, accepted AS callee, provenance AS why FROM gated WHERE gate_reason IS NULL UNION ALL SELECT 'rejected', site, identifier, NULL, gate_reason FROM gated WHERE gate_reason IS NOT NULL")
def c16(g):
    k = Contract(g)
    rows = k.each(k.decisions, "identifier", "accepted", "provenance", "gate_reason")
    ok = C("gate_reason").isNull()
    return rows.select(F.when(ok, "accepted").otherwise("rejected").alias("side"), "site", "identifier", F.when(ok, C("accepted")).alias("callee"), F.when(ok, C("provenance")).otherwise(C("gate_reason")).alias("why"))


@query("C14_callees_of_callers", _BASE + "SELECT caller_module, accepted AS callee, count(*) AS sites FROM gated WHERE gate_reason IS NULL GROUP BY 1, 2")
def c14(g):
    return Contract(g).decisions.filter("gate_reason is null").groupBy("caller_module", C("accepted").alias("callee")).agg(F.sum("sites").alias("sites"))


@query("C8_numbered_decisions", _BASE + "SELECT site, split_part(site, '/', 1) AS caller, row_number() OVER (PARTITION BY split_part(site, '/', 1) ORDER BY site) AS ordinal, row_number() OVER (PARTITION BY split_part(site, '/', 1), identifier ORDER BY site) AS identifier_ordinal, provenance, dropped_reason FROM row")
def c8(g):
    from pyspark.sql.window import Window as W

    k = Contract(g)
    rows = k.each(k.decisions, "identifier", "provenance", "dropped_reason").withColumn("caller", F.substring_index("site", "/", 1))
    at = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("site")).cast("long")
    return rows.select("site", "caller", at("caller").alias("ordinal"), at("caller", "identifier").alias("identifier_ordinal"), "provenance", "dropped_reason")


@query("C4_kept_identifiers", _BASE + "SELECT DISTINCT caller_module, identifier FROM row WHERE provenance IN ('exact_qname', 'module_scoped', 'import_narrowed')")
def c4(g):
    return Contract(g).decisions.filter(C("provenance").isin("exact_qname", "module_scoped", "import_narrowed")).select("caller_module", "identifier")


@query("J16_symbol_probe", _BASE + "SELECT caller_module, identifier, direct, count(*) AS candidates FROM cand GROUP BY 1, 2, 3")
def j16(g):
    k = Contract(g)
    return k.candidates.join(k.keys, "site").groupBy("caller_module", "identifier", "direct").agg(F.count("*").alias("candidates"))


@query("J18_modules_in_scope", _BASE + "SELECT DISTINCT caller_module, module FROM c WHERE reached")
def j18(g):
    k = Contract(g)
    return K.within_scope(k.candidates.join(k.keys, "site").select("caller_module", "module").distinct(), k.reach)


@query("G13_symbols_with_constructors", _BASE + "SELECT symbol, candidate FROM idx")
def g13_all(g):
    return Contract(g).index.select("symbol", "candidate").distinct()


@query("C18_written_calls", _BASE + "SELECT provenance, count(DISTINCT accepted) AS callees, count(*) AS sites FROM gated WHERE gate_reason IS NULL GROUP BY 1")
def c18(g):
    """Writes the kept calls, a folder per provenance, and counts what is read back; a caller listed twice fails the write."""
    k = Contract(g)
    kept = k.each(k.decisions.filter("gate_reason is null"), "accepted", "provenance")
    twice = k.sites.groupBy("site").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("a call site is listed more than once")
    return stored(kept).groupBy("provenance").agg(F.count_distinct("accepted").alias("callees"), F.count("*").alias("sites"))


@query("E9_shapes_of_names", _BASE + "SELECT name, identifier, name = identifier || '.__init__' AS constructor, replace(identifier, '.index.', '.') = name AS proxy FROM cand")
def e9(g):
    k = Contract(g)
    rows = k.candidates.join(k.keys, "site")
    return rows.select("name", "identifier", N.is_constructor_of(C("name"), C("identifier")).alias("constructor"), N.same_proxy(C("name"), C("identifier")).alias("proxy"))


@query(
    "X6_reachable_modules",
    _BASE + """, barrel AS (SELECT DISTINCT regexp_replace(module, '[.]sub$', '') AS module, module AS target FROM sym WHERE ends_with(module, '.sub')),
looked AS (SELECT caller_module, caller_module AS module FROM key UNION SELECT caller_module, module FROM reach)
SELECT caller_module, module FROM looked UNION SELECT caller_module, 'root' FROM key UNION SELECT caller_module, target FROM looked JOIN barrel USING (module)""",
)
def x6(g):
    """Modules below a brand stand for what the brand's barrel exports."""
    k = Contract(g)
    barrels = k.symbols.filter(C("module").endswith(".sub")).select(F.regexp_replace("module", r"\.sub$", "").alias("module"), C("module").alias("target")).distinct()
    return K.reachable_modules(k.keys, k.scopes, k.reach, barrels)
