"""A parser's rows leave the worker as they are made."""

import pytest

import __spark_entry__
from codegrove.sources import python_source

PAGE = 4096
ROWS = 600_000


def rows_of(path, text):
    """Many rows of one file; the last has the MB that the worker grew by meanwhile."""

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * PAGE // 1_000_000

    before = held()
    for i in range(ROWS):
        yield ("call", "callable", f"{path}.name{i}", i, i, f"target{i}", i, None)
    yield ("node", "module", path, 1, 1, None, held() - before, None)


def test_a_worker_does_not_hold_all_rows_of_a_batch(spark):
    files = spark.createDataFrame([("a", ""), ("b", "")], "file_path string, text string").coalesce(1)
    rows = python_source.parse(files, rows_of).cache()
    assert rows.count() == 2 * (ROWS + 1)
    assert rows.filter("kind = 'call'").selectExpr("sum(ordinal) s").first().s == ROWS * (ROWS - 1)
    assert [r.ordinal for r in rows.filter("kind = 'node' and ordinal >= 60").collect()] == []
    rows.unpersist()


def test_edges_between_names_that_two_kinds_share(spark):
    """Module a.b of one file and class b in another have one qualified name; each edge is there once for either."""
    files = [("a.py", "class b:\n    def c(self):\n        pass\n"), ("a/b.py", "import a\ndef c():\n    pass\n"), ("a/__init__.py", "import a.b\n")]
    rows = python_source.parse(spark.createDataFrame(files, "file_path string, text string"))
    n = python_source.nodes(rows)
    label = {r.structural_id: (r.node_type, r.qualified_name) for r in n.collect()}
    module, kind, inner = ("module", "a.b"), ("classifier", "a.b"), ("callable", "a.b.c")
    got = sorted((r.edge_type, label[r.src], label[r.dst]) for r in python_source.edges(rows, n).collect())
    a = ("module", "a")
    contained = [(a, module), (a, kind), (module, inner), (kind, inner)]
    imported = [(a, module), (a, kind), (module, a), (kind, a)]
    assert got == sorted([("LEXICALLY_CONTAINS", *e) for e in contained] + [("IMPORTS_DECLARED", *e) for e in imported])


#: Exchanges of a query: one brings a file's parts together; I2 has another for its own distinct rows.
EXCHANGES = {"I2_parse_errors": 2, "I6_call_targets": 1, "I3_parsed_nodes": 1}
WANT = {"I2_parse_errors": [("mod10.py",)], "I6_call_targets": [(f"mod{s}.S{s}.p{p}", "helper") for s in (11, 9) for p in (1, 2)]}
WANT["I3_parsed_nodes"] = sorted([(f"mod{s}", "module") for s in (9, 10, 11)] + [(f"mod{s}.S{s}", "classifier") for s in (9, 11)] + [(c, "callable") for c, _ in WANT["I6_call_targets"]])


@pytest.mark.parametrize("name", EXCHANGES)
def test_pairs_are_shuffled_once_without_repeats(spark, tmp_path, name):
    """Shipments are not shuffled as pairs and then again as files."""
    rows = [(s, p) for s in (9, 10, 11) for p in (1, 2, 2)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == EXCHANGES[name]
    assert sorted(tuple(r) for r in got.collect()) == WANT[name]


def test_imports_shuffle_pairs_once(spark, tmp_path, monkeypatch):
    from codegrove.plans import sources

    plans, stored = [], sources.stored
    monkeypatch.setattr(sources, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    spark.createDataFrame([(s, p) for s in (8, 9, 10, 11) for p in (1, 2, 2)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()["I5_internal_imports"](spark, str(tmp_path))
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1]
    assert sorted(tuple(r) for r in got.collect()) == [("mod8", "mod9"), ("mod9", "mod10")]


ODD = '''\
"""Text."""
import a, b.c
from . import d
@deco(f(1))
class K(base(2), m.Base, key=g(3)):  # a comment
    # another
    x = h(4)
    @one
    @two(5)
    async def k(self, a=(
  default()), b=[
1]) -> r(6):
        """class of
def text"""
        if p(7):
            def inner(): return q(8)
        elif p(9):
            class inner: y = z(10)
        else:
            def inner():
                w.v.u(11)

        try:
            from ..e import f
        except t(12): pass
        finally: s(13)
    class K:
    \tdef k(self): g(14); g(15)
    \tdef k(self): g(16)
    x = h(17)
    def k(self, a=default()):
        async def k(): await g(18)
        return g(19)
match f(20):
    case 1:
        def k(): h(21)
x = [f(22),
  f(23)]
class K: pass
def K(): f(24)
'''


@pytest.mark.parametrize("text", [ODD, ODD + "  x = 1\n", ODD + "else:\n    pass\n", ODD.replace("elif p(9):", "elif p(9)"), ODD + "x = (\n", ODD.replace("\n", "\r\n"), "  " + ODD, ODD + "class L:\nx = 1\n", ODD.replace("x = h(17)", "  x = h(17)")])
@pytest.mark.parametrize("size", [1, 40, 300])
def test_pieces_of_a_text_have_the_rows_of_the_whole(monkeypatch, text, size):
    whole = sorted(map(repr, python_source.python_rows("a/b.py", text)))
    monkeypatch.setattr(python_source, "PIECE_CHARS", size)
    assert sorted(map(repr, python_source.python_rows("a/b.py", text))) == whole


def test_a_text_is_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(python_source, "PIECE_CHARS", 40)
    of = python_source._Pieces(ODD)
    inside = [p for p in of.top if p.body]
    assert [p.first for p in inside] == [3]
    assert len(of.top) > 4 and len(inside[0].body) > 3


def _file_of(parts):
    return "class S1:\n" + "".join(f"    def p{p}(self):\n        return helper({p})\n" for p in range(parts))


def test_a_worker_does_not_hold_the_tree_of_a_long_file(spark):
    """The worker's growth, read while rows of a 1.8 MB file are made."""

    def rows_of(path, text):
        def held():
            with open("/proc/self/statm") as f:
                return int(f.read().split()[1]) * PAGE // 1_000_000

        list(python_source.python_rows(path, _file_of(1000)))
        before, most, n = held(), 0, 0
        for n, _ in enumerate(python_source.python_rows(path, text), 1):
            if n % 1000 == 1:
                most = max(most, held())
        yield ("node", "module", path, 1, n, None, most - before, None)

    files = spark.createDataFrame([("a.py",)], "file_path string").coalesce(1)
    files = files.selectExpr("file_path", "concat('class S1:\n', array_join(transform(sequence(0, 35999), p -> concat('    def p', p, '(self):\n        return helper(', p, ')\n')), '')) as text")
    got = python_source.parse(files, rows_of).first()
    assert got.end_line == 2 + 2 * 36_000
    assert got.ordinal < 120


def test_rows_of_a_file_beyond_2_mb(spark, tmp_path):
    """One supplier of 40,000 parts: its file has 2.1 MB, and its rows are those of the SQL."""
    spark.range(40_000).selectExpr("9L as l_suppkey", "id + 100000 as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    q = __spark_entry__.queries()
    assert q["I6_call_targets"](spark, str(tmp_path)).filter("target = 'helper' and caller rlike '^mod9[.]S9[.]p1[0-9]{5}$'").distinct().count() == 40_000
    assert {r.node_type: r["count"] for r in q["I3_parsed_nodes"](spark, str(tmp_path)).distinct().groupBy("node_type").count().collect()} == {"module": 1, "classifier": 1, "callable": 40_000}
    assert q["I2_parse_errors"](spark, str(tmp_path)).count() == 0


def test_imports_of_a_file_beyond_2_mb(spark, tmp_path):
    spark.range(40_000).selectExpr("8L as l_suppkey", "id + 100000 as l_partkey").union(spark.sql("select 9L, 1L")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()["I5_internal_imports"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("mod8", "mod9")]


def test_a_worker_is_handed_few_bytes_at_once(spark):
    """40 files of 1 MB don't come to a worker in one batch, which both sides would hold."""
    files = spark.range(40).coalesce(1).selectExpr("cast(id as string) file_path", "repeat('x', 1000000) as text")
    rows = python_source.parse(files, lambda path, text: iter([("node", "module", path, 1, 1, None, None, None)]))
    assert rows.count() == 40
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == python_source.BATCH_BYTES
    sizes = files.mapInArrow(lambda batches: (b.slice(0, 1).select([0]).set_column(0, "file_path", __import__("pyarrow").array([str(b.num_rows)])) for b in batches), "file_path string")
    assert max(int(r[0]) for r in sizes.collect()) <= 10


#: Kinds and node types that leave the worker.
LEAVE = {"I3_parsed_nodes": {("node", "module"), ("node", "classifier"), ("node", "callable")}, "I5_internal_imports": {("node", "module"), ("import", "module")}}


@pytest.mark.parametrize("name", LEAVE)
def test_rows_that_a_query_does_not_read_stay_in_the_worker(spark, tmp_path, monkeypatch, name):
    frames, parse = [], python_source.parse
    monkeypatch.setattr(python_source, "parse", lambda *a, **b: frames.append(parse(*a, **b)) or frames[-1])
    spark.createDataFrame([(s, p) for s in (9, 10, 11) for p in (1, 2, 2)], "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    __spark_entry__.queries()[name](spark, str(tmp_path))
    assert {(r.kind, r.node_type) for r in frames[0].collect()} == LEAVE[name]
