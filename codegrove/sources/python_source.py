"""Source files to rows: a pluggable parser layer, with Python by the standard library's syntax tree.

Each file is parsed inside a map over batches and yields its nodes, containment and import edges
and call targets together. A file that does not parse yields its module node and an error.
A long file is parsed in pieces, so that a worker never holds its whole syntax tree.
"""

from __future__ import annotations

import ast
import gc
import pickle
import tokenize
from array import array
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegrove.functions.names import structural_id

SCHEMA = "file_path string, kind string, node_type string, name string, start_line long, end_line long, target string, ordinal long, error string"
#: Files a worker is handed at once (beyond BATCH_BYTES of them Spark hands it fewer), and rows it sends on at once.
BATCH_FILES, BATCH_BYTES, BATCH_ROWS = "512", "8m", 8192
#: Longer texts are parsed in pieces of about so many characters.
PIECE_CHARS = 250_000
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)


def module_name(path: str, suffix: str = ".py") -> str:
    """Dotted name of a file; a package is its __init__ file."""
    name = path.removesuffix(suffix).strip("/").replace("/", ".")
    return name.removesuffix(".__init__")


def _tree(code: str) -> ast.Module:
    """A tree has no cycles; looking for some while it grows takes as long as parsing."""
    on = gc.isenabled()
    gc.disable()
    try:
        return ast.parse(code)
    finally:
        if on:
            gc.enable()


def _dotted(e: ast.AST) -> str | None:
    parts = []
    while isinstance(e, ast.Attribute):
        parts.append(e.attr)
        e = e.value
    if not isinstance(e, ast.Name):
        return None
    return ".".join([e.id, *reversed(parts)])


@dataclass
class _Piece:
    """Lines first to last (0-based, last excluded) of a long text: whole statements, or a definition with its body in pieces of its own."""

    first: int
    last: int
    nested: bool
    body: list[_Piece] | None = None


class _Pieces:
    """A long text cut between statements; inside a definition only where it is long itself. Raises SyntaxError where it cannot be cut."""

    def __init__(self, text: str):
        if text.startswith("\ufeff") or any(x in text for x in "\0\f\r"):
            raise SyntaxError("such lines are not counted here")
        self.lines = [x + "\n" for x in text.split("\n")]
        self.at = array("q", accumulate(map(len, self.lines), initial=0))
        #: Of each logical line: its first line, its depth, and what it begins: "d" a definition, "@" a decorator, "+" a further branch, "" anything else.
        self.rows, self.depths, self.kinds = array("q"), array("q"), []
        try:
            self._scan()
        except tokenize.TokenError as e:
            raise SyntaxError(str(e)) from e
        self.top = self._cut(0, len(self.rows), 0)

    def _scan(self) -> None:
        depth, begins, asynchronous = 0, True, False
        for kind, word, start, _, _ in tokenize.generate_tokens(iter(self.lines).__next__):
            if kind in (tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER):
                continue
            if kind in (tokenize.INDENT, tokenize.DEDENT):
                depth += 1 if kind == tokenize.INDENT else -1
            elif kind == tokenize.NEWLINE:
                begins, asynchronous = True, False
            elif begins:
                self.rows.append(start[0] - 1)
                self.depths.append(depth)
                self.kinds.append("d" if word in ("def", "class") else "@" if word == "@" else "+" if word in ("else", "elif", "except", "finally") else "")
                begins, asynchronous = False, word == "async"
            elif asynchronous:
                self.kinds[-1] = "d" if word == "def" else ""
                asynchronous = False

    def _line(self, i: int) -> int:
        return self.rows[i] if i < len(self.rows) else len(self.lines)

    def _cut(self, i: int, j: int, depth: int) -> list[_Piece]:
        """Pieces of logical lines i to j, which are a block's."""
        own = [k for k in range(i, j) if self.depths[k] == depth]
        if i < j and own[:1] != [i]:
            raise SyntaxError("unexpected indent")
        starts = [k for n, k in enumerate(own) if not n or (self.kinds[k] != "+" and self.kinds[own[n - 1]] != "@")] + [j]
        heads = {k: n for n, k in enumerate(own)}
        out: list[_Piece] = []
        for k, after in zip(starts, starts[1:]):
            first, last = self._line(k), self._line(after)
            n = heads[after] - 1 if after < j else len(own) - 1
            head = own[n]  # the unit's last line of this depth
            if self.at[last] - self.at[first] > PIECE_CHARS and self.kinds[head] == "d" and head + 1 < after:
                out.append(_Piece(first, self._line(head + 1), depth > 0, self._cut(head + 1, after, depth + 1)))
            elif out and out[-1].body is None and self.at[last] - self.at[out[-1].first] <= PIECE_CHARS:
                out[-1].last = last
            else:
                out.append(_Piece(first, last, depth > 0))
        return out

    def parsed(self, p: _Piece) -> tuple[list[ast.stmt], int]:
        """A piece's statements, and what to add to their line numbers; a definition has pass for its body. Raises SyntaxError."""
        code = "".join(self.lines[p.first : p.last])
        if p.body is not None:
            begin = self.lines[p.last]
            code += begin[: len(begin) - len(begin.lstrip())] + "pass\n"
        tree = _tree("if 1:\n" + code if p.nested else code)
        if p.nested and (len(tree.body) > 1 or tree.body[0].orelse):
            raise SyntaxError("not a block")
        body = tree.body[0].body if p.nested else tree.body
        if p.body is not None and len(body) > 1:
            raise SyntaxError("not a definition alone")
        return body, p.first - p.nested


def python_rows(path: str, text: str) -> Iterator[tuple]:
    """Rows of one file: (kind, node_type, name, start, end, target, ordinal, error); kinds node, import, base, call."""
    module = module_name(path)
    lines = max(1, text.count("\n") + (not text.endswith("\n")))
    if len(text) > PIECE_CHARS:
        try:
            kept = _packed(_Walk(module).pieces(of := _Pieces(text), of.top, module))
        except (SyntaxError, ValueError):
            pass  # the whole text says what is wrong, if anything
        else:
            yield ("node", "module", module, 1, lines, None, None, None)
            for rows in kept:
                yield from pickle.loads(rows)
            return
    try:
        tree = _tree(text)
    except (SyntaxError, ValueError) as e:
        yield ("node", "module", module, 1, lines, None, None, str(e))
        return
    yield ("node", "module", module, 1, lines, None, None, None)
    yield from _Walk(module).statements(tree, module)


def _packed(rows: Iterator[tuple]) -> list[bytes]:
    """All rows of a long text, which count only if all of it parses; packed, they take about as much as the text itself, or a few times that."""
    out = []
    while some := list(islice(rows, BATCH_ROWS)):
        out.append(pickle.dumps(some))
    return out


class _Walk:
    """Rows below a module's own; names already taken and calls counted so far, by caller."""

    def __init__(self, module: str):
        self.module = module
        self.taken: dict[str, int] = {}
        self.order: dict[str, int] = {}

    def pieces(self, of: _Pieces, pieces: list[_Piece], owner: str) -> Generator[tuple, None, int]:
        """Rows of pieces; returns the line on which the last ends."""
        end = 0
        for p in pieces:
            body, shift = of.parsed(p)
            if p.body is None:
                end = body[-1].end_lineno + shift
                yield from self.statements(ast.Module(body, []), owner, shift)
                continue
            node, name = body[0], self.named(body[0], owner)
            at = node._fields.index("body")
            yield from _inside(node, name, self.module, self.order, [], shift, node._fields[:at])
            end = yield from self.pieces(of, p.body, name)
            yield from _inside(node, name, self.module, self.order, [], shift, node._fields[at + 1 :])
            yield from self.definition(node, name, owner, node.lineno + shift, end)
        return end

    def statements(self, tree: ast.AST, owner: str, shift: int = 0) -> Iterator[tuple]:
        todo: list[tuple[ast.AST, str]] = [(tree, owner)]
        while todo:
            node, owner = todo.pop()
            name = owner
            if isinstance(node, _DEFINITIONS):
                name = self.named(node, owner)
                yield from self.definition(node, name, owner, node.lineno + shift, node.end_lineno + shift)
            inner: list[ast.AST] = []
            yield from _inside(node, name, self.module, self.order, inner, shift)
            todo += [(d, name) for d in reversed(inner)]

    def named(self, node: ast.AST, owner: str) -> str:
        name = f"{owner}.{node.name}"
        self.taken[name] = n = self.taken.get(name, 0) + 1
        return name if n == 1 else f"{name}-{n}"

    def definition(self, node: ast.AST, name: str, owner: str, start: int, end: int) -> Iterator[tuple]:
        kind = "classifier" if isinstance(node, ast.ClassDef) else "callable"
        yield ("node", kind, name, start, end, owner, None, None)
        for b in getattr(node, "bases", []):
            if _dotted(b):
                yield ("base", kind, name, start, end, _dotted(b), None, None)


def _children(node: ast.AST, fields: tuple[str, ...] | None = None) -> list[ast.AST]:
    """Child nodes, last first, without those that hold neither definitions nor calls."""
    out = []
    for f in node._fields if fields is None else fields:
        v = getattr(node, f, None)
        if isinstance(v, list):
            out += [x for x in v if isinstance(x, ast.AST) and not isinstance(x, _LEAVES)]
        elif isinstance(v, ast.AST) and not isinstance(v, _LEAVES):
            out.append(v)
    out.reverse()
    return out


def _inside(node: ast.AST, caller: str, module: str, order: dict[str, int], inner: list[ast.AST], shift: int = 0, fields: tuple[str, ...] | None = None) -> Iterator[tuple]:
    """Imports and calls of a body, those of nested definitions left out; of some fields only, where they are given.

    inner gets the definitions directly inside the body, those under branches and loops included.
    """
    todo = _children(node, fields)
    while todo:
        x = todo.pop()
        if isinstance(x, _DEFINITIONS):
            inner.append(x)
            continue
        if isinstance(x, ast.Import):
            for a in x.names:
                yield ("import", "module", module, x.lineno + shift, x.end_lineno + shift, a.name, None, None)
        elif isinstance(x, ast.ImportFrom):
            base = module.split(".")[: -x.level] if x.level else []
            yield ("import", "module", module, x.lineno + shift, x.end_lineno + shift, ".".join([*base, *([x.module] if x.module else [])]), None, None)
        elif isinstance(x, ast.Call) and (target := _dotted(x.func)):
            order[caller] = n = order.get(caller, 0) + 1
            yield ("call", "callable", caller, x.lineno + shift, x.end_lineno + shift, target, n, None)
        todo += _children(x)


def parse(files: DataFrame, rows_of: Callable[[str, str], Iterator[tuple]] = python_rows, keep: Callable[[tuple], bool] = lambda row: True) -> DataFrame:
    """files(file_path, text) to SCHEMA rows by a parser, whatever the size of a file. Null texts count as empty files.

    Only the parser's rows that keep accepts leave the worker. A worker holds the texts of one batch, the syntax tree of one file or piece, and BATCH_ROWS rows.
    """
    kinds = {"string": pa.string(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1)):
                path = path.as_py()
                for r in filter(keep, rows_of(path, text.as_py() or "")):
                    yield (path, *r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = rows(batches)
        while out := list(islice(left, BATCH_ROWS)):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema)

    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_FILES)
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return files.select("file_path", "text").mapInArrow(run, SCHEMA)


def nodes(rows: DataFrame, language: str = "python") -> DataFrame:
    r = rows.filter("kind = 'node'")
    lang = F.lit(language)
    return r.select(structural_id(F.col("node_type"), lang, F.col("name")).alias("structural_id"), "node_type", lang.alias("language"), F.col("name").alias("qualified_name"), "file_path", "start_line", "end_line")


def edges(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Containment, internal imports and inheritance from unique local base names; what names no known node is left out.

    Ends are joined and compared by kind, language and name, which their ids are made of; ids come last.
    """
    ids = known.select("qualified_name", F.struct("node_type", "language", "qualified_name").alias("node"))
    src = ids.select(F.col("qualified_name").alias("name"), F.col("node").alias("a"))
    dst = ids.select(F.col("qualified_name").alias("target"), F.col("node").alias("b"))
    inside = rows.filter("kind = 'node' and target is not null").select(F.col("target").alias("name"), F.col("name").alias("target"), F.lit("LEXICALLY_CONTAINS").alias("edge_type"))
    imports = rows.filter("kind = 'import'").select("name", "target", F.lit("IMPORTS_DECLARED").alias("edge_type"))
    named = inside.unionByName(imports).join(src, "name").join(dst, "target").select("a", "b", "edge_type")
    simple = ids.filter("node.node_type = 'classifier'").groupBy(F.substring_index("qualified_name", ".", -1).alias("simple")).agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n = 1").drop("n")
    bases = rows.filter("kind = 'base'").select("name", F.substring_index("target", ".", -1).alias("simple")).join(src, "name").join(simple, "simple").select("a", "b", F.lit("EXTENDS").alias("edge_type"))
    both = named.unionByName(bases).filter("a <> b").distinct()
    sid = lambda x: structural_id(*(F.col(f"{x}.{c}") for c in ("node_type", "language", "qualified_name")))
    return both.select(sid("a").alias("src"), sid("b").alias("dst"), "edge_type")
