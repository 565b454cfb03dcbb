"""Scalar functions on qualified names, paths and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def structural_id(node_type: Column, language: Column, name: Column) -> Column:
    return F.sha1(F.concat_ws(":", node_type, language, name).cast("binary"))


def edge_key(src: Column, dst: Column, kind: Column) -> Column:
    return F.sha1(F.concat_ws(":", src, dst, kind).cast("binary"))


def terminal(name: Column) -> Column:
    """Text after the last dot."""
    return F.substring_index(name, ".", -1)


def qualifier(name: Column) -> Column:
    """Text before the last dot; empty without a dot."""
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)


def depth(name: Column) -> Column:
    return F.size(F.split(name, r"\.")).cast("long")


def ancestors(name: Column) -> Column:
    """Enclosing names, nearest first; none for a top-level name."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))


def prefixes(name: Column) -> Column:
    """The name itself and its ancestors, longest first."""
    return F.concat(F.array(name), ancestors(name))


def within(name: Column, module: Column | str) -> Column:
    """The module itself or anything below it; dots count, wildcards do not."""
    m = F.lit(module) if isinstance(module, str) else module
    return (name == m) | name.startswith(F.concat(m, F.lit(".")))


def match_score(query: str, sid: Column, name: Column) -> Column:
    """How well a name answers a query: exact id or name, then terminal, prefix, terminal prefix, anything containing it."""
    q, low = query.lower(), F.lower(name)
    return (
        F.when((sid == q) | (low == q), 1.0).when(terminal(low) == q, 0.9).when(low.endswith("." + q), 0.8)
        .when(low.startswith(q), 0.75).when(low.contains(q), 0.6).otherwise(0.5)
    )


def tests_bucket(path: Column) -> Column:
    return F.when(F.exists(F.split(path, "/"), lambda s: s.isin("test", "tests")), "tests").otherwise("non_tests")


def directory_bucket(path: Column) -> Column:
    """First two segments of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")


def normalised_callee(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("?."), F.lit(".")), F.lit("!."), F.lit(".")), F.lit("::"), F.lit("."))


def coverage(part: Column, whole: Column) -> Column:
    """Ratio to four places, 1.0 of nothing."""
    return F.when(whole <= 0, F.lit(1.0)).otherwise(F.bround(part / whole, 4))


# Last parts of constructor names; path segments of fixtures and generated files; roots of receivers.
CONSTRUCTORS = ["__new__", "__init__", "new", "constructor"]
FIXTURE_SEGMENTS = ["__fixtures__", "fixture", "fixtures", "_expected", "expected", "generated", "__generated__", "snapshots", "__snapshots__"]
RECEIVERS = ["self", "cls", "this", "super"]


def segments(name: Column) -> Column:
    """Parts between dots that are not empty."""
    return F.filter(F.split(name, r"\."), lambda p: p != "")


def proxy_parts(name: Column) -> Column:
    """Parts of a name without `index` and `module.exports` where they are not its end."""
    plain = F.regexp_replace(F.array_join(segments(name), "."), r"(?<![^.])(?:module\.exports|index)\.(?=.)", "")
    return segments(plain)


def is_constructor_of(name: Column, identifier: Column) -> Column:
    """The name is the identifier and one constructor part after it."""
    return (qualifier(name) == identifier) & terminal(name).isin(CONSTRUCTORS)


def same_proxy(name: Column, identifier: Column) -> Column:
    return (F.length(name) > 0) & (F.length(identifier) > 0) & (proxy_parts(name) == proxy_parts(identifier))


def carried(name: Column, identifier: Column, module: Column) -> Column:
    """The name has one part between its module and its end that the identifier leaves out."""
    i, n, m = proxy_parts(identifier), proxy_parts(name), proxy_parts(module)
    size = F.size(i)
    shape = (size >= 2) & (F.size(n) == size + 1) & (F.size(m) == size - 1)
    return shape & (F.slice(i, F.lit(1), size - 1) == m) & (F.slice(n, F.lit(1), F.greatest(size - 1, F.lit(0))) == m) & (F.element_at(n, -1) == F.element_at(i, -1))


def same_tail(name: Column, identifier: Column) -> Column:
    """The last three parts agree, where both have three."""
    a, b = segments(name), segments(identifier)
    return (F.size(a) >= 3) & (F.size(b) >= 3) & (F.slice(a, -3, 3) == F.slice(b, -3, 3))


def repeated_variants(name: Column) -> Column:
    """The name with one of two equal neighbours among its module parts taken out, for each such pair, without repeats."""
    parts = segments(qualifier(name))
    n = F.size(parts)
    places = F.when(n >= 2, F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(parts, i - 1) == F.get(parts, i))).otherwise(F.array().cast("array<int>"))
    cut = lambda i: F.concat(F.slice(parts, F.lit(1), i - 1), F.slice(parts, i + 1, n))
    return F.array_distinct(F.transform(places, lambda i: F.concat_ws(".", cut(i), terminal(name))))


def repeats_segment(name: Column) -> Column:
    """Equal neighbours, an end equal to the part two before it, or its last two parts equal to the two before them."""
    p = segments(name)
    n = F.size(p)
    pairs = F.exists(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.get(p, i) == F.get(p, i + 1))
    hop = F.coalesce(F.get(p, n - 1) == F.get(p, n - 3), F.lit(False))
    two = hop & F.coalesce(F.get(p, n - 2) == F.get(p, n - 4), F.lit(False))
    return (n >= 2) & (F.coalesce(pairs, F.lit(False)) | ((n >= 3) & hop) | ((n >= 4) & two))


def collapsed_index(module: Column) -> Column:
    return F.regexp_replace(F.replace(module, F.lit(".index."), F.lit(".")), r"\.index$", "")


def module_of_path(path: Column, prefix: str = "") -> Column:
    """Module name of a path: no suffix, a package for its __init__, dots for slashes, below the prefix."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    package = F.regexp_replace(bare, r"/__init__$", "")
    name = F.replace(package, F.lit("/"), F.lit("."))
    if not prefix:
        return name
    return F.when(within(name, prefix), name).otherwise(F.when(name == "", F.lit(prefix)).otherwise(F.concat(F.lit(f"{prefix}."), name)))


def callee_kind(text: Column) -> Column:
    """unqualified, receiver (self, cls, this, super) or member, by the first part before the last dot."""
    first = F.get(segments(qualifier(F.trim(text))), F.lit(0))
    return F.when(first.isNull(), "unqualified").when(first.isin(RECEIVERS), "receiver").otherwise("member")


def signature(name: Column, parameters: Column) -> Column:
    return F.concat(terminal(name), F.lit("("), F.array_join(parameters, ", "), F.lit(")"))


def hints(csv: Column) -> Column:
    """Parts of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def fixture_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "/"), F.array(*map(F.lit, FIXTURE_SEGMENTS)))
