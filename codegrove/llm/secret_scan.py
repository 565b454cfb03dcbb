"""Secret scanning with a random forest that takes out false positives.

Candidates are all strings of a whole text that look like keys, tokens or passwords: known key formats, and
long mixed strings or assigned values. A forest trained from labelled findings judges each by its length, its
character transitions, how much of it dictionary words cover, its path and the words beside it.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, draw, most_frequent, store, words_column

#: Trees and their depth, features tried per split, candidate thresholds per feature.
TREES, DEPTH, TRIED, CUTS = 40, 9, 5, 24
#: Labelled findings the forest is fitted on at most (smallest hash of the value).
FINDING_ROWS = 50_000
#: Dictionary: the most frequent words of the corpus, of DICTIONARY_WORD letters or more, that occur DICTIONARY_COUNT times.
DICTIONARY, DICTIONARY_WORD, DICTIONARY_COUNT = 5_000, 3, 2
LIKELY = 0.5

# Formats of public key kinds.
FORMATS = [
    ("aws_access_key", re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}")),
    ("github_token", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack_token", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
]
# A part that every match of the format has.
MARKS = {"aws_access_key": ["AKIA", "ASIA"], "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "slack_token": ["xox"], "private_key": ["PRIVATE KEY"], "jwt": [".eyJ"]}
KINDS = ["assigned", "opaque"] + [n for n, _ in FORMATS]
# Words that speak for or against a secret when they stand beside one.
FOR = ["api", "apikey", "auth", "aws", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token"]
AGAINST = ["checksum", "commit", "digest", "etag", "example", "file", "hash", "id", "md5", "order", "revision", "sha", "sha1", "sha256", "url", "uuid", "version"]

# Alternatives in order: a whole private key head (a format), an assignment, or a long run.
_CANDIDATE = re.compile(
    r"(?P<head>-----BEGIN [A-Z ]*PRIVATE KEY-----)"
    r"|(?P<name>[A-Za-z_][A-Za-z_\-]{1,30})[\"']?[ ]?(?::=|=>|=|:)[ ]?[\"']?(?P<value>[A-Za-z0-9+/_.~@!#$%^&*?\-]{8,}={0,2})"
    r"|(?P<run>(?<![A-Za-z0-9])[A-Za-z0-9+/_.\-]{16,}={0,2})"
)
_DIGIT, _UPPER, _LOWER = re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")
#: Characters beside the known formats in it from which a value is a candidate of its own.
REST = 8


def formats(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of every match of a known format, wherever it stands."""
    return sorted((m.start(), m.end(), name) for name, form in FORMATS if any(x in text for x in MARKS[name]) for m in form.finditer(text))


def candidates(text: str) -> Iterator[tuple[int, str, str, str, str]]:
    """start, value, kind, text before, text after, of each candidate: all known formats, then assigned values and mixed runs."""
    known = formats(text)
    for start, end, kind in known:
        yield start, text[start:end], kind, text[max(0, start - 60) : start], text[end : end + 40]
    at = 0
    for m in _CANDIDATE.finditer(text):
        if m.group("head"):
            continue
        group = "value" if m.group("value") else "run"
        value, start, end = m.group(group), m.start(group), m.end(group)
        while at < len(known) and known[at][1] <= start:
            at += 1
        rest, upto, i = 0, start, at
        while i < len(known) and known[i][0] < end:
            rest += max(0, known[i][0] - upto)
            upto = max(upto, known[i][1])
            i += 1
        if i > at and rest + max(0, end - upto) < REST:
            continue
        if group == "run" and not _DIGIT.search(value) and not (_UPPER.search(value) and _LOWER.search(value)):
            continue
        yield start, value, "assigned" if group == "value" else "opaque", text[max(0, m.start() - 60) : start], text[end : end + 40]


# Words in parts: db_password and dbPassword are two each.
_LEFT = _RIGHT = re.compile(r"[A-Z]+(?![a-z])[0-9]*|[A-Z]?[a-z]+[0-9]*|[0-9]+")
NAMES = [
    "length", "digits", "upper", "lower", "marks", "entropy", "changes", "repeats", "pairs", "vowel_turns", "covered", "longest_word",
    "path_like", "dots", "hex", "shape_key", "before_for", "before_against", "after_against", "assigned", "quoted", "digits_only",
]


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(value: str, kind: str, before: str, after: str, path: str, words: frozenset[str]) -> list[float]:
    n = len(value)
    classes = [_class(c) for c in value]
    freq = np.bincount(np.frombuffer(value.encode("latin-1", "replace"), np.uint8), minlength=1)
    p = freq[freq > 0] / n
    low = value.lower()
    pairs = {low[i : i + 2] for i in range(n - 1)}
    covered, longest, i = 0, 0, 0
    while i < n:
        for size in range(min(12, n - i), DICTIONARY_WORD - 1, -1):
            if low[i : i + size] in words:
                covered += size
                longest = max(longest, size)
                i += size
                break
        else:
            i += 1
    left = [w.lower() for w in _LEFT.findall(before)][-3:]
    right = [w.lower() for w in _RIGHT.findall(after)][:2]
    beside = set(left)
    vowel = [c in "aeiou" for c in low]
    return [
        float(n), classes.count(0) / n, classes.count(1) / n, classes.count(2) / n, classes.count(3) / n,
        float(-(p * np.log2(p)).sum()), sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1),
        sum(a == b for a, b in zip(low, low[1:])) / max(1, n - 1), len(pairs) / max(1, n - 1),
        sum(a != b for a, b in zip(vowel, vowel[1:])) / max(1, n - 1), covered / n, float(longest),
        float(value.count("/") > 1 or bool(re.search(r"(?:test|fixture|example|sample|mock|doc)", path.lower()))), float(value.count(".")),
        float(all(c in string.hexdigits for c in value)), float(kind not in ("assigned", "opaque")),
        float(any(w in FOR for w in beside)), float(any(w in AGAINST for w in beside)), float(any(w in AGAINST for w in right)),
        float(kind == "assigned"), float(before[-1:] in "\"'" and before != ""), float(value.replace(".", "").replace("-", "").isdigit()),
    ]


@dataclass
class Tree:
    feature: list[int]
    cut: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        f, c, lo, hi, v = (np.array(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            inner = f[at] >= 0
            if not inner.any():
                break
            down = x[np.arange(len(x)), np.maximum(f[at], 0)] < c[at]
            at = np.where(inner, np.where(down, lo[at], hi[at]), at)
        return v[at]


def _gini(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    q = p / np.maximum(n, 1)
    return n * 2 * q * (1 - q)


def grow_tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Tree:
    """A tree on a bootstrap sample, with a random choice of features at each split."""
    tree = Tree([], [], [], [], [])
    pick = rng.integers(0, len(x), len(x))

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(tree.feature)
        for a, v in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, 0), (tree.right, 0), (tree.value, float(y[rows].mean()))):
            a.append(v)
        if depth == DEPTH or len(rows) < 4 or y[rows].min() == y[rows].max():
            return me
        best = (1e-9, -1, 0.0)
        base = float(_gini(np.array([y[rows].sum()]), np.array([len(rows)]))[0])
        for f in rng.choice(x.shape[1], TRIED, replace=False):
            v = x[rows, f]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS)[1:], method="higher"))
            order = np.argsort(v)
            below = np.searchsorted(v[order], cuts)
            run = np.r_[0.0, np.cumsum(y[rows][order])]
            gain = base - _gini(run[below], below) - _gini(run[-1] - run[below], len(rows) - below)
            gain[(below == 0) | (below == len(rows))] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), int(f), float(cuts[gain.argmax()]))
        if best[1] < 0:
            return me
        tree.feature[me], tree.cut[me] = best[1], best[2]
        below = x[rows, best[1]] < best[2]
        tree.left[me] = node(rows[below], depth + 1)
        tree.right[me] = node(rows[~below], depth + 1)
        return me

    node(pick, 0)
    return tree


@dataclass
class Forest:
    trees: list[Tree]
    words: frozenset[str]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not self.trees:
            return np.zeros(len(x))
        return np.mean([t.score(x) for t in self.trees], axis=0)


def fit(x: np.ndarray, y: np.ndarray, words: frozenset[str], trees: int = TREES, seed: int = 10) -> Forest:
    rng = np.random.default_rng(seed)
    return Forest([grow_tree(x, y, rng) for _ in range(trees)] if len(x) else [], words)


def synthetic_findings(n: int = 6000, seed: int = 10, words: list[str] | None = None) -> list[tuple[str, str, str, str, str, int]]:
    """Seeded labelled findings (value, kind, before, after, path, label): keys, tokens and passwords against
    hashes, identifiers, paths, dates, numbers and placeholders in their usual surroundings.
    """
    rng = random.Random(seed)
    words = words or ["alpha", "stone", "river", "count", "value", "index", "table", "report"]
    letters, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    draw = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    path = lambda: rng.choice(["src/app.py", "config/settings.yml", "main.go", "deploy/run.sh", "web", "notes.txt", ""])
    named = lambda names: f"{text(4)} {rng.choice(names)}{rng.choice([' = ', '=', ': ', chr(34) + ': '])}{rng.choice(['', chr(34), chr(39)])}"
    secret = ["token", "password", "secret", "api_key", "auth_token", "pwd", "key", "db_password", "clientSecret"]
    good = [
        lambda: ("AKIA" + draw(string.ascii_uppercase + string.digits, 16), "aws_access_key", text(5) + " ", path()),
        lambda: ("ghp_" + draw(letters, 36), "github_token", rng.choice([text(5) + " ", named(secret)]), path()),
        lambda: ("xoxb-" + draw(string.digits, 12) + "-" + draw(letters, 24), "slack_token", text(3) + " ", path()),
        lambda: ("eyJ" + draw(letters, 20) + ".eyJ" + draw(letters, 40) + "." + draw(letters + "_-", 43), "jwt", text(3) + " ", path()),
        lambda: ("-----BEGIN RSA PRIVATE KEY-----", "private_key", text(2) + "\n", path()),
        lambda: (draw(hexa, rng.choice([16, 18, 24, 32, 40, 64])), "assigned", named(secret), path()),
        lambda: (draw(letters + "+/_-", rng.randint(12, 48)), "assigned", named(secret), path()),
        lambda: (rng.choice([draw(string.ascii_lowercase, rng.randint(10, 24)), draw(string.ascii_letters, rng.randint(10, 40)), "".join(rng.choice(words) for _ in range(rng.randint(3, 5)))]), "assigned", named(secret), path()),
        lambda: (draw(letters + "@!#$%&*?", rng.randint(8, 20)), "assigned", named(secret), path()),
        lambda: (draw(letters, rng.randint(24, 48)), "opaque", f"{text(3)} {rng.choice(['bearer', 'secret', 'token', 'password'])} ", path()),
    ]
    bad = [
        lambda: (draw(hexa, rng.choice([32, 40, 64])), "opaque", f"{text(3)} {rng.choice(['commit', 'md5', 'sha1', 'sha256', 'checksum', 'revision'])} ", path()),
        lambda: (draw(hexa, 40), "assigned", named(["commit", "sha1", "checksum", "etag", "digest", "revision"]), path()),
        lambda: ("-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), "opaque", text(4) + " ", path()),
        lambda: (draw(string.digits, rng.randint(16, 20)), "opaque", text(5) + " ", path()),
        lambda: (".".join(rng.choice(words) for _ in range(4)) + str(rng.randint(0, 99)), "opaque", text(4) + " ", path()),
        lambda: ("/".join(rng.choice(words) for _ in range(4)) + "/v" + str(rng.randint(1, 9)), "opaque", text(4) + " ", path()),
        lambda: (rng.choice(words) + "".join(rng.choice(words) for _ in range(3)) + str(rng.randint(0, 999)), "opaque", text(4) + " ", path()),
        lambda: (rng.choice(["your_password_here", "changeme123", "xxxxxxxxxxxxxxxx1", "example-token-1", "password123example"]), "assigned", named(secret), path()),
        lambda: (f"{rng.choice(words)}.{rng.randint(10, 99)}", "assigned", named(["file", "name", "version", "title", "url"]), path()),
        lambda: (rng.choice([rng.choice(words), "-".join(rng.choice(words) for _ in range(3)), "".join(rng.choice(words).title() for _ in range(2))]), "assigned", named(["note", "file", "name", "title", "see", "summary", "module", rng.choice(words)]), path()),
        lambda: ("".join(rng.choice(words).title() for _ in range(rng.randint(3, 4))), "opaque", text(4) + " ", path()),
        lambda: ("//www." + rng.choice(words) + ".com/" + "/".join(rng.choice(words) for _ in range(rng.randint(0, 3))), "assigned", f"{text(4)} {rng.choice(['http:', 'https:', 'url: ', 'file:'])}", path()),
        lambda: (f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "assigned", named(["date", "order", "id", "updated"]), path()),
        lambda: (f"{rng.choice(words)}.{rng.randint(10, 99)}", "opaque", text(4) + " ", path()),
        lambda: (rng.choice(words) + "_" + rng.choice(words) + "_" + str(rng.randint(1, 9)) * rng.randint(1, 3), "opaque", text(3) + " ", "tests/fixtures/sample.py"),
    ]
    rows = []
    for i in range(n):
        label = i % 2
        value, kind, before, where = rng.choice(good if label else bad)()
        rows.append((value, kind, before, " " + text(3), where, label))
    return rows


def train(docs: DataFrame, text_col: str = "text", findings: DataFrame | None = None, rows: int = FINDING_ROWS) -> Forest:
    """The forest from labelled findings (value, kind, before, after, path, label), at most `rows` of
    them; without any given, from the seeded synthetic ones. The dictionary is counted over all documents.
    """
    word = docs.select(F.explode(words_column(F.lower(F.col(text_col)))).alias("w")).filter(F.col("w").rlike(f"^[a-z]{{{DICTIONARY_WORD},}}$"))
    counted = store(word.groupBy("w").agg(F.count("*").alias("c")).filter(F.col("c") >= DICTIONARY_COUNT), "dictionary")
    common = [r["w"] for r in most_frequent(counted, DICTIONARY).orderBy(F.desc("c"), "w").collect()]
    words = frozenset(common)
    if findings is None:
        known = synthetic_findings(words=common[:2000] or None)
    else:
        columns = ["value", "kind", "before", "after", "path", "label"]
        some = draw(findings.filter(F.col("value").isNotNull() & F.col("label").isNotNull()).select(*columns), "value", rows)
        known = [tuple(r) for r in some.select(*[F.coalesce(c, F.lit("")).alias(c) if c != "label" else F.col(c) for c in columns]).collect()]
    x = np.array([features(v, k, b, a, p, words) for v, k, b, a, p, _ in known if v], np.float64).reshape(-1, len(NAMES))
    return fit(x, np.array([r[5] for r in known if r[0]], np.float64), words)


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """A row per candidate: id, start and length (characters), kind, score, is_secret.

    Null and empty texts have none. Candidates judged false are returned with is_secret false.
    Repeated rows give repeated findings; a null id stays null. Values themselves are not returned.
    """
    model = docs.sparkSession.sparkContext.broadcast(forest)
    path = F.lit("") if path_col is None else F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), path.alias("path")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, x = [], []
            for key, text, where in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for start, value, kind, before, after in candidates(text):
                    found.append((key, start, len(value), kind))
                    x.append(features(value, kind, before, after, where, model.value.words))
            score = model.value.score(np.array(x, np.float64).reshape(-1, len(NAMES)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)] + [pa.array(score, pa.float64()), pa.array(score >= LIKELY, pa.bool_())], names=["id", "start", "length", "kind", "score", "is_secret"])

    return arrow_map(rows, run, "id long, start long, length long, kind string, score double, is_secret boolean").withColumnRenamed("id", id_col)
