"""Language spans of mixed texts by script ranges and Viterbi over per-word scores.

Learning counts hashed character n-grams of every training text per language in one pass, and which
scripts a language is written in. For a text, each word's script narrows the languages that may
have written it; the word's n-grams score those; a Viterbi pass with a fixed penalty per switch labels
the words; runs of a label are the spans. The Viterbi steps of all texts of a batch are taken together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, mix64, pack_blocks, read_blocks, sum_blocks, texts_of

#: Hash cells of n-gram counts per language.
CELLS = 1 << 16
#: Log-score a path loses when it switches language between two words.
PENALTY = 6.0
#: A language is written in a script if so large a share of its letters is.
SCRIPT_SHARE = 0.01
#: More languages than this are an error.
MAX_LANGS = 256
#: Words held at once by the Viterbi pass of a worker.
PASS_WORDS = 1_000_000

# First and last code point of the blocks of each script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x07FF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
NAMES = sorted({n for n, _, _ in SCRIPTS}) + ["other"]
_TEXT = "_text of the row"
_RUN = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> int:
    """Number of the script of a word's first letter."""
    c = ord(word[0])
    for name, lo, hi in SCRIPTS:
        if lo <= c <= hi:
            return NAMES.index(name)
    return len(NAMES) - 1


def letter_runs(text: str) -> list[str]:
    """Runs of letters of a text; other characters inside a run are left out."""
    words = _RUN.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return [x for w in words if (x := "".join(c for c in w if c.isalpha()))]


def run_places(text: str) -> list[tuple[int, int]]:
    """Start and end of each run of letter_runs."""
    return [m.span() for m in _RUN.finditer(text) if any(map(str.isalpha, m.group()))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and n-gram cells (2- and 3-grams with word ends, and the word itself) of lower-cased words."""
    marked = [f"^{w.lower()}$" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    cp = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), lengths)
    h = mix64(cp + np.uint64(1))
    who, cells = [], []
    for n in (2, 3):
        if len(cp) < n:
            continue
        g = h[: len(h) - n + 1] * np.uint64(n)
        for i in range(1, n):
            g = g * np.uint64(0x100000001B3) + h[i : len(h) - n + 1 + i]
        same = owner[: len(g)] == owner[n - 1 :]
        who.append(owner[: len(g)][same])
        cells.append(mix64(g[same]))
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(cp)) - starts[owner]
    whole = np.add.reduceat(mix64(h + mix64(place.astype(np.uint64))), starts) if len(marked) else h
    who.append(np.arange(len(marked)))
    cells.append(mix64(whole))
    return np.concatenate(who), (np.concatenate(cells) & np.uint64(CELLS - 1)).astype(np.int64)


def _count(langs: list[str]):
    width = CELLS + len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), width), np.int64)
        number = {x: i for i, x in enumerate(langs)}
        held: list[Counter] = [Counter() for _ in langs]

        def fold(i: int) -> None:
            words = [w for w in held[i] if w]
            for at in range(0, len(words), 20_000):
                some = words[at : at + 20_000]
                n = np.array([held[i][w] for w in some], np.float64)
                who, cells = grams(some)
                total[i, :CELLS] += np.bincount(cells, n[who], CELLS).astype(np.int64)
                letters = np.array([len(w) for w in some], np.float64) * n
                total[i, CELLS:] += np.bincount([script_of(w) for w in some], letters, len(NAMES)).astype(np.int64)
            held[i].clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                i = number[lang]
                held[i].update(letter_runs(text.decode()))
                if len(held[i]) > 150_000:
                    fold(i)
        for i in range(len(langs)):
            fold(i)
        blocks, parts, data = pack_blocks(total.reshape(-1), TaskContext.get().partitionId())
        yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "data"])

    return run


class Model:
    """Languages, log-probabilities of n-gram cells, and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        c = counts.reshape(len(langs), -1) if langs else np.zeros((0, CELLS + len(NAMES)))
        cells, scripts = c[:, :CELLS] + 0.2, c[:, CELLS:]
        self.log = np.log(cells / cells.sum(axis=1, keepdims=True)).astype(np.float32)
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.allowed = (share >= SCRIPT_SHARE).T  # script x language
        self.allowed[~self.allowed.any(axis=1)] = True  # no language known for it: all may be

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-posterior of each language for each word, over the languages of its script."""
        who, cells = grams(words)
        n = np.maximum(1, np.bincount(who, minlength=len(words)))
        out = np.stack([np.bincount(who, x[cells], len(words)) for x in self.log], axis=1)
        out = out / np.sqrt(n)[:, None]  # n-grams of a word overlap and are no independent evidence
        out[~self.allowed[[script_of(w) for w in words]]] = -1e4
        top = out.max(axis=1, keepdims=True)
        return (out - top - np.log(np.exp(out - top).sum(axis=1, keepdims=True))).astype(np.float32)


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts over all rows whose language is not null."""
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    width = (CELLS + len(NAMES)) * len(langs)
    blocks = sum_blocks(arrow_map(rows, _count(langs), "block int, part int, data binary"))
    return Model(langs, read_blocks(blocks, width) if langs else np.zeros(0))


def viterbi(lengths: np.ndarray, index: np.ndarray, table: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of the words of several texts: text i has lengths[i] words, whose scores are table[index]."""
    order = np.argsort(-lengths, kind="stable")
    n, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    out = np.zeros(int(lengths.sum()), np.int16)
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t words
    back: list[np.ndarray] = []
    v = table[index[start[: live[0]]]] if longest else None
    for t in range(1, longest):
        v = v[: live[t]]
        arg = v.argmax(axis=1)
        best = v[np.arange(len(v)), arg][:, None] - penalty
        jump = best > v
        back.append(np.where(jump, arg[:, None], -1).astype(np.int16) if jump.any() else None)
        v_next = np.where(jump, best, v) + table[index[start[: live[t]] + t]]
        if t + 1 == longest or live[t + 1] < live[t]:
            keep = live[t + 1] if t + 1 < longest else 0
            out[start[keep : live[t]] + t] = v_next[keep:].argmax(axis=1)
        v = v_next
    if longest:
        keep = live[1] if longest > 1 else 0
        ends = start[keep : live[0]]
        out[ends] = table[index[ends]].argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        at = start[: live[t]] + t
        cur = out[at]
        if back[t - 1] is not None:
            came = back[t - 1][np.arange(len(at)), cur]
            cur = np.where(came >= 0, came, cur)
        out[at - 1] = cur
    return out


def _spans(model, penalty: float, spans_col: str = "spans"):
    schema = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("letters", pa.int64()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known: dict[str, int] = {}
        table = np.zeros((0, len(m.langs)), np.float32)

        def label(texts: list[str], split: list[list[str]]) -> list[list[dict]]:
            nonlocal table
            if not m.langs:
                return [[] for _ in texts]
            if len(known) > 150_000:
                known.clear()
                table = table[:0]
            new = list(set().union(*split).difference(known))
            if new:
                table = np.concatenate([table] + [m.scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)])
                known.update(zip(new, range(len(known), len(known) + len(new))))
            lengths = np.array([len(x) for x in split], np.int64)
            index = np.fromiter((known[w] for x in split for w in x), np.int64, int(lengths.sum()))
            labels = viterbi(lengths, index, table, penalty)
            size = np.fromiter((len(w) for x in split for w in x), np.int64, len(index))
            sure = np.exp(table[index, labels]).astype(np.float64) * size
            out, at = [], 0
            for text, words in zip(texts, split):
                n = len(words)
                mine = labels[at : at + n]
                edges = np.r_[0, np.flatnonzero(mine[1:] != mine[:-1]) + 1] if n else np.zeros(0, np.int64)
                if not n:
                    out.append([])
                    continue
                if len(edges) == 1 and (end := text.rfind(words[-1])) >= 0 and (begin := text.find(words[0])) >= 0:
                    places = [(begin, end + len(words[-1]))]
                else:
                    found = run_places(text)
                    stop = [*(edges[1:] - 1).tolist(), n - 1]
                    places = [(found[a][0], found[b][1]) for a, b in zip(edges.tolist(), stop)]
                mass = np.add.reduceat(size[at : at + n], edges)
                conf = np.add.reduceat(sure[at : at + n], edges) / np.maximum(1, mass)
                out.append([{"start": a, "end": b, "lang": m.langs[mine[e]], "letters": int(k), "confidence": float(min(1.0, c))} for (a, b), e, k, c in zip(places, edges, mass, conf)])
                at += n
            return out

        for batch in batches:
            texts = [x.decode() for x in texts_of(batch, _TEXT)]
            split = [letter_runs(x) for x in texts]
            found: list[list[dict]] = []
            at, words = 0, 0
            for i, x in enumerate(split):
                words += len(x)
                if words >= PASS_WORDS:
                    found += label(texts[at : i + 1], split[at : i + 1])
                    at, words = i + 1, 0
            found += label(texts[at:], split[at:])
            yield pa.record_batch([*batch.columns[1:], pa.array(found, schema)], names=[*batch.schema.names[1:], spans_col])

    return run


def label_spans(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", penalty: float = PENALTY, spans_col: str = "spans") -> DataFrame:
    """The columns `keep` of each row, and spans: array of (start, end: characters; lang; letters; confidence).

    A null or empty text and one without letters has no spans. Repeated rows are each returned, nulls
    of kept columns stay; an empty table gives an empty result. A column named as spans_col is replaced.
    """
    keep = [c for c in keep if c != spans_col]
    rows = docs.select(F.col(text_col).alias(_TEXT), *keep)
    kind = "array<struct<start:long,end:long,lang:string,letters:long,confidence:double>>"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{spans_col}` {kind}"])
    return arrow_map(rows, _spans(docs.sparkSession.sparkContext.broadcast(model), penalty, spans_col), schema)


def summarise(spans: Column, langs: list[str]) -> tuple[Column, Column]:
    """Language with most letters (first by name among equals; und without letters) and its share of trust, 0 to 1."""
    def of(lang: str, weigh: bool) -> Column:
        some = F.filter(spans, lambda s: s["lang"] == lang)
        return F.aggregate(some, F.lit(0.0), lambda a, s: a + s["letters"] * (s["confidence"] if weigh else F.lit(1.0)))

    total = F.aggregate(spans, F.lit(0.0), lambda a, s: a + s["letters"])
    if not langs:
        return F.lit("und"), F.lit(0.0)
    each = F.array(*[F.struct((-of(x, False)).alias("minus"), F.lit(x).alias("lang"), of(x, True).alias("sure")) for x in langs])
    best = F.array_min(each)
    none = F.size(spans) == 0
    return F.when(none, F.lit("und")).otherwise(best["lang"]), F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), best["sure"] / total))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of the contract that may teach: crc32 of the id, modulo 5, is not 0."""
    return docs.filter(crc_mod(id_col, 5) != 0)
