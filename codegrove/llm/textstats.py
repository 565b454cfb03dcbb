"""Counts of whole texts that the quality operators learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, texts_of, windows

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further features, all per word, letter or line.
RATIOS = ["symbols_per_word", "bars_per_word", "marks_per_word", "stops_per_word", "digits_share", "upper_share", "capital_words", "word_length", "distinct_share", "repeat_share", "dup_line_share", "words_per_line", "frequent_share", "log_words"]

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.array([9, 10, 11, 12, 13, 32])


def repeat_words(h: np.ndarray, k: int = 5) -> int:
    """Words inside k-word windows that occur twice or more."""
    if len(h) <= k:
        return 0
    w = windows(h, k)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line; lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def measure(text: bytes, cache: WordHashes) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of one text."""
    words = text.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(hist.sum() - hist[0x80:0xC0].sum() - hist[_SPACE].sum())
    symbols = int(hist[_SYMBOLS].sum())
    h = cache.of(words)
    repeats = repeat_words(h)
    dups, lines = dup_lines(text)
    upper, lower = float(hist[65:91].sum()), float(hist[97:123].sum())
    digits = float(hist[48:58].sum())
    each = max(1, n)
    _, times = np.unique(h, return_counts=True)
    capital = text.istitle() if n == 0 else sum(map(bytes.isupper, words)) / n
    ratios = [
        symbols / each, float(hist[124]) / each, float(hist[33] + hist[63]) / each, float(hist[46] + hist[44]) / each,
        digits / max(1, chars), upper / max(1.0, upper + lower), float(capital), chars / each,
        len(times) / each, repeats / each, dups / max(1, lines), n / max(1, lines),
        float(times[times > 1].sum()) / each, float(np.log1p(n)),
    ]
    return [n, chars, symbols, dups, repeats], ratios


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        found = [measure(x, cache) for x in texts_of(batch)]
        ids = batch.column(0).cast(pa.int64())
        counts = [pa.array([c[i] for c, _ in found], pa.int64()) for i in range(len(COUNTS))]
        ratios = [pa.array([r[i] for _, r in found], pa.float64()) for i in range(len(RATIOS))]
        yield pa.record_batch([ids, *counts, *ratios], names=["_id", *COUNTS, *RATIOS])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, COUNTS (long) and RATIOS (double) of each row's whole text; null counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    schema = "_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)
    return arrow_map(rows, _run, schema)
