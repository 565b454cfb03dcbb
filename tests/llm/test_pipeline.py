"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import collections
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from codegrove.llm import mixing
from tests.llm.test_corpus_operators import SCHEMA, brute_components, rows, sets, words


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    data = [r[:5] for r in rows() if r[0] != 206]
    docs = spark.createDataFrame(data, columns)
    docs = docs.filter("doc_id is null or doc_id <> 204").union(docs.filter("doc_id = 204").limit(1))
    kept = [tuple(r) for r in docs.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = spark.createDataFrame(kept, columns)
        out = stage(spark, before, str(tmp_path))
        got = [tuple(r) for r in out.collect()]
        if i < 4:
            assert out.columns == before.columns, name
        if name == "language_id":
            want = [r for r in kept if any(c.isalpha() for c in r[1] or "")]
        elif name == "exact_dedup":
            best = {}
            for r in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
                best.setdefault(b" ".join(words("x" + r[1] + "x")), r)
            want = list(best.values())
        elif name == "near_dedup":
            comp = brute_components(sets(kept))
            want = [r for r in kept if r[0] is None or comp[r[0]] == r[0]]
        elif name == "mixing":
            size = collections.Counter()
            for r in kept:
                size[r[3]] += len(words(r[1]))
            names = sorted(size, key=lambda x: (x is None, x or ""))
            quota = dict(zip(names, mixing.targets([size[x] for x in names], [1, 2, 3, 1][: len(names)])))
            taken = collections.Counter()
            for r in got:
                taken[r[3]] += len(words(r[1]))
            assert set(got) <= set(kept) and max(collections.Counter(got).values()) <= 3
            for x in names:
                assert abs(taken[x] - quota[x]) <= max(len(words(r[1])) for r in kept if r[3] == x) + 1
            want = got
        else:
            t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            want = []
            for r in kept:
                ids = t.encode(r[1] or "", add_special_tokens=False).ids + [1]
                for k, a in enumerate(range(0, len(ids), 4096)):
                    part = ids[a : a + 4096]
                    want.append((r[0], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            bins = collections.Counter()
            for r in got:
                bins[r[5]] += r[3]
            assert max(bins.values()) <= 4096
            got = [r[:5] for r in got]
        assert collections.Counter(got) == collections.Counter(want), name
        kept = got


def test_stages_keep_columns_named_like_their_own(spark, tmp_path):
    """Clashing names, a very long text, null and empty texts, ties and a repeated row."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    names = ["spans", "kept", "_words", "copies", "target", "_copy_kept", "_mix_size", "_spans", "keep_id"]
    for name in names:
        docs = docs.withColumn(name, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.select(*names).distinct().collect()
        assert [tuple(r) for r in got] == [("mine",) * len(names)], name
        assert out.filter("length(text) > 100000").count() >= 1, name


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
