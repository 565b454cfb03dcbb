"""A corpus pipeline of five operators: language ID, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame; run() writes each stage's rows to the shared folder and reads them back for the next.

All stages but the last return the columns of their input with their values, whatever the names. Null and empty texts
have no letter, so the first stage drops them; a null id sorts last where the smallest id stays, and links with nothing by
id; a null source is a source of its own. Texts of any length are read whole. Rows repeated with their id count as
copies; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrove.llm.common import fresh, small, store
from codegrove.llm.exact_dedup import exact_dedup
from codegrove.llm.langid import label_spans, learn, summarise, training_rows
from codegrove.llm.mixing import mix_sources, repeated, text_size
from codegrove.llm.ngram_join import near_duplicates
from codegrove.llm.packing import pack_documents


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found; those without a letter go. Ties between languages go by name, and all rows of an id are kept."""
    model, spans = learn(training_rows(docs)), fresh("_spans", docs.columns)
    lang, _ = summarise(F.col(spans), model.langs)
    return label_spans(docs, model, docs.columns, spans_col=spans).filter(lang != "und").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest id; of rows that repeat it as well, one."""
    made = fresh("_copy_", docs.columns)
    return exact_dedup(docs, prefix=made).filter(F.col(f"{made}kept")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    gone = store(near_duplicates(docs).filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; the choice among equals is seeded by id."""
    made = fresh("_mix_", docs.columns)
    sized = docs.withColumn(f"{made}size", text_size(F.col("text"))).withColumn(f"{made}in", F.array("source"))
    return repeated(mix_sources(sized, size_col=f"{made}size", sources_col=f"{made}in", prefix=made), F.col(f"{made}copies")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]

#: Training, hashing and evolution have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
