"""The corpus pipeline: raw documents to a mixed, tokenised training set.

Every stage takes the documents that its predecessor kept and returns documents, all
columns; the last returns what its token files hold.  run() writes each stage's result as
Parquet to the shared folder and reads it again, so a lost executor costs one stage at
most; what a stage wrote besides is deleted when it is done.

All stages judge a row by its own text, whether or not it has an id that others share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import decontam, langid, mixing, ngram_join, token_files
from veil.llm.common import cut, prepare, read, release, row_key, small
from veil.store import scratch, shared_dir, shared_path

#: Bytes of a broadcast key, with what a hash table adds.
KEY_BYTES = 64
#: A document's main language must have this share of its words.
LEAST_LANGUAGE = 0.4

ORACLE_SQL: str | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without a main language.

    Null and empty texts go; a text goes by its own words alone, so repeated rows and rows
    without an id are judged alike; equal shares go to the first language by code point; an
    empty table stays empty; all columns stay, of any name; a very long text is handled alone.
    """
    prepare(spark)
    out = F.coalesce(langid.held_out(F.col("doc_id"), 4, 2), F.lit(False))
    return langid.keep_identified(docs, langid.learn(docs.where(~out)), LEAST_LANGUAGE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that of the least id.

    Rows that are alike in id and text are one; null and empty texts have no shingles and all
    stay; a row without an id is kept only where its group has no id; equal ids go by a hash
    of the text; an empty table stays empty; all columns stay, of any name.
    """
    prepare(spark)
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item's window.

    Each row goes by its own text; null and empty texts stay; with an empty benchmark all
    stay; an empty table stays empty; all columns stay, of any name.
    """
    prepare(spark)
    key = ngram_join.KEY
    with scratch(spark):
        hit = cut(decontam.contamination(docs, read(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.col("row").alias(key)).distinct(), keep=True)
    return docs.withColumn(key, row_key("doc_id", "text")).join(small(hit, KEY_BYTES), key, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources reach their target shares of words.

    Each row has its own number of copies, also one without an id or with that of others;
    null and empty texts are never taken; a null source is one of its own; equal keys go by
    id, then size; an empty table stays empty; all columns stay, of any name.
    """
    prepare(spark)
    key, copies_ = ngram_join.KEY, "_veil_copies"
    keyed = docs.withColumn(key, row_key("doc_id", "text", "source"))
    with scratch(spark):
        mixed = mixing.mix_documents(keyed, read(spark, sf_dir, "labels"), row=key).where("taken > 0")
        each = mixed.groupBy(F.col("row").alias(key)).agg(F.sum((F.col("taken") / F.col("size")).cast("int")).cast("int").alias(copies_), F.count(F.lit(1)).alias("_veil_n"))
        copies = cut(each, keep=True)
    n = copies.count()
    # rows that are alike are repeated all from one of them
    once, alike = copies.where("_veil_n = 1"), copies.where("_veil_n > 1")
    d = keyed.join(small(once, KEY_BYTES, n), key).drop("_veil_n")
    if alike.count():
        d = d.unionByName(keyed.join(small(alike, KEY_BYTES, n), key).dropDuplicates([key]).drop("_veil_n"))
    return d.withColumn(copies_, F.explode(F.sequence(F.lit(1), F.col(copies_)))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files and return what they hold.

    The files stay, in a folder of their own below pipeline-tokens in the shared folder.
    Null texts are empty and get the end id alone; repeated rows are written each; rows
    without an id come first; an empty table gives no rows; other columns are not written.
    """
    prepare(spark)
    return token_files.encode_documents(spark, docs, folder=f"{shared_dir(spark).rstrip('/')}/pipeline-tokens/{uuid.uuid4().hex}")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        release(docs)
        docs = spark.read.schema(out.schema).parquet(path)
        docs._veil_path = path
    return docs
