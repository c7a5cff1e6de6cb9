"""Word n-grams of whole texts matched against a table of known n-grams, JVM-side.

One generated row per word position goes through a hash lookup in the same codegen stage;
only hits, and one row per document, leave it.  A place carries the row's key, its position
and the gram's hash and never the text: where the known table is too large to broadcast,
places meet it by a shuffle of some 40 bytes a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import name_words, row_key, small

#: Bytes of a row of a known table, with what a hash table adds.
ROW_BYTES = 150


def gram_hash(width: int, words: list[Column]) -> Column:
    """Hash of a gram; the width goes in, so short grams never meet the tails of long ones."""
    return F.xxhash64(F.lit(width), *words)


def gram_of(words: Column, at: Column, width: int) -> Column:
    return gram_hash(width, [F.get(words, at + j) for j in range(width)])


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text) of docs; row is the key of the row's content."""
    return docs.select(row_key("doc_id", "text").alias("row"), "doc_id", "text")


def places(rows: DataFrame, widths: list[int], known: DataFrame, known_rows: int) -> DataFrame:
    """Places of known grams in rows (row, doc_id, text).

    (row, doc_id, n_words, first, pos, and the columns of known): a row for each place and
    known gram there, and one with `first` for every row of the table, which may be a place
    too.  known has a column gram, null where there is none.
    """
    d = rows.select("row", "doc_id", name_words(F.col("text")).alias("words"))
    d = d.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words", F.posexplode_outer("words").alias("pos", "_word"))
    each = [gram_of(F.col("words"), F.col("pos"), w) for w in widths]
    start = F.coalesce("pos", F.lit(0)) == 0
    if len(each) == 1:
        d = d.select("row", "doc_id", "n_words", "pos", start.alias("first"), each[0].alias("gram"))
    else:
        d = d.select("row", "doc_id", "n_words", "pos", F.posexplode(F.array(*each)).alias("_no", "gram"))
        d = d.select("row", "doc_id", "n_words", "pos", (start & (F.col("_no") == 0)).alias("first"), "gram")
    d = d.join(small(known.withColumn("known", F.lit(True)), ROW_BYTES, known_rows), "gram", "left")
    d = d.where(F.col("known") | F.col("first"))
    return d.withColumn("gram", F.when(F.col("known"), F.col("gram"))).drop("known")
