"""Benchmark decontamination by a prefix-filtered set join (native).

An item's windows are sets of word shingles.  A window occurs only where all its shingles
do, so for containment the necessary prefix is its rarest shingle.  One pass over the texts
finds the places of all item shingles; they are written, and give both the shingles' counts
over all documents and, joined with the prefix shingles alone, the candidates.  Windows with
a shingle that no document has are dropped before that join.  A candidate's start must
leave room for the window on both sides (length and positional bounds); then the few
candidates join their texts and the words themselves are compared.

Defined results: every row gets a row, rows that share an id or have none are judged by
their own text; null and empty texts have no words; an item without words has no window;
repeated items count once; an item whose id is null still marks words but is not listed; an
empty benchmark leaves all documents clean; a tie of equally rare shingles goes to the first
in the window; other columns are ignored; a very long text costs a row per word, and its hits
meet in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.text import let

from .common import cut, name_words, small
from .grams import ROW_BYTES, gram_of, keyed, places

WINDOW = 10
SHINGLE = 3
#: Bytes of a document with candidates and of each candidate, with what a hash table adds.
CANDIDATE_BYTES = 64


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window, width): each window of `size` words, or all words of a shorter item."""
    d = items.select("item_id", name_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    d = d.select("item_id", "w", F.explode(starts).alias("s"))
    cut_out = F.slice("w", F.col("s") + 1, size)
    return d.select("item_id", F.array_join(cut_out, " ").alias("window"), F.size(cut_out).alias("width")).distinct()


def shingles(wins: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(window, width, gram_width, offset, gram) of distinct windows."""
    d = wins.select("window", "width").distinct().withColumn("w", F.split("window", " ")).withColumn("gram_width", F.least("width", F.lit(size)))
    d = d.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("width") - F.col("gram_width"))))
    gram = F.lit(None).cast("long")
    for n in range(size, 0, -1):
        gram = F.when(F.col("gram_width") == n, gram_of(F.col("w"), F.col("offset"), n)).otherwise(gram)
    return d.select("window", "width", "gram_width", "offset", gram.alias("gram"))


def prefixes(grams: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rarest shingle of each window that can occur: (window, width, offset, gram)."""
    # count and offset as one number, so that the least is found by a hash aggregate
    rank = F.coalesce("n", F.lit(0)) * (size + 1) + F.col("offset")
    d = grams.join(counts, "gram", "left").withColumn("rank", rank)
    least = d.groupBy("window").agg(F.min("rank").alias("rank")).where(F.col("rank") >= size + 1)
    return d.join(least, ["window", "rank"], "left_semi").select("window", "width", "offset", "gram")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: row, doc_id, n_words, spans of hit words, n_hit, and the items found."""
    wins = cut(windows(items, window))
    grams = cut(shingles(wins, shingle))
    widths = sorted(r[0] for r in grams.select("gram_width").distinct().collect()) or [shingle]  # at most `shingle` of them
    wanted = cut(grams.select("gram").distinct())
    rows = keyed(docs)
    found = cut(places(rows, widths, wanted, wanted.count()), wanted)
    counts = found.where("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    first = cut(prefixes(grams, counts, window), grams)
    start = F.col("pos") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("width") <= F.col("n_words"))
    near = found.where("gram is not null").select("row", "n_words", "pos", "gram").join(first, "gram").where(bounds)
    near = cut(near.groupBy("row").agg(F.collect_set(F.struct(start.alias("start"), (start + F.col("width")).alias("end"))).alias("near")))
    n, places_ = near.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("near")), F.lit(0))).first()
    # the words that stand there, cut once a text, are a window or not; rows that are alike share a key
    d = rows.join(small(near, 1, CANDIDATE_BYTES * (n + places_)), "row")
    there = lambda w: F.transform("near", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.array_join(F.slice(w, c["start"] + 1, c["end"] - c["start"]), " ").alias("window")))
    d = d.select("row", F.explode(let(name_words(F.col("text")), there)).alias("c")).select("row", "c.*")
    hits = cut(d.join(small(first.select("window"), ROW_BYTES), "window", "left_semi").distinct(), near)
    said = hits.select("row", "window").distinct()
    items_of = said.join(wins.where("item_id is not null").select("window", "item_id"), "window")
    items_of = items_of.groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = hits.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")).join(items_of, "row", "left")
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).cast("long").alias("n")),
    )["n"]
    none = F.array().cast("array<string>")
    d = found.where("first").select("row", "doc_id", "n_words").join(hits, "row", "left")
    return d.select("row", "doc_id", "n_words", F.coalesce(covered, F.lit(0)).alias("n_hit"), "spans", F.coalesce("items", none).alias("items"))


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
