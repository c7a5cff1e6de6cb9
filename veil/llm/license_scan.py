"""License scans by diagonal voting (native).

All rolling word 3-grams of a text join, by hash, the positions of the same grams in
templates.  A copy of a template makes votes on one diagonal, position in the text less
position in the template; votes are gathered per diagonal and neighbouring diagonals (words
put in or left out) are merged.  What could stand then joins its text, and each vote's words
are compared with the template's.  A span stands if its longest chain of votes that go
forward in the text and in the template covers enough of the template's grams: a gram that
is repeated counts once.  Base phrases are short templates that must be covered wholly on
one diagonal.

Defined results: every row gets a row, rows that share an id or have none are judged by
their own text; null and empty texts have no words and no license; with no templates nothing
is found; a text may hold any number of places, all count; labels are sorted by code point;
other columns are ignored; a very long text costs a row per word, its votes for one template
meet in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veil.functions.text import let

from .common import cut, name_words, small
from .grams import ROW_BYTES, gram_of, keyed, places

GRAM = 3
#: Diagonals so near each other belong to one copy.
SLACK = 8
#: Share of a template's grams that a copy must show.
COVER = 0.5
#: Bytes of a document that may hold a span, of each run there and each vote, with what a hash table adds.
SPAN_BYTES = 100

# Phrases and labels of the base rule.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Sentences of public licence notices.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
]


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, base, text) of phrases and notices, as literals of one row."""
    rows = [(label, base, text) for text, label, base in [(t, k, True) for t, k in phrases] + [(t, k, False) for t, k in notices]]
    made = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(text).alias("text")) for n, (label, base, text) in enumerate(rows)]
    kind = "array<struct<template:int,label:string,base:boolean,text:string>>"
    return spark.range(1).select(F.inline(F.array(*made).cast(kind)))


def template_grams(table: DataFrame) -> DataFrame:
    """(gram, template, label, base, at, n_grams, said): positions of every 3-gram of every template."""
    d = table.select("template", "label", "base", name_words(F.col("text")).alias("w")).where(F.size("w") >= GRAM)
    d = d.withColumn("n_grams", F.size("w") - GRAM + 1).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - GRAM)))
    return d.select(gram_of(F.col("w"), F.col("at"), GRAM).alias("gram"), "template", "label", "base", "at", "n_grams", F.array_join(F.slice("w", F.col("at") + 1, GRAM), " ").alias("said"))


def diagonals(votes: DataFrame) -> DataFrame:
    """Votes of (row, template) by diagonal, rows that are alike once: (row, template, label, base, n_grams, diagonal, votes)."""
    vote = F.struct("pos", "at", "said")
    return votes.groupBy("row", "template", "label", "base", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set(vote).alias("votes"))


def merged(by_diagonal: DataFrame, slack: int, cover: float) -> DataFrame:
    """Runs of neighbouring diagonals that could stand; a base phrase's diagonals are runs of their own."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("base"), F.lit(True)).otherwise(F.col("diagonal") - F.lag("diagonal").over(order) > slack)
    d = by_diagonal.withColumn("opens", F.coalesce(apart, F.lit(True)).cast("int"))
    d = d.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.groupBy("row", "template", "label", "base", "n_grams", "run").agg(F.array_sort(F.flatten(F.collect_list("votes"))).alias("votes"))
    shown = F.size(F.array_distinct(F.transform("votes", lambda v: v["at"])))
    return d.where(shown >= F.when(F.col("base"), F.col("n_grams")).otherwise(cover * F.col("n_grams"))).drop("run")


def chain(votes: Column, n_grams: Column) -> Column:
    """The most votes, in order of place, whose positions in the template rise; one a place."""
    def step(acc: Column, v: Column) -> Column:
        # best[i]: the longest chain that ends at gram i in earlier places; now: with this place
        best = F.when(v["pos"] == acc["pos"], acc["best"]).otherwise(acc["now"])
        longer = 1 + F.coalesce(F.array_max(F.slice(best, F.lit(1), v["at"])), F.lit(0))
        now = F.transform(acc["now"], lambda x, i: F.when(i == v["at"], F.greatest(x, longer)).otherwise(x))
        return F.struct(best.alias("best"), now.alias("now"), v["pos"].alias("pos"))

    none = F.array_repeat(F.lit(0), n_grams)
    start = F.struct(none.alias("best"), none.alias("now"), F.lit(-1).alias("pos"))
    by_place = F.aggregate(votes, start, step, lambda acc: F.array_max(acc["now"]))
    return F.coalesce(by_place, F.lit(0))


def verified(rows: DataFrame, runs: DataFrame, cover: float) -> DataFrame:
    """(row, template, label, base, first, end, covered) of runs whose words stand in the text, in order."""
    of = cut(runs.groupBy("row").agg(F.collect_list(F.struct("template", "label", "base", "n_grams", "votes")).alias("runs")))
    size = F.size("runs") + F.aggregate("runs", F.lit(0), lambda a, r: a + F.size(r["votes"]))
    n, more = of.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    d = rows.join(small(of, 1, SPAN_BYTES * (n + more)), "row")
    stands = lambda w, v: F.array_join(F.slice(w, v["pos"] + 1, GRAM), " ") == v["said"]
    kept = lambda w: F.transform("runs", lambda r: r.withField("votes", F.filter(r["votes"], lambda v: stands(w, v))))
    d = cut(d.select("row", let(name_words(F.col("text")), kept).alias("runs"))).dropDuplicates(["row"])
    d = d.select("row", F.explode("runs").alias("r")).select("row", "r.*").where(F.size("votes") > 0)
    d = d.withColumn("covered", chain(F.col("votes"), F.col("n_grams")) / F.col("n_grams"))
    d = d.where(F.col("covered") >= F.when(F.col("base"), 1.0).otherwise(cover))
    return d.select("row", "template", "label", "base", F.get("votes", F.lit(0))["pos"].alias("first"), (F.element_at("votes", -1)["pos"] + GRAM).alias("end"), "covered")


def spans(docs: DataFrame, table: DataFrame, slack: int = SLACK, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """A row (row, doc_id, n_words) per row of docs, and verified() spans by row."""
    grams = cut(template_grams(table))
    known = cut(grams.select("gram").distinct())
    rows = keyed(docs)
    found = cut(places(rows, [GRAM], known, known.count()), known)
    votes = found.where("gram is not null").select("row", "pos", "gram").join(small(grams, ROW_BYTES), "gram")
    return found.where("first").select("row", "doc_id", "n_words"), verified(rows, merged(diagonals(votes), slack, cover), cover)


def scan(docs: DataFrame, table: DataFrame) -> DataFrame:
    """One row per row of docs: base places and labels, labels of notices, and a score."""
    every, found = spans(docs, table)
    on = lambda c: F.when(F.col("base"), F.col(c))
    found = found.groupBy("row").agg(
        F.count(on("first")).alias("n_base"),
        F.min(on("first")).cast("long").alias("first_word"),
        F.max(on("first")).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(on("label"))).alias("base_set"),
        F.array_sort(F.collect_set("label")).alias("label_set"),
        F.max("covered").alias("score"),
    )
    none = F.array().cast("array<string>")
    d = every.join(found, "row", "left")
    return d.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base_set", none), ",").alias("base_labels"),
        F.array_join(F.coalesce("label_set", none), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
