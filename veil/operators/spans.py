"""Span algebra on arrays of entities: resolve, expand, apply, and relational checks.

The array forms work inside a document's row, without a shuffle.  The folds copy arrays of
a document's spans and look up strings in them, which is quadratic but cheap a span; lambdas
run over groups of spans that overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.functions.lexicon import MIN_LEAK_LENGTH
from veil.functions.text import SPAN, cut_out, first_places, let, overlaps, quoted, spans

from .rules import ENTITY

ENTITIES = f"array<{ENTITY}>"


def keep_free(ordered: Column, chosen: Column) -> Column:
    """chosen plus those of ordered, in turn, that overlap nothing chosen before."""
    return F.aggregate(ordered, chosen, lambda acc, x: F.when(F.exists(acc, lambda p: overlaps(p, x)), acc).otherwise(F.concat(acc, F.array(x))))


def greedy(entities: Column) -> Column:
    """Disjoint entities of a group: longest first, then priority, place and source; ordered by place."""
    ranked = F.transform(entities, lambda e: F.struct((e["start"] - e["end"]).alias("length"), (-e["priority"]).alias("rank"), e["start"].alias("at"), e["source"].alias("source"), e.alias("e")))
    return let(F.transform(F.array_sort(ranked), lambda r: r["e"]), lambda ordered: F.array_sort(keep_free(ordered, F.slice(ordered, 1, 0))))


def groups(ordered: Column) -> Column:
    """Entities in order of place as arrays; those of one array overlap in a chain, those of two do not."""
    cuts = F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("end"), F.lit(1).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda acc, e: F.struct(F.greatest(acc["end"], e["end"]).alias("end"), (acc["n"] + 1).alias("n"), F.when((acc["n"] == 1) | (e["start"] >= acc["end"]), F.array_append(acc["at"], acc["n"])).otherwise(acc["at"]).alias("at")),
        lambda acc: F.array_append(acc["at"], acc["n"]),
    )
    return let(cuts, lambda c: F.transform(F.slice(c, 1, F.size(c) - 1), lambda at, i: F.slice(ordered, at, F.get(c, i + 1) - at)))


def resolve(entities: Column) -> Column:
    """Disjoint entities: longest first, then priority, place and source; ordered by place.

    A choice depends only on entities that overlap in a chain, so each such group is chosen from on its own.
    """
    chosen = lambda es: F.flatten(F.transform(groups(es), lambda g: F.when(F.size(g) == 1, g).otherwise(greedy(g))))
    return let(F.array_sort(entities), chosen)


def occurrence_pattern(value: Column) -> Column:
    """A pattern of value with any white space but line ends between its words."""
    words = F.filter(F.split(value, r"(?U)\s+"), lambda w: w != "")
    return F.concat(F.lit("(?U)"), F.array_join(F.transform(words, quoted), r"[^\S\n]+"))


def expand(text: Column, entities: Column, min_length: int = MIN_LEAK_LENGTH, blocks: Column | None = None) -> Column:
    """entities plus every free occurrence of their values, the longest values first.

    With blocks, an array of (start, end), an occurrence must lie inside one.
    """
    long = F.filter(entities, lambda e: F.length(e["text"]) >= min_length)
    firsts = first_places(F.array_sort(long), lambda e: e["text"])
    ranked = F.array_sort(F.transform(firsts, lambda e: F.struct((-F.length(e["text"])).alias("length"), e["text"].alias("text"), e.alias("e"))))

    def more(acc: Column, r: Column) -> Column:
        # the value itself stands in the text, so one place is its own or overlaps it; what starts where a chosen one starts overlaps it
        places = let(occurrence_pattern(r["e"]["text"]), lambda p: F.when(F.regexp_count(text, p) > 1, spans(text, p)).otherwise(F.array().cast(SPAN)))
        found = F.filter(places, lambda s: ~F.array_contains(acc["start"], s["start"]))
        if blocks is not None:
            found = F.filter(found, lambda s: F.exists(blocks, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])))
        new = F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), r["e"]["source"].alias("source"), r["e"]["pii_type"].alias("pii_type"),
            s["text"].alias("text"), r["e"]["confidence"].alias("confidence"), r["e"]["priority"].alias("priority")))
        return keep_free(new.cast(ENTITIES), acc)

    return F.array_sort(F.aggregate(ranked, entities.cast(ENTITIES), more))


def apply(text: Column, assigned: Column) -> Column:
    """text with each span replaced; null if a span has no replacement.

    Every span gives the gap before it and its replacement, joined once.
    """
    ordered = F.array_sort(assigned)

    def joined(es: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(es, i - 1)["end"]).otherwise(F.lit(0))
        pieces = F.transform(es, lambda e, i: F.concat(cut_out(text, before(i), e["start"]), e["replacement"]))
        last = F.when(F.size(es) > 0, F.get(es, F.size(es) - 1)["end"]).otherwise(F.lit(0))
        return F.concat(F.array_join(pieces, ""), cut_out(text, last, F.length(text)))

    return F.when(~F.exists(assigned, lambda e: e["replacement"].isNull()), let(ordered, joined))


def counts_by_type(entities: DataFrame, *keys: str) -> DataFrame:
    return entities.groupBy(*keys, "pii_type").agg(F.count(F.lit(1)).alias("n"))


def overlap_pairs(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of spans of a document that overlap; the equality comes first, the range is a residual."""
    x, y = a.alias("a"), b.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return x.join(y, on)


def violations(spans_: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that break an invariant, with its name: shape, slice, or overlap with the next."""
    d = spans_.join(docs.select(key, F.col("text").alias("_doc")), key)
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start", "end"))
    d = d.withColumn("_next", after)
    shape = (F.length("text") == 0) | (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.length("text") != F.col("end") - F.col("start")) | ~F.col("confidence").between(0, 1)
    slice_ = cut_out(F.col("_doc"), F.col("start"), F.col("end")) != F.col("text")
    broken = F.when(shape, "shape").when(slice_, "slice").when(F.col("_next") < F.col("end"), "overlap")
    return d.withColumn("broken", broken).where("broken is not null").select(key, "pii_type", "start", "end", "broken")


def line_blocks(text: Column) -> Column:
    """The lines of a text as an array of (start, end), inside the row.

    The fold copies its array once a line, which suits texts of some ten thousand lines.
    """
    return F.aggregate(
        F.split(text, "\n", -1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"))).alias("out")),
        lambda acc: acc["out"],
    )


def blocks_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, start, end, text): the lines of each text, with offsets that count the separators.

    Offsets are folded in the row, so nothing is shuffled.
    """
    lines = F.arrays_zip(line_blocks(F.coalesce("text", F.lit(""))).alias("b"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("text"))
    d = docs.select(key, F.posexplode(lines).alias("block", "x"))
    return d.select(key, "block", "x.b.start", "x.b.end", "x.text")


def drop_cross_block(spans_: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that lie inside one block (left semi join on the document and the range)."""
    b = blocks.select(F.col(key).alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return spans_.join(b, (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")), "left_semi")


def offset_to_block(offsets: DataFrame, blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, offset, block): the last block that starts at or before the offset, null on a separator.

    An as-of join by union and one window, so a document's rows are sorted once.
    """
    marks = blocks.select(key, F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("block", "end").alias("b"))
    asked = offsets.select(key, F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(marks.schema["b"].dataType).alias("b"))
    seen = F.last("b", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    d = marks.unionByName(asked).withColumn("seen", seen).where("side = 1")
    return d.select(key, F.col("at").alias("offset"), F.when(F.col("at") <= F.col("seen.end"), F.col("seen.block")).alias("block"))
