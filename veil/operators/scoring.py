"""Scoring of predicted spans against labelled ones, per document and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.lexicon import PII_TYPES
from veil.functions.text import cut_out, strings


def fingerprint(version: Column, text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(version, F.lit("\n"), text), 256))


def truth_violations(corpora: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels whose text is not the slice, and corpora (key, text, version, fingerprint) that changed."""
    slices = truth.alias("t").join(corpora.select(key, F.col("text").alias("_doc")), key)
    bad = slices.where(cut_out(F.col("_doc"), F.col("start"), F.col("end")) != F.col("t.text")).select(key, F.lit("slice").alias("broken"))
    changed = corpora.where(fingerprint(F.col("version"), F.col("text")) != F.col("fingerprint")).select(key, F.lit("fingerprint").alias("broken"))
    return bad.unionByName(changed)


def numbered(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, items): spans of a document in order of place."""
    return spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("items"))


def match(truth: DataFrame, predicted: DataFrame, exact: bool, key: str = "doc_id") -> DataFrame:
    """(key, outcome, truth_type, predicted_type, overlap): one row per pair, miss or false alarm.

    Candidate pairs come from a join on the document, with equal ends or a range; they are
    taken greedily, the largest overlap first, equal types before others, each side once.
    """
    t, p = numbered(truth, key), numbered(predicted, key)
    flat = lambda d, n: d.select(key, F.posexplode("items").alias(f"{n}_no", n))
    a, b = flat(t, "t").alias("a"), flat(p, "p").alias("b")
    common = F.least("t.end", "p.end") - F.greatest("t.start", "p.start")
    near = (F.col("t.start") == F.col("p.start")) & (F.col("t.end") == F.col("p.end")) if exact else common > 0
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & near).select(
        F.col(f"a.{key}").alias(key), F.struct((-common).alias("o"), (F.col("t.pii_type") != F.col("p.pii_type")).alias("wrong"), "t_no", "p_no").alias("c"))
    ranked = pairs.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("cands"))
    chosen = F.aggregate("cands", F.slice("cands", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: (y["t_no"] == x["t_no"]) | (y["p_no"] == x["p_no"])), acc).otherwise(F.concat(acc, F.array(x))))
    d = t.withColumnRenamed("items", "ts").join(p.withColumnRenamed("items", "ps"), key, "full").join(ranked.select(key, chosen.alias("chosen")), key, "left")
    none = F.array().cast(ranked.select(chosen.alias("chosen")).schema["chosen"].dataType)
    d = d.withColumn("chosen", F.coalesce("chosen", none))
    row = lambda outcome, tt, pt, o: F.struct(outcome.alias("outcome"), tt.alias("truth_type"), pt.alias("predicted_type"), o.cast("int").alias("overlap"))
    null = F.lit(None).cast("string")
    hit = F.transform("chosen", lambda c: row(F.when(c["wrong"], "type_confusion").otherwise("tp"), F.get("ts", c["t_no"])["pii_type"], F.get("ps", c["p_no"])["pii_type"], -c["o"]))
    left = lambda items, no: F.filter(F.transform(F.coalesce(items, F.array().cast(t.schema["items"].dataType)), lambda x, i: F.struct(x["pii_type"].alias("pii_type"), i.alias("i"))), lambda x: ~F.exists("chosen", lambda c: c[no] == x["i"]))
    missed = F.transform(left(F.col("ts"), "t_no"), lambda x: row(F.lit("fn"), x["pii_type"], null, F.lit(0)))
    false = F.transform(left(F.col("ps"), "p_no"), lambda x: row(F.lit("fp"), null, x["pii_type"], F.lit(0)))
    return d.select(key, F.explode(F.concat(hit, missed, false)).alias("r")).select(key, "r.*")


def rates(d: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp, fn, type_confusion; null where undefined."""
    tp, wrong = F.col("tp"), F.col("type_confusion")
    d = d.withColumn("precision", F.try_divide(tp, tp + F.col("fp") + wrong)).withColumn("recall", F.try_divide(tp, tp + F.col("fn") + wrong))
    both = F.col("precision") + F.col("recall")
    return d.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).when(both == 0, 0.0))


def score(matches: DataFrame) -> DataFrame:
    """Counts and rates per type and, as type null, in total (one rollup)."""
    charged = F.coalesce("truth_type", "predicted_type")
    n = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    spark = matches.sparkSession
    d = matches.select(charged.alias("pii_type"), "outcome")
    # every type has a row, seen or not
    d = d.unionByName(spark.range(1).select(F.explode(strings(PII_TYPES)).alias("pii_type"), F.lit("none").alias("outcome")))
    d = d.rollup("pii_type").agg(n("tp"), n("fp"), n("fn"), n("type_confusion"))
    return rates(d)


def macro(scores: DataFrame) -> DataFrame:
    """Unweighted means of the rates of types that occur."""
    seen = scores.where("pii_type is not null and tp + fp + fn > 0")
    return seen.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def union_length(spans: Column) -> Column:
    """Characters inside any of an array of (start, end)."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")),
    )["n"]


def char_accuracy(docs: DataFrame, truth: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, accuracy): share of characters with the same in-span flag; 1 for empty texts.

    Spans meet in one row a document; characters that differ are twice those of both
    together, less those of each.
    """
    of = lambda d, n: d.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias(n))
    none = F.array().cast("array<struct<start:int,end:int>>")
    d = docs.select(key, F.length(F.coalesce("text", F.lit(""))).alias("length")).join(of(truth, "t"), key, "left").join(of(predicted, "p"), key, "left")
    t, p = F.coalesce("t", none), F.coalesce("p", none)
    differs = 2 * union_length(F.concat(t, p)) - union_length(t) - union_length(p)
    return d.select(key, F.when(F.col("length") == 0, 1.0).otherwise(1 - differs / F.col("length")).alias("accuracy"))


def floor_failures(scores: DataFrame, floors: DataFrame) -> DataFrame:
    """floors (suite, pii_type or null, metric, minimum) that are undefined or not reached."""
    long = scores.unpivot(["pii_type"], ["precision", "recall", "f1"], "metric", "actual")
    d = floors.alias("f").join(long.alias("s"), F.col("f.pii_type").eqNullSafe(F.col("s.pii_type")) & (F.col("f.metric") == F.col("s.metric")), "left")
    return d.where(F.col("actual").isNull() | (F.col("actual") + 1e-12 < F.col("minimum"))).select("f.*", "actual")
