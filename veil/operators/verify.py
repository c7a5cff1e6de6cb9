"""Fail-closed checks of rewritten texts.  Errors name a type and a count, never a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.lexicon import MIN_LEAK_LENGTH
from veil.functions.text import cut_out

from .rules import REGISTRY, Config, Registry, detect
from .spans import apply


class LeakDetected(RuntimeError):
    """A real value survived, or a span would not change."""

    def __init__(self, pii_type: str, count: int):
        super().__init__(f"{count} of type {pii_type} survived")
        self.pii_type, self.count = pii_type, count


def masked(text: Column, assigned: Column) -> Column:
    """text with every fake blanked, the longest first."""
    fakes = F.array_distinct(F.transform(assigned, lambda e: e["replacement"]))
    ranked = F.array_sort(F.transform(fakes, lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r"))))
    return F.aggregate(ranked, text, lambda acc, x: F.when(F.length(x["r"]) > 0, F.replace(acc, x["r"], F.lpad(F.lit(""), F.length(x["r"]), F.lit("\0")))).otherwise(acc))


def leaks(docs: DataFrame, text: str = "text", rendered: str = "rewritten", assigned: str = "assigned", key: str = "doc_id", check_spans: bool = True) -> DataFrame:
    """(key, pii_type, kind): spans that do not stand or change, and values that survive in rendered."""
    a = F.col(assigned)
    d = docs.withColumn("_out", masked(F.col(rendered), a))
    if check_spans:
        d = d.withColumn("_again", masked(apply(F.col(text), a), a))
    d = d.select(key, *([text, "_again"] if check_spans else []), "_out", F.explode_outer(a).alias("e")).where("e is not null")
    long = F.length("e.text") >= MIN_LEAK_LENGTH
    kind = F.lit(None).cast("string")
    if check_spans:
        bad = (cut_out(F.col(text), F.col("e.start"), F.col("e.end")) != F.col("e.text")) | (F.col("e.replacement") == F.col("e.text"))
        kind = F.when(bad, "span").when(long & F.contains(F.col("_again"), F.col("e.text")), "expected")
    kind = F.coalesce(kind, F.when(long & F.contains(F.col("_out"), F.col("e.text")), "rendered"))
    return d.select(key, F.col("e.pii_type").alias("pii_type"), kind.alias("kind")).where("kind is not null")


def package_leaks(assigned: DataFrame, parts: DataFrame, key: str = "doc_id", column: str = "assigned") -> DataFrame:
    """(key, pii_type): values that survive in any serialised part (key, text) of the document's package."""
    corpus = parts.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("rewritten"))
    d = assigned.select(key, column).join(corpus, key)
    return leaks(d, assigned=column, key=key, check_spans=False).select(key, "pii_type")


def rule_values(docs: DataFrame, config: Config, key: str = "doc_id", text: str = "text", registry: Registry = REGISTRY) -> DataFrame:
    """(key, value, pii_type): distinct values that rules find, under the first type in rule order."""
    d = detect(docs.select(key, F.col(text).alias("text")), config, registry)
    d = d.select(key, F.explode_outer("entities").alias("e")).where("e is not null").where(F.length("e.text") >= MIN_LEAK_LENGTH)
    return d.groupBy(key, F.col("e.text").alias("value")).agg(F.min_by("e.pii_type", F.struct(-F.col("e.priority"), F.col("e.source"))).alias("pii_type"))


def rule_recall(docs: DataFrame, config: Config, key: str = "doc_id", before: str = "text", after: str = "rewritten") -> DataFrame:
    """Values that rules find before and still find after (left semi join on document and value)."""
    return rule_values(docs, config, key, before).join(rule_values(docs, config, key, after).select(key, "value"), [key, "value"], "left_semi")


def worst(found: DataFrame) -> tuple[str, int] | None:
    """The most frequent type of a table of leaks, and its count."""
    top = found.groupBy("pii_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pii_type").limit(1).collect()
    return (top[0][0], top[0][1]) if top else None


def assert_clean(docs: DataFrame, config: Config, key: str = "doc_id") -> None:
    for found in (leaks(docs, key=key), rule_recall(docs, config, key)):
        if bad := worst(found):
            raise LeakDetected(*bad)
