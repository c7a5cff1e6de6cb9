"""Before and after: what survived, what changed too much, and how good the fakes are.

Pairs are rows of (doc_id, text, rewritten), with package text where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.text import digits_of, squeeze, strings
from veil.functions.validators import card_scheme_match, luhn_valid, ssn_valid

from .rules import Config, detect, explode_entities

# Probes, their categories, and label words.
_TITLE = r"[A-Z][a-zA-Z'’.\-]+(?:[ \t][A-Z][a-zA-Z'’.\-]+){1,4}"
PROBES = {
    "email": (r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", 0),
    "url": (r"(?:https?://|www\.)[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0),
    "ssn": (r"(?U)(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", 0),
    "card": (r"(?U)(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", 0),
    "ipv4": (r"(?U)(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])", 0),
    "phone_intl": (r"(?U)\+\d{1,3}[ \-]?\d[\d \-]{6,13}\d", 0),
    "labelled_person": (r"(?U)(?:Contact\s+Person|Compliance\s+Officer|Reported\s+by|Attn|Name)\s*:?\s*(" + _TITLE + ")", 1),
    "honorific_person": (r"(?U)(?:Mr|Mrs|Ms|Dr|Shri|Smt|Prof)\.?\s+(" + _TITLE + ")", 1),
    "legal_entity": ("(" + _TITLE + r"[ \t]+(?:Private[ \t]+Limited|Limited|Ltd\.?|LLP|Inc\.?|GmbH|Pvt\.?[ \t]*Ltd\.?))(?![A-Za-z])", 1),
}
CATEGORIES = {
    "FULL_NAME": "Names", "labelled_person": "Names", "honorific_person": "Names",
    "EMAIL": "Email addresses", "email": "Email addresses",
    "PHONE": "Phone numbers", "phone_intl": "Phone numbers",
    "COMPANY": "Company names", "legal_entity": "Company names",
    "ADDRESS": "Postal addresses",
    "SSN": "SSNs", "ssn": "SSNs",
    "CREDIT_CARD": "Card numbers", "card": "Card numbers",
    "DOB": "Dates of birth",
    "IP_ADDRESS": "IP addresses", "ipv4": "IP addresses",
    "DOMAIN": "Websites", "url": "Websites",
}
LABEL_TOKENS = ["website", "telephone", "tel", "email", "e-mail", "fax", "address", "name", "number", "registration", "contact", "person", "designation", "date"]
COMMON_WORD = r"(?U)(?<![\w.@])[A-Z][a-z]{3,}(?![\w@])"
COMMON_AT_LEAST = 12
KEEP_RATIO = 0.25


def clean_name(value: Column) -> Column:
    """The tokens of a captured name before the first label word."""
    tokens = F.filter(F.split(F.trim(value), r"(?U)\s+"), lambda t: t != "")
    label = lambda t: F.array_contains(strings(LABEL_TOKENS), F.regexp_replace(F.lower(t), r"^[.:]+|[.:]+$", ""))
    stop = F.array_position(F.transform(tokens, label), True)
    return F.array_join(F.when(stop > 0, F.slice(tokens, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(tokens), " ")


def probe_values(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, probe, value): distinct values of four characters or more."""

    def found_by(name: str, pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(group))
        return F.transform(found, lambda v: F.struct(F.lit(name).alias("probe"), v.alias("value")))

    found = [found_by(name, *probe) for name, probe in PROBES.items()]
    d = docs.select(key, F.explode_outer(F.concat(*found)).alias("x")).where("x is not null").select(key, "x.*")
    person = F.col("probe").isin("labelled_person", "honorific_person")
    d = d.withColumn("value", F.trim(F.when(person, clean_name(F.col("value"))).otherwise(F.col("value"))))
    return d.where(~person | F.contains("value", F.lit(" "))).where(F.length("value") >= 4).distinct()


def rule_found(docs: DataFrame, config: Config, key: str = "doc_id") -> DataFrame:
    """(key, pii_type, value): distinct values that the rules find."""
    return explode_entities(detect(docs, config), key).select(key, "pii_type", F.col("text").alias("value")).distinct()


def survived(values: DataFrame, pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """values with visible and buried: whether the output, or only its package, still has them."""
    cols = [key, "rewritten"] + (["package"] if "package" in pairs.columns else [])
    d = values.join(pairs.select(*cols), key)
    visible = F.contains("rewritten", F.col("value"))
    buried = F.contains("package", F.col("value")) if "package" in pairs.columns else F.lit(False)
    out = d.withColumn("visible", F.coalesce(visible, F.lit(False))).withColumn("buried", ~F.col("visible") & F.coalesce(buried, F.lit(False)))
    return out.drop(*cols[1:])


def category_score(pairs: DataFrame, config: Config, key: str = "doc_id") -> DataFrame:
    """Candidates, removed and remaining values per category, with a total as null: a union, distinct, rollup."""
    names = F.create_map(*[F.lit(x) for item in CATEGORIES.items() for x in item])
    rules = rule_found(pairs, config, key).select(key, names[F.col("pii_type")].alias("category"), "value")
    probes = probe_values(pairs, key).select(key, names[F.col("probe")].alias("category"), "value")
    d = survived(rules.unionByName(probes).distinct(), pairs, key)
    left = F.count_if(F.col("visible") | F.col("buried"))
    d = d.rollup("category").agg(F.count(F.lit(1)).alias("candidates"), left.alias("remaining"))
    d = d.withColumn("removed", F.col("candidates") - F.col("remaining"))
    return d.withColumn("pct", F.round(100 * F.col("removed") / F.col("candidates"), 1))


def capital_words(docs: DataFrame, text: str) -> DataFrame:
    d = docs.select(F.explode_outer(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(COMMON_WORD), F.lit(0))).alias("word")).where("word is not null")
    return d.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def over_rewriting(pairs: DataFrame, at_least: int = COMMON_AT_LEAST, keep: float = KEEP_RATIO) -> DataFrame:
    """(word, in_source, in_output): common capitalised words of which too few are left."""
    before = capital_words(pairs, "text").where(F.col("n") >= at_least).withColumnRenamed("n", "in_source")
    d = before.join(capital_words(pairs, "rewritten").withColumnRenamed("n", "in_output"), "word", "left")
    d = d.withColumn("in_output", F.coalesce("in_output", F.lit(0)))
    return d.where(F.col("in_output") <= F.col("in_source") * keep)


def churn(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, blocks, changed): lines that differ, where both texts have as many; else changed is null."""
    a, b = F.split(F.coalesce("text", F.lit("")), "\n", -1), F.split(F.coalesce("rewritten", F.lit("")), "\n", -1)
    differ = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] != x["b"]))
    return pairs.select(key, F.size(a).alias("blocks"), F.when(F.size(a) == F.size(b), differ).alias("changed"))


def structure(pairs: DataFrame) -> DataFrame:
    """One row: blocks, characters, tables and parts before and after, blocks that changed and their share.

    pairs are (blocks, n_tables, n_parts, text) before and the same with new_ in front; texts of
    blocks are compared where a document has as many as before.
    """
    said = lambda t, bs: F.transform(bs, lambda b: F.substring(t, b["start"] + 1, b["end"] - b["start"]))
    same = F.size("blocks") == F.size("new_blocks")
    changed = F.size(F.filter(F.arrays_zip(said(F.col("text"), F.col("blocks")).alias("a"), said(F.col("new_text"), F.col("new_blocks")).alias("b")), lambda x: x["a"] != x["b"]))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n)
    d = pairs.agg(
        total(F.size("blocks"), "blocks"), total(F.size("new_blocks"), "new_blocks"), F.count_if(~same).alias("unmatched"),
        total(F.length("text"), "chars"), total(F.length("new_text"), "new_chars"), total("n_tables", "tables"), total("new_n_tables", "new_tables"),
        total("n_parts", "parts"), total("new_n_parts", "new_parts"), total(F.when(same, changed), "changed"),
    )
    return d.withColumn("churn_pct", F.round(100 * F.col("changed") / F.greatest(F.col("blocks"), F.lit(1)), 1))


def surrogate_quality(pairs: DataFrame) -> DataFrame:
    """Distinct card numbers and SSNs of the output, and those that are not well formed."""
    values = probe_values(pairs.select("doc_id", F.col("rewritten").alias("text"))).where("probe in ('card', 'ssn')")
    d = values.select("probe", F.when(F.col("probe") == "card", digits_of(F.col("value"))).otherwise(F.col("value")).alias("v")).distinct().where("probe = 'ssn' or length(v) between 13 and 19")
    card = F.col("probe") == "card"
    return d.agg(
        F.count_if(card).alias("cards"), F.count_if(card & ~luhn_valid(F.col("v"))).alias("fail_luhn"), F.count_if(card & ~card_scheme_match(F.col("v"))).alias("bad_scheme"),
        F.count_if(~card).alias("ssns"), F.count_if(~card & ~ssn_valid(F.col("v"))).alias("bad_ssns"),
    )


def metadata(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, value): names of people left in the core properties part."""
    both = [(f, F.regexp_extract("text", rf"(?s)<{f}>(.*?)</{f}>", 1)) for f in ("dc:creator", "cp:lastModifiedBy")]
    d = parts.where("part_name = 'docProps/core.xml'").select(key, "text").select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in both])).alias("x"))
    return d.select(key, "x.*").where(squeeze(F.col("value")) != "")


def totals(pairs: DataFrame, config: Config, key: str = "doc_id", parts: DataFrame | None = None) -> DataFrame:
    """One row: leaks of the rules' view and of the probes' view, fields that name people, and whether there are none."""
    applied = survived(rule_found(pairs, config, key), pairs, key).agg(F.count_if("visible").alias("applied_leaks"))
    probes = survived(probe_values(pairs, key), pairs, key).agg(F.count_if(F.col("visible") | F.col("buried")).alias("probe_leaks"))
    d = applied.crossJoin(probes)  # one row each
    named = F.lit(0).cast("long")
    if parts is not None:
        d = d.crossJoin(metadata(parts, key).agg(F.count(F.lit(1)).alias("metadata_fields")))  # one row
        named = F.col("metadata_fields")
    return d.withColumn("metadata_fields", named).withColumn("clean", (F.col("applied_leaks") == 0) & (F.col("probe_leaks") == 0) & (F.col("metadata_fields") == 0))
