"""Reports as text and JSON, made on the driver from tables of a few rows.

A run report is the key that undoes a rewriting, so nothing writes one unless asked to.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions.lexicon import PII_TYPES


def run_report(done: DataFrame, version: str, seed: int) -> DataFrame:
    """One JSON string a document: version, seed, entities, mapping, counts and text."""
    whole: Column = F.struct(F.lit(version).alias("version"), F.lit(seed).alias("seed"), F.col("assigned").alias("entities"), "mapping", "counts_by_type", F.col("rewritten").alias("text"))
    keys = [c for c in ("path", "doc_id") if c in done.columns]
    return done.select(*keys, F.to_json(whole).alias("report"))


def rate(x: float | None) -> str:
    return "n/a" if x is None else f"{x:.3f}"


def evaluation_markdown(scores: DataFrame, macro: DataFrame, accuracy: DataFrame, errors: DataFrame, title: str) -> str:
    """Rates by type in the order of the types, totals, and the errors; a few rows each."""
    rows = {r["pii_type"]: r.asDict() for r in scores.collect()}  # a row a type
    lines = [f"# {title}", "", "| type | P | R | F1 | TP | FP | FN |", "| --- | --- | --- | --- | --- | --- | --- |"]
    for kind in [*PII_TYPES, None]:
        r = rows.get(kind)
        if r and (kind is None or r["tp"] + r["fp"] + r["fn"] + r["type_confusion"]):
            lines.append(f"| {kind or 'micro'} | {rate(r['precision'])} | {rate(r['recall'])} | {rate(r['f1'])} | {r['tp']} | {r['fp']} | {r['fn']} |")
    m = macro.first()
    lines.append(f"| macro | {rate(m['precision'])} | {rate(m['recall'])} | {rate(m['f1'])} | | | |")
    lines += ["", f"characters: {rate(accuracy.agg(F.avg('accuracy')).first()[0])}", ""]
    lines += [f"- {r['kind']} {r['pii_type']} {r['start']}:{r['end']} …{r['context']}…" for r in errors.orderBy("kind", "start").limit(50).collect()]
    return "\n".join(lines) + "\n"


def evaluation_json(scores: DataFrame, accuracy: DataFrame, version: str, seed: int, model: str | None) -> str:
    by_type = {r["pii_type"] or "micro": {k: r[k] for k in ("tp", "fp", "fn", "type_confusion", "precision", "recall", "f1")} for r in scores.collect()}
    return json.dumps({"version": version, "seed": seed, "use_ner": model is not None, "ner_model": model, "accuracy_token": accuracy.agg(F.avg("accuracy")).first()[0], "relaxed": by_type}, indent=1)


def audit_text(scores: DataFrame, over: DataFrame, totals: DataFrame, structure: DataFrame | None = None) -> tuple[str, int]:
    """An audit for people, and its exit code: 0 clean, 1 leaks."""
    out = []
    if structure is not None:
        s = structure.first()
        out.append(f"blocks {s['blocks']} -> {s['new_blocks']}, changed {s['changed']} ({s['churn_pct']} %), parts {s['parts']} -> {s['new_parts']}")
    for r in scores.orderBy(F.col("category").asc_nulls_last()).collect():  # ten categories
        out.append(f"{r['category'] or 'all':<20} {r['removed']:>6} of {r['candidates']:>6} removed ({r['pct']} %)")
    for r in over.orderBy(F.desc("in_source")).limit(8).collect():
        out.append(f"vanished: {r['word']} {r['in_source']} -> {r['in_output']}")
    t = totals.first()
    out.append(f"leaks of rules {t['applied_leaks']}, of probes {t['probe_leaks']}, fields {t['metadata_fields']}: {'clean' if t['clean'] else 'not clean'}")
    return "\n".join(out) + "\n", 0 if t["clean"] else 1
