"""Quality runs: predict over labelled corpora, score, compare configurations, hold floors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.functions.context import snippet
from veil.operators import scoring
from veil.operators.model import ModelUnavailable
from veil.operators.rules import Config, explode_entities
from veil.sources import corpora as C
from veil.store import cut

from .engine import Engine

KEY = "source_document"


def predict(corpora: DataFrame, config: Config) -> DataFrame:
    """(source_document, start, end, pii_type, text): detected and resolved, not expanded."""
    return explode_entities(Engine(config).detect(corpora.select(KEY, "text"), key=KEY), KEY).select(KEY, "start", "end", "pii_type", "text")


def evaluate(corpora: DataFrame, config: Config, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rates by type and in total, rates by characters, and the errors with their surroundings.

    Labels that do not fit their text, or a text that changed, raise.
    """
    t = C.truth(corpora, KEY)
    marked = corpora.withColumnsRenamed({"extraction_version": "version", "extraction_fingerprint": "fingerprint"})
    if bad := scoring.truth_violations(marked, t, KEY).first():
        raise ValueError(f"labels do not fit {bad[KEY]}: {bad['broken']}")
    p = cut(predict(corpora, config))
    found = cut(scoring.match(t, p, exact, KEY))
    accuracy = scoring.char_accuracy(corpora.select(KEY, "text"), t, p, KEY)
    return scoring.score(found), accuracy, errors(corpora, t, p)


def errors(corpora: DataFrame, t: DataFrame, p: DataFrame) -> DataFrame:
    """Labels that no prediction meets, and predictions that meet none, on one line each."""
    meets = (F.col(f"a.{KEY}") == F.col(f"b.{KEY}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    alone = lambda x, y, kind: x.alias("a").join(y.alias("b"), meets, "left_anti").select(KEY, F.lit(kind).alias("kind"), "pii_type", "start", "end")
    both = alone(t, p, "fn").unionByName(alone(p, t, "fp"))
    return both.join(corpora.select(KEY, "text"), KEY).select(KEY, "kind", "pii_type", "start", "end", snippet(F.col("text"), F.col("start"), F.col("end")).alias("context"))


def compare(corpora: DataFrame, config: Config, models: Sequence[str]) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1, error): rules alone, then each model without and with agreement."""
    runs = [("rules-only", replace(config, model=None))]
    for m in models:
        runs += [(m, replace(config, model=m)), (f"{m}+agreement", replace(config, model=m, agreement=True))]
    out = None
    for label, c in runs:
        try:
            d = evaluate(corpora, c)[0].where("pii_type is null").select(F.lit(label).alias("label"), "tp", "fp", "fn", "precision", "recall", "f1", F.lit(None).cast("string").alias("error"))
        except ModelUnavailable as e:
            d = corpora.sparkSession.range(1).select(F.lit(label).alias("label"), *[F.lit(None).cast(t).alias(n) for n, t in (("tp", "long"), ("fp", "long"), ("fn", "long"), ("precision", "double"), ("recall", "double"), ("f1", "double"))], F.lit(str(e)).alias("error"))
        out = d if out is None else out.unionByName(d)
    return out


def held(corpora: DataFrame, floors: DataFrame, config: Config, suites: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """Floors that are not reached; suites are (suite, name of the corpus, model or None)."""
    out = None
    for suite, name, model in suites:
        scores, _, _ = evaluate(corpora.where(F.col(KEY) == f"synthetic://{name}"), replace(config, model=model))
        d = scoring.floor_failures(scores, floors.where(F.col("suite") == suite))
        out = d if out is None else out.unionByName(d)
    return out
