"""The pipeline as one plan: detect, resolve, expand, assign, apply, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.operators import candidates, mapping, model, spans, verify
from veil.operators.rules import ENTITY, REGISTRY, Config, Registry, detect
from veil.sources import docx
from veil.store import cut


class Engine:
    """Holds a configuration and the rules it enables."""

    def __init__(self, config: Config | None = None, registry: Registry = REGISTRY):
        self.config, self.registry = config or Config(), registry

    def candidates(self, docs: DataFrame, key: str = "doc_id") -> DataFrame | None:
        """Accepted entities (key, entities) of the configured model, if there is one."""
        if not (self.config.model and self.config.use_candidates):
            return None
        raw = model.raw_spans(docs, self.config.model, key, threshold=self.config.threshold)
        return candidates.accepted(docs, cut(raw), self.config, key)

    def detect(self, docs: DataFrame, candidates: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
        """docs with disjoint entities; candidates (key, entities) of a model join by key."""
        d = detect(docs, self.config, self.registry)
        found = candidates if candidates is not None else self.candidates(docs, key)
        if found is not None and self.config.use_candidates:
            more = found.select(F.col(key).alias("_k"), F.col("entities").alias("_more"))
            none = F.array().cast(f"array<{ENTITY}>")
            d = d.join(more, F.col(key) == F.col("_k"), "left")
            d = d.withColumn("entities", F.array_sort(F.concat("entities", F.coalesce("_more", none)))).drop("_k", "_more")
        return d.withColumn("entities", spans.resolve(F.col("entities")))

    def rewrite(self, docs: DataFrame, candidates: DataFrame | None = None, key: str = "doc_id", by_line: bool = False, blocks: str | None = None) -> DataFrame:
        """docs with assigned entities, mapping, status, counts_by_type and rewritten.

        by_line, or a column of blocks (arrays of start and end), drops entities across
        blocks and keeps repeats inside them, as documents of paragraphs need.
        """
        text = F.coalesce(F.col("text"), F.lit(""))
        d = self.detect(docs, candidates, key)
        inside = None
        if by_line or blocks:
            d = d.withColumn("_blocks", F.col(blocks) if blocks else spans.line_blocks(text))
            inside = F.col("_blocks")
            d = d.withColumn("entities", F.filter("entities", lambda e: F.exists(inside, lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"]))))
        d = d.withColumn("entities", spans.expand(text, F.col("entities"), blocks=inside))
        if inside is not None:
            d = d.drop("_blocks")
        d = mapping.assign(d, self.config, key)
        kinds = F.array_sort(F.array_distinct(F.transform("assigned", lambda e: e["pii_type"])))
        counts = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter("assigned", lambda e: e["pii_type"] == k)))))
        d = d.withColumn("counts_by_type", counts)
        return d.withColumn("rewritten", F.when(F.col("text").isNotNull(), spans.apply(text, F.col("assigned"))))

    def rewrite_packages(self, packages: DataFrame, candidates: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
        """packages (key, content) with all that rewrite() gives, and saved: the new package.

        error tells why a package could not be read or written; then saved is null.
        """
        d = cut(self.rewrite(docx.opened(packages, key), candidates, key, blocks="blocks"))
        new = docx.saved(d.where("error is null and status is null"), key).select(F.col(key).alias("_k"), F.col("content").alias("saved"), F.col("error").alias("_error"))
        d = d.join(new, F.col(key).eqNullSafe(F.col("_k")), "left")
        return d.withColumn("error", F.coalesce("error", "status", "_error")).drop("_k", "_error")

    def verify(self, done: DataFrame, key: str = "doc_id") -> None:
        """Raise LeakDetected if a real value survived, or ValueError if a row has no result.

        Nothing if the check is off.  done has a column saved where packages were written;
        their parts are searched too.
        """
        if not self.config.verify_output:
            return
        # written once: a filter on what the plan computes would compute it again
        done = cut(done.select(*[c for c in (key, "text", "rewritten", "assigned", "status", "saved") if c in done.columns]))
        if "status" in done.columns and (bad := done.where("status is not null").select("status").first()):
            raise ValueError(bad[0])
        verify.assert_clean(done, self.config, key)
        if "saved" in done.columns:
            parts = docx.part_rows(done.where("saved is not null"), key, "saved")
            if bad := verify.worst(verify.package_leaks(done, parts, key)):
                raise verify.LeakDetected(*bad)
