"""The engine on streams.

Detection, resolution and rewriting stay inside a row, so a streaming DataFrame goes through
the very plan of a batch, without state.  Writing is fail-closed: each micro-batch is
checked before it is handed on, and a leak stops the query at that batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veil.operators.rules import Config, detect
from veil.plans.engine import Engine
from veil.store import cut, release


def detected(stream: DataFrame, config: Config) -> DataFrame:
    """A stream with its disjoint entities, by rules alone."""
    return Engine(config).detect(stream)


def rewritten(stream: DataFrame, config: Config) -> DataFrame:
    """A stream with all that Engine.rewrite() gives."""
    return Engine(config).rewrite(stream)


def type_counts(stream: DataFrame, config: Config, at: str = "ts", window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """(window, pii_type, n) by event time; what comes later than delay is dropped."""
    d = detect(stream.withWatermark(at, delay), config).select(at, F.explode("entities").alias("e"))
    return d.groupBy(F.window(at, window).alias("window"), F.col("e.pii_type").alias("pii_type")).agg(F.count(F.lit(1)).alias("n"))


def start(stream: DataFrame, config: Config, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Rewrite a stream; sink(rows, batch) gets the checked rows of each micro-batch.

    The batch is written once, checked and handed on from there.  A batch that is run again
    after a failure has the same rows and number, so a sink that keys by these is exact.
    """
    engine = Engine(config)

    def each(batch: DataFrame, number: int) -> None:
        done = cut(engine.rewrite(batch))
        engine.verify(done)
        sink(done, number)
        release(done)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
