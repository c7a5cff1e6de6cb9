"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.store import cut, release, remove, shared_path, small

__all__ = ["ascii_lower", "cut", "name_words", "prepare", "read", "release", "remove", "row_key", "shared_path", "small"]

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

#: Bytes of an Arrow batch that goes to a Python worker; a longer row goes alone.
BATCH_BYTES = 4 << 20

#: Runs of these are words once A-Z is lowered: digits, a-z and everything outside ASCII.
NAME_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, and bound the bytes of an Arrow batch.

    The bound stays set for the session, as a plan reads it only when it runs.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*columns: str) -> Column:
    """64 bits of a row's content, the same whenever the row is read again.

    Rows without an id, and rows that share one, are told apart by their text; rows that
    are alike in all columns share a key, and every result of theirs.  Two different rows
    of n share one by chance with a probability of n * n / 2**65.
    """
    # a null is skipped by the hash, so its place is hashed too
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def name_words(text: Column) -> Column:
    """Array of the words of a text; null gives none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(NAME_WORD), F.lit(0))
