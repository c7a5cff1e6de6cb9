"""Registration of queries with their SQL, and tables that both sides write from keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        if (name or f.__name__) in QUERIES:
            raise ValueError(f"registered twice: {name or f.__name__}")
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over tasks by key.

    For keys that become whole texts: a file of few bytes is read by one task, or by one for each of its row groups.
    """
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def literal(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


#: Stands for the key, in six digits, inside a case's strings.
MARK = "{n}"


def cases(spark: SparkSession, sf_dir: str, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """(doc_id, names): a customer's key chooses one of the rows, and stands for MARK in its strings."""
    key = F.col("c_custkey")
    number = F.lpad(key.cast("string"), 6, "0")
    kinds = [next((type(r[i]) for r in rows if r[i] is not None), str) for i in range(len(names))]
    sql = {str: "string", int: "long", bool: "boolean", float: "double"}

    def pick(i: int) -> Column:
        all_ = F.array(*[F.lit(r[i]).cast(sql[kinds[i]]) for r in rows])
        value = F.element_at(all_, (key % len(rows) + 1).cast("int"))
        return (F.replace(value, F.lit(MARK), number) if kinds[i] is str else value).alias(names[i])

    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(key.alias("doc_id"), *[pick(i) for i in range(len(names))])


def cases_sql(rows: Sequence[Sequence], names: Sequence[str]) -> str:
    """The same table in SQL."""
    values = ", ".join("(" + ", ".join([str(n), *map(literal, r)]) + ")" for n, r in enumerate(rows))
    kinds = [any(isinstance(r[i], str) for r in rows) for i in range(len(names))]
    cols = ", ".join(f"replace(v.{n}, '{MARK}', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS {n}" if s else f"v.{n}" for n, s in zip(names, kinds, strict=True))
    return f"(SELECT c_custkey AS doc_id, {cols} FROM customer JOIN (VALUES {values}) AS v(i, {', '.join(names)}) ON c_custkey % {len(rows)} = v.i)"


def place_of(value: str, text: str = "text") -> Column:
    """Where a column's value first stands in a text, from 0."""
    return (F.call_function("locate", F.col(value), F.col(text)) - 1).cast("int")
