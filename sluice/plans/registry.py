"""Where queries register with the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inline(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def dealt(values: list, key: str) -> Column:
    """One of the values for each row, dealt by a whole number."""
    return F.try_element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def numbered(rows: list[tuple], names: str) -> str:
    """The rows as a DuckDB subquery t with their number `i` first, to be joined by a modulus."""
    return sql_values([(i, *r) for i, r in enumerate(rows)], f"i, {names}")


def sql_values(rows: list, names: str) -> str:
    """The same rows as a DuckDB subquery."""

    def lit(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"
