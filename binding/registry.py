"""Query registry: a DataFrame builder, its output columns and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binding.views import compose
from fundaflow.session import configure


@dataclass(frozen=True)
class Query:
    survey_id: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in columns.split()]


def publish(df: DataFrame, columns: str) -> DataFrame:
    """Cast the output to engine-neutral types: i long, s text, b boolean, d/t text, f double, fN rounded."""
    out = []
    for name, kind in _parse(columns):
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind in ("s", "d", "t"):
            c = c.cast("string")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind == "f":
            c = c.cast("double") + F.lit(0.0)
        else:
            c = F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def publish_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _parse(columns):
        if kind == "i":
            e = f"CAST({name} AS BIGINT)"
        elif kind in ("s", "d", "t"):
            e = f"CAST({name} AS VARCHAR)"
        elif kind == "b":
            e = f"CAST({name} AS BOOLEAN)"
        elif kind == "f":
            e = f"CAST({name} AS DOUBLE) + 0.0"
        else:
            e = f"round(CAST({name} AS DOUBLE), {kind[1:]}) + 0.0"
        out.append(f"{e} AS {name}")
    return compose(f"SELECT {', '.join(out)} FROM (\n{compose_inner(sql)}\n) published")


def compose_inner(sql: str) -> str:
    return sql.strip()


def query(name: str, survey_id: str, columns: str, sql: str | None = None):
    """Register a builder under a name."""

    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(survey_id, build, columns, sql)
        return build

    return add


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return publish(q.build(spark, sf_dir), q.columns)

    return run


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    return None if q.sql is None else publish_sql(q.sql, q.columns)
