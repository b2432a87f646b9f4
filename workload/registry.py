"""Registration of queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workload.inputs import Inputs
from workload.inputs_sql import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def sql_columns(spec: str) -> str:
    """``"a b:t c:d"`` -> select list; t time, D day, d double, i integer, else as is."""
    shown = {
        "t": "strftime({0}::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') AS {0}",
        "D": "strftime({0}::DATE, '%Y-%m-%d') AS {0}",
        "d": "round(({0})::DOUBLE, 6) + 0.0::DOUBLE AS {0}",
        "i": "({0})::BIGINT AS {0}",
        "": "{0}",
    }
    parts = (token.partition(":") for token in spec.split())
    return ", ".join(shown[kind].format(f'"{name}"') for name, _, kind in parts)


# Metadata of columns that are in their final form.
FORMED = {"formed": True}


def formed(df: DataFrame, spec: str) -> DataFrame:
    """``df`` with those columns of ``spec`` that it has in their final form.

    For rows that a join repeats many times: :func:`tidy` leaves these columns as they are.
    """
    names = " ".join(t for t in spec.split() if t.partition(":")[0] in df.columns)
    shown = dict(zip((t.partition(":")[0] for t in names.split()), _forms(df, names)))
    return df.select(*[shown[c].alias(c, metadata=FORMED) if c in shown else F.col(f"`{c}`") for c in df.columns])


def tidy(df: DataFrame, spec: str) -> DataFrame:
    """The columns of ``spec`` in forms that compare exactly across engines."""
    return df.select(*_forms(df, spec))


def _forms(df: DataFrame, spec: str) -> list[Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    ready = {f.name for f in df.schema.fields if f.metadata.get("formed")}
    out = []
    for token in spec.split():
        name = token.partition(":")[0]
        c = F.col(f"`{name}`")
        if name in ready:
            out.append(c)
            continue
        kind = types[name]
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return out


def query(name: str, spec: str, source: str | None = None, *ctes: str):
    """Register a query on :class:`Inputs`; ``source`` is what follows FROM in the check.

    A name in ``source`` alone needs no repetition in ``ctes``. Without ``source``
    the query is checked for rows only.
    """

    def add(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: tidy(build(Inputs(spark, sf_dir)), spec)
        if source is not None:
            select = f"SELECT {sql_columns(spec)} FROM {source}"
            CHECKS[name] = with_ctes(select, *ctes) if ctes else select
        return build

    return add
