"""Catalog helpers: views, definitions and schemas (SRC-4 .. SRC-7, MOD-25 helpers).

Spark keeps the text of catalog views, but none for temporary views; those registered
through ``register_view`` remember theirs here, by session.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
_VIEW_TEXT: dict[tuple[str, str], str] = {}


def _key(spark: SparkSession, name: str) -> tuple[str, str]:
    return spark._jsparkSession.sessionUUID(), name.lower()


def register_view(spark: SparkSession, name: str, sql_or_df) -> DataFrame:
    """SRC-4: create or replace a named view from SQL text or a DataFrame."""
    if not _NAME.match(name):
        raise ValueError(f"invalid view name {name!r}")
    if isinstance(sql_or_df, str):
        df = spark.sql(sql_or_df)
        _VIEW_TEXT[_key(spark, name)] = sql_or_df
    else:
        df = sql_or_df
        _VIEW_TEXT.pop(_key(spark, name), None)
    df.createOrReplaceTempView(name)
    return df


def list_views(spark: SparkSession) -> list[str]:
    """SRC-5: user views in name order (system schemas excluded)."""
    return sorted(t.name for t in spark.catalog.listTables() if t.tableType in ("TEMPORARY", "VIEW"))


def view_definition(spark: SparkSession, name: str) -> str:
    """SRC-6: SQL text of one view; error when zero or several views match."""
    hits = [v for v in list_views(spark) if v.lower() == name.lower()]
    if len(hits) != 1:
        raise ValueError(f"expected one view named {name}, found {len(hits)}")
    text = _VIEW_TEXT.get(_key(spark, name))
    if text is None:
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED `{hits[0]}`").collect()}
        text = told.get("View Text")
    if text is None:
        raise ValueError(f"view {name} was made from a DataFrame and has no SQL text")
    return text


def _type_name(dt: T.DataType) -> str:
    return dt.simpleString().upper()


def table_schema(spark: SparkSession, name: str) -> DataFrame:
    """SRC-7: (column, TYPE) of a table or view; the name must be a plain identifier."""
    if not _NAME.match(name):
        raise ValueError(f"invalid table name {name!r}")
    fields = spark.table(name).schema.fields
    return spark.createDataFrame([(f.name, _type_name(f.dataType)) for f in fields], "column_name string, column_type string")


def schema_of(df: DataFrame) -> DataFrame:
    """SRC-7 for a DataFrame: one row per column with its upper-case type."""
    return df.sparkSession.createDataFrame([(f.name, _type_name(f.dataType)) for f in df.schema.fields],
                                           "column_name string, column_type string")
