"""Row-level preparation of modelling views (PRJ-1 .. PRJ-14).

Every function returns a lazily planned DataFrame: projections and filters stay
in one whole-stage-codegen span and filters on scan columns reach the Parquet
reader as pushed predicates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from expstudy.functions.expr import clip as clip_col
from expstudy.schema import SPLIT_COLUMN, TEST, TRAIN, resolve_col, resolve_cols

# Default split year and missing-smoker recode of the reference.
DEFAULT_SPLIT_YEAR = 2016
MISSING_SENTINEL = "UNKNOWN"
MISSING_RECODE = "Unismoke"


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-1: projection, names resolved case-insensitively, order as asked."""
    return df.select(*resolve_cols(df, cols))


def add_split(df: DataFrame, year_col: str, cutoff: int = DEFAULT_SPLIT_YEAR,
              label_col: str = SPLIT_COLUMN) -> DataFrame:
    """PRJ-2: ``TRAIN`` when ``year < cutoff``, else ``TEST`` (NULL year -> TEST)."""
    y = F.col(resolve_col(df, year_col))
    return df.withColumn(label_col, F.when(y < cutoff, F.lit(TRAIN)).otherwise(F.lit(TEST)))


def take_split(df: DataFrame, label: str = TRAIN, label_col: str = SPLIT_COLUMN) -> DataFrame:
    """PRJ-3: keep one split by its label."""
    return df.filter(F.col(resolve_col(df, label_col)) == label)


def take_split_by_year(df: DataFrame, year_col: str, cutoff: int = DEFAULT_SPLIT_YEAR,
                       train: bool = True) -> DataFrame:
    """PRJ-3: keep ``year <= cutoff`` (train) or ``year > cutoff`` (test)."""
    y = F.col(resolve_col(df, year_col))
    return df.filter(y <= cutoff if train else y > cutoff)


def positive_exposure(df: DataFrame, offset: str) -> DataFrame:
    """PRJ-4: drop rows whose offset is NULL or <= 0."""
    return df.filter(F.coalesce(F.col(resolve_col(df, offset)), F.lit(0)) > 0)


def segment(df: DataFrame, equals: Mapping[str, object] | None = None,
            isin: Mapping[str, Sequence[object]] | None = None) -> DataFrame:
    """PRJ-5: conjunction of equality and IN predicates (pushed to the scan)."""
    cond = F.lit(True)
    for k, v in (equals or {}).items():
        cond = cond & (F.col(resolve_col(df, k)) == F.lit(v))
    for k, vs in (isin or {}).items():
        cond = cond & F.col(resolve_col(df, k)).isin(list(vs))
    return df.filter(cond)


def recode_missing(df: DataFrame, col: str, sentinel: str = MISSING_SENTINEL,
                   to: str = MISSING_RECODE) -> DataFrame:
    """PRJ-6: NULL or the sentinel value becomes ``to``."""
    c = resolve_col(df, col)
    return df.withColumn(c, F.when(F.coalesce(F.col(c), F.lit(sentinel)) == sentinel, F.lit(to))
                         .otherwise(F.col(c)))


def bin_numeric(df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str],
                out: str | None = None) -> DataFrame:
    """PRJ-7: left-closed bands ``[edges[i], edges[i+1])``; outside or NULL -> NULL.

    ``len(labels) == len(edges) - 1``.  A CASE chain, so it stays in codegen.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per band")
    c = F.col(resolve_col(df, col))
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (c >= lo) & (c < hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return df.withColumn(out or f"{resolve_col(df, col)}_band", expr.otherwise(F.lit(None).cast("string")))


def upper_columns(df: DataFrame) -> DataFrame:
    """PRJ-8: upper-case every column name."""
    return df.toDF(*[c.upper() for c in df.columns])


def count_non_positive(df: DataFrame, offset: str) -> int:
    """Number of rows whose offset is NULL or <= 0 (one aggregate job)."""
    o = F.col(resolve_col(df, offset))
    return int(df.agg(F.count_if(F.coalesce(o, F.lit(0)) <= 0).alias("n")).first()["n"])


def assert_positive_exposure(cells: DataFrame, offset: str) -> None:
    """PRJ-9: fail when any cell has a NULL or non-positive offset."""
    n = count_non_positive(cells, offset)
    if n > 0:
        raise ValueError(f"{n} rows of the model data have zero exposure")


def clip(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """PRJ-10: clamp numeric columns to ``(lo, hi)``; NULL stays NULL."""
    out = df
    for k, (lo, hi) in ranges.items():
        c = resolve_col(out, k)
        out = out.withColumn(c, clip_col(c, lo, hi))
    return out


def json_safe(df: DataFrame) -> DataFrame:
    """PRJ-11: decimals -> double, dates and timestamps -> ISO-8601 text.

    Timestamps print as ``yyyy-MM-ddTHH:mm:ss`` plus ``.ffffff`` when the
    fraction is not zero (Python's ``isoformat``).
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
                 .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def drop_constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ-12: drop columns from ``cols`` that hold a single value (NULL counts as one).

    One aggregate job of min / max / non-null count / row count per column;
    no DISTINCT, so it is a map-side partial aggregate.
    """
    names = resolve_cols(df, cols)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(names):
        aggs += [F.min(c).alias(f"__mn{i}"), F.max(c).alias(f"__mx{i}"), F.count(c).alias(f"__nn{i}")]
    r = df.agg(*aggs).first()
    drop = []
    for i, c in enumerate(names):
        n_values = 0
        if r[f"__nn{i}"] > 0:
            n_values += 1 if r[f"__mn{i}"] == r[f"__mx{i}"] else 2
        if r[f"__nn{i}"] < r["__n"]:
            n_values += 1
        if n_values <= 1:
            drop.append(c)
    return df.drop(*drop)


def rename_measures(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ-14: restore user names (e.g. ``offset -> Expected``)."""
    out = df
    for old, new in mapping.items():
        out = out.withColumnRenamed(resolve_col(out, old), new)
    return out
