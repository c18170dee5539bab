"""Aggregate measures of an experience study (AGG-*, WIN-1/2/5).

All grouped measures are hash aggregates with a map-side partial step: a hot
group (one predictor combination holding a third of all rows) is combined
inside each map task before the shuffle, so no task ever receives the raw rows
of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from expstudy.functions.expr import poisson_logpmf, safe_div
from expstudy.functions.ranking import row_number_within, running_products_within
from expstudy.schema import resolve_col, resolve_cols


def cells(df: DataFrame, x_vars: Sequence[str], offset: str, y: str,
          offset_name: str | None = None, y_name: str | None = None,
          count_name: str | None = None, null_as_zero: bool = False) -> DataFrame:
    """AGG-1: one row per distinct predictor combination with summed offset and y.

    Lossless for a Poisson likelihood with a log offset.  ``null_as_zero`` is the
    AGG-2 variant (NULL measures count as 0, so an all-NULL group sums to 0).
    ``count_name`` adds the number of source rows per cell.
    """
    xs = resolve_cols(df, x_vars)
    o, t = resolve_col(df, offset), resolve_col(df, y)
    oc, yc = F.col(o), F.col(t)
    if null_as_zero:
        oc, yc = F.coalesce(oc, F.lit(0.0)), F.coalesce(yc, F.lit(0.0))
    aggs = [F.sum(oc).cast("double").alias(offset_name or o), F.sum(yc).cast("double").alias(y_name or t)]
    if count_name:
        aggs.append(F.count(F.lit(1)).alias(count_name))
    return df.groupBy(*xs).agg(*aggs)


def model_view(df: DataFrame, keys: Sequence[str], measures: Sequence[str],
               split_col: str = "dataset") -> DataFrame:
    """AGG-2: split label + keys, every measure summed with NULL as 0."""
    ks = [resolve_col(df, split_col)] + resolve_cols(df, keys)
    aggs = [F.sum(F.coalesce(F.col(m), F.lit(0.0))).cast("double").alias(m)
            for m in resolve_cols(df, measures)]
    return df.groupBy(*ks).agg(*aggs)


def ae(df: DataFrame, actual: str, expected: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-3: actual, expected and A/E = sum(actual) / sum(expected), overall or by segment."""
    a, e = resolve_col(df, actual), resolve_col(df, expected)
    g = df.groupBy(*resolve_cols(df, by)) if by else df.groupBy()
    out = g.agg(F.sum(a).cast("double").alias("actual"), F.sum(e).cast("double").alias("expected"))
    return out.withColumn("ae", safe_div("actual", "expected"))


def ae_value(df: DataFrame, actual: str, expected: str) -> float | None:
    """Overall A/E as a Python number (one aggregate job)."""
    return ae(df, actual, expected).first()["ae"]


def n_rows(df: DataFrame) -> int:
    """AGG-4: row count."""
    return df.count()


def levels(df: DataFrame, col: str) -> DataFrame:
    """AGG-5: distinct values of one column (NULL included as a value)."""
    c = resolve_col(df, col)
    return df.select(c).distinct()


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-6: min and max of every column in one aggregate (NULL skipped)."""
    names = resolve_cols(df, cols)
    aggs = []
    for c in names:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*aggs)


def totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG-7: ungrouped sums."""
    return df.agg(*[F.sum(c).cast("double").alias(c) for c in resolve_cols(df, cols)])


def poisson_loglik(df: DataFrame, y: str, mu: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-8: sum of Poisson log densities ``log dpois(y, mu)``, overall or per group."""
    term = poisson_logpmf(F.col(resolve_col(df, y)), F.col(resolve_col(df, mu)))
    g = df.groupBy(*resolve_cols(df, by)) if by else df.groupBy()
    return g.agg(F.sum(term).alias("ll"), F.count(F.lit(1)).alias("n_rows"))


def exposure_quality(cells_df: DataFrame, offset: str, y: str) -> DataFrame:
    """AGG-9: counts of cells, zero-expected cells, and zero-expected cells with claims."""
    o, t = F.col(resolve_col(cells_df, offset)), F.col(resolve_col(cells_df, y))
    zero = F.coalesce(o, F.lit(0.0)) == 0
    return cells_df.agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(zero).alias("n_zero_expected"),
        F.count_if(zero & (F.coalesce(t, F.lit(0.0)) > 0)).alias("n_claims_zero_expected"),
        F.sum(F.when(zero, t)).cast("double").alias("claims_zero_expected"),
    )


def cells_with_claims_no_expected(cells_df: DataFrame, offset: str, y: str) -> DataFrame:
    """AGG-9: the cells that have claims but zero expected."""
    o, t = F.col(resolve_col(cells_df, offset)), F.col(resolve_col(cells_df, y))
    return cells_df.filter((F.coalesce(o, F.lit(0.0)) == 0) & (F.coalesce(t, F.lit(0.0)) > 0))


def discount_factors(cf: DataFrame, by: Sequence[str] = ("portfolio_id",), t: str = "t",
                     rate: str = "rate", out: str = "v") -> DataFrame:
    """WIN-2: ``v_t = prod_{s<=t} 1/(1+i_s)`` as a running product per portfolio.

    A product scan over range pieces (``ranking.running_products_within``), so one portfolio may
    hold any share of the periods; no ``exp(sum(ln))``, which fails for rates <= -1.  A rate
    of -1 gives an infinite factor.  ``t`` is unique within a portfolio.
    """
    growth = 1.0 + F.col(resolve_col(cf, rate))
    factor = F.when(growth == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.when(growth != 0, growth))
    return running_products_within(cf.withColumn("__factor", factor), resolve_cols(cf, by), [resolve_col(cf, t)], "__factor", out).drop("__factor")


def present_value(cf: DataFrame, by: Sequence[str] = ("portfolio_id",), t: str = "t",
                  amt: str = "amt", rate: str = "rate") -> DataFrame:
    """AGG-10: ``PV = sum_t amt_t * v_t`` per portfolio."""
    v = discount_factors(cf, by, t, rate)
    return (v.groupBy(*resolve_cols(cf, by))
            .agg(F.sum(F.col(resolve_col(cf, amt)) * F.col("v")).alias("pv"),
                 F.count(F.lit(1)).alias("n_periods")))


def spread(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-11: count, mean, min, max and population sd of repeated values."""
    c = resolve_col(df, col)
    g = df.groupBy(*resolve_cols(df, by)) if by else df.groupBy()
    return g.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"),
                 F.max(c).alias("max"), F.stddev_pop(c).alias("sd_pop"))


def best_run(scores: DataFrame, score: str = "ll", name: str = "file") -> DataFrame:
    """AGG-13: the run with the highest score (ties broken by the smallest name)."""
    s, n = resolve_col(scores, score), resolve_col(scores, name)
    # min over (-score, name): highest score first, then the smallest name.
    best = F.min(F.struct((-F.col(s)).alias("neg"), F.col(n).alias("name"), F.col(s).alias("score")))
    return scores.agg(best.alias("b")).select(F.col("b.name").alias(n), F.col("b.score").alias(s))


def first_per(df: DataFrame, key: Sequence[str] | str, order: Sequence[str] | str) -> DataFrame:
    """WIN-1: the first row per key by ``order`` (remaining columns break ties).

    Written as ``min(struct(order..., rest...))`` grouped by key: an aggregate
    with a map-side partial step rather than a ``row_number`` window, so a key
    that holds a third of the rows never lands whole in one task.
    """
    keys = resolve_cols(df, [key] if isinstance(key, str) else key)
    orders = resolve_cols(df, [order] if isinstance(order, str) else order)
    rest = [c for c in df.columns if c not in keys and c not in orders]
    packed = F.min(F.struct(*[F.col(c) for c in orders + rest])).alias("__first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in orders + rest])


def run_index(scores: DataFrame, order: str, out: str = "run_ix") -> DataFrame:
    """WIN-5: 1..n position of each run in ``order`` (unique), numbered over range pieces."""
    whole = scores.withColumn("__all", F.lit(1))
    return row_number_within(whole, ["__all"], [resolve_col(scores, order)], out=out).drop("__all")


def tail_log_sd(path: DataFrame, value: str, index: str, start) -> DataFrame:
    """AGG-12: one row with ``sd``, the sample sd of ``ln(value)``, and ``top``, the largest value, over the
    positive values at indices from ``start`` on."""
    v = F.when((F.col(index) >= start) & (F.col(value) > 0), F.col(value))
    return path.agg(F.stddev_samp(F.log(v)).alias("sd"), F.max(v).alias("top"))


def first_seen(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """SET-4: one row with ``values``, the distinct values of a column in first-seen order.

    Each value's first place is an aggregate with map-side partials; only distinct values are sorted.
    """
    firsts = df.groupBy(F.col(col).alias("value")).agg(F.min(F.struct(*order)).alias("first"))
    places = F.array_sort(F.collect_list(F.struct("first", "value")))
    return firsts.agg(F.array_distinct(F.transform(places, lambda x: x["value"])).alias("values"))
