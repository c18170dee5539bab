"""Registered study queries: Spark builders and their DuckDB oracle SQL.

Each entry maps a key to ``(builder, oracle_sql_or_None)``.  A builder takes
``(spark, sf_dir)`` and returns a DataFrame over the whole test tables.  Float
results are rounded on both sides (6 digits, or 4 for large sums) and counts are
cast to BIGINT so the two engines hash equal values equally.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expstudy.operators import measures as M
from expstudy.operators import prepare as P
from expstudy.plans import fixtures as X

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

CELL_VARS = ["c_mktsegment", "l_returnflag", "quantity", "discount_pct"]


def register(name: str, oracle: str | None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def r6(c, digits: int = 6):
    """Round a double for cross-engine comparison; a name keeps its name."""
    if isinstance(c, str):
        return F.round(F.col(c), digits).alias(c)
    return F.round(c, digits)


# ---------------------------------------------------------------------------
# Flagship: split -> positive exposure -> cells -> A/E by segment
# ---------------------------------------------------------------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the training split, then A/E by market segment and return flag."""
    e = X.experience(spark, sf_dir, split="TRAIN").drop("dataset")
    e = P.add_split(e, "obs_year", cutoff=1999, label_col="dataset")
    train = P.positive_exposure(P.take_split(e, "TRAIN", "dataset"), "expected")
    c = M.cells(train, CELL_VARS, "expected", "actual", count_name="n_rows")
    out = (c.groupBy("c_mktsegment", "l_returnflag")
           .agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n_rows").alias("n_rows"),
                F.sum("actual").alias("actual"), F.sum("expected").alias("expected")))
    return out.select("c_mktsegment", "l_returnflag", F.col("n_cells").cast("bigint").alias("n_cells"),
                      F.col("n_rows").cast("bigint").alias("n_rows"), r6("actual"), r6("expected"),
                      r6(F.col("actual") / F.col("expected")).alias("ae"))


register("ae_by_segment_cells", X.with_views("""
SELECT c_mktsegment, l_returnflag, CAST(count(*) AS BIGINT) AS n_cells, CAST(sum(n_rows) AS BIGINT) AS n_rows,
       round(sum(actual), 6) AS actual, round(sum(expected), 6) AS expected,
       round(sum(actual) / sum(expected), 6) AS ae
FROM (SELECT c_mktsegment, l_returnflag, quantity, discount_pct, count(*) AS n_rows,
             sum(expected) AS expected, sum(actual) AS actual
      FROM experience WHERE dataset = 'TRAIN' AND coalesce(expected, 0) > 0
      GROUP BY 1, 2, 3, 4) c
GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL))(flagship)


# ---------------------------------------------------------------------------
# PRJ: preparation
# ---------------------------------------------------------------------------

@register("split_counts", X.with_views("""
SELECT CASE WHEN obs_year < 1999 THEN 'TRAIN' ELSE 'TEST' END AS dataset,
       CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual,
       round(sum(expected), 6) AS expected, round(sum(actual) / sum(expected), 6) AS ae
FROM experience GROUP BY 1
""", experience=X.EXPERIENCE_SQL))
def q_split_counts(spark, sf_dir):
    e = P.add_split(X.experience(spark, sf_dir).drop("dataset"), "obs_year", 1999, "dataset")
    return (e.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                     r6(F.sum("actual")).alias("actual"),
                                     r6(F.sum("expected")).alias("expected"),
                                     r6(F.sum("actual") / F.sum("expected")).alias("ae")))


@register("segment_filter", X.with_views("""
SELECT c_mktsegment, quantity, CAST(count(*) AS BIGINT) AS n_rows,
       round(sum(actual), 6) AS actual, round(sum(expected), 6) AS expected
FROM experience
WHERE l_returnflag = 'R' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL))
def q_segment_filter(spark, sf_dir):
    e = P.segment(X.experience(spark, sf_dir), equals={"l_returnflag": "R"},
                  isin={"o_orderpriority": ["1-URGENT", "2-HIGH"]})
    c = M.cells(e, ["c_mktsegment", "quantity"], "expected", "actual", count_name="n_rows")
    return c.select("c_mktsegment", "quantity", F.col("n_rows").cast("bigint").alias("n_rows"),
                    r6("actual"), r6("expected"))


@register("positive_exposure", X.with_views("""
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual,
       round(sum(expected), 6) AS expected
FROM experience WHERE coalesce(expected, 0) > 0 GROUP BY 1
""", experience=X.EXPERIENCE_DIRTY_SQL))
def q_positive_exposure(spark, sf_dir):
    e = P.positive_exposure(X.experience(spark, sf_dir, dirty=True), "expected")
    return e.groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                    r6(F.sum("actual")).alias("actual"), r6(F.sum("expected")).alias("expected"))


@register("recode_missing", X.with_views("""
SELECT CASE WHEN coalesce(c_mktsegment, 'UNKNOWN') = 'UNKNOWN' THEN 'Unismoke' ELSE c_mktsegment END AS c_mktsegment,
       CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual
FROM experience GROUP BY 1
""", experience=X.EXPERIENCE_DIRTY_SQL))
def q_recode_missing(spark, sf_dir):
    e = P.recode_missing(X.experience(spark, sf_dir, dirty=True), "c_mktsegment", "UNKNOWN", "Unismoke")
    return e.groupBy("c_mktsegment").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                         r6(F.sum("actual")).alias("actual"))


QTY_EDGES = [0, 10, 20, 30, 40, 51]
QTY_LABELS = ["00-09", "10-19", "20-29", "30-39", "40-50"]


@register("bin_numeric", X.with_views("""
SELECT CASE WHEN quantity >= 0 AND quantity < 10 THEN '00-09'
            WHEN quantity >= 10 AND quantity < 20 THEN '10-19'
            WHEN quantity >= 20 AND quantity < 30 THEN '20-29'
            WHEN quantity >= 30 AND quantity < 40 THEN '30-39'
            WHEN quantity >= 40 AND quantity < 51 THEN '40-50' END AS quantity_band,
       dataset, CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual) / sum(expected), 6) AS ae
FROM experience GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL))
def q_bin_numeric(spark, sf_dir):
    e = P.bin_numeric(X.experience(spark, sf_dir), "quantity", QTY_EDGES, QTY_LABELS, out="quantity_band")
    return (e.groupBy("quantity_band", "dataset")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), r6(F.sum("actual") / F.sum("expected")).alias("ae")))


@register("clip_numeric", X.with_views("""
SELECT CASE WHEN quantity < 5 THEN 5 WHEN quantity > 45 THEN 45 ELSE quantity END AS quantity,
       CASE WHEN discount_pct < 1 THEN 1 WHEN discount_pct > 9 THEN 9 ELSE discount_pct END AS discount_pct,
       CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual
FROM experience GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL))
def q_clip_numeric(spark, sf_dir):
    e = P.clip(X.experience(spark, sf_dir), {"quantity": (5, 45), "discount_pct": (1, 9)})
    return e.groupBy("quantity", "discount_pct").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                                     r6(F.sum("actual")).alias("actual"))


@register("json_safe", """
SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS o_totalprice,
       strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS order_date,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS order_ts
FROM orders
""")
def q_json_safe(spark, sf_dir):
    o = X.table(spark, sf_dir, "orders")
    df = o.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"),
                  F.to_date("o_orderdate").alias("order_date"),
                  F.col("o_orderdate").cast("timestamp").alias("order_ts"))
    return P.json_safe(df)


# ---------------------------------------------------------------------------
# AGG: measures
# ---------------------------------------------------------------------------

@register("cells", X.with_views("""
SELECT c_mktsegment, l_returnflag, quantity, discount_pct,
       round(sum(expected), 6) AS expected, round(sum(actual), 6) AS actual,
       CAST(count(*) AS BIGINT) AS n_rows
FROM experience WHERE dataset = 'TRAIN' GROUP BY 1, 2, 3, 4
""", experience=X.EXPERIENCE_SQL))
def q_cells(spark, sf_dir):
    train = P.take_split(X.experience(spark, sf_dir, split="TRAIN"), "TRAIN", "dataset")
    c = M.cells(train, CELL_VARS, "expected", "actual", count_name="n_rows")
    return c.select(*CELL_VARS, r6("expected"), r6("actual"), F.col("n_rows").cast("bigint").alias("n_rows"))


@register("model_view", X.with_views("""
SELECT dataset, o_orderpriority, c_mktsegment,
       round(sum(coalesce(expected, 0)), 6) AS expected, round(sum(coalesce(actual, 0)), 6) AS actual
FROM experience GROUP BY 1, 2, 3
""", experience=X.EXPERIENCE_DIRTY_SQL))
def q_model_view(spark, sf_dir):
    mv = M.model_view(X.experience(spark, sf_dir, dirty=True), ["o_orderpriority", "c_mktsegment"],
                      ["expected", "actual"], split_col="dataset")
    return mv.select("dataset", "o_orderpriority", "c_mktsegment", r6("expected"), r6("actual"))


@register("ae_total", X.with_views("""
SELECT round(sum(actual), 6) AS actual, round(sum(expected), 6) AS expected,
       round(sum(actual) / sum(expected), 6) AS ae
FROM experience
""", experience=X.EXPERIENCE_SQL))
def q_ae_total(spark, sf_dir):
    a = M.ae(X.experience(spark, sf_dir), "actual", "expected")
    return a.select(r6("actual"), r6("expected"), r6("ae"))


@register("ae_by_segment", X.with_views("""
SELECT dataset, c_mktsegment, o_orderpriority,
       round(sum(actual), 6) AS actual, round(sum(expected), 6) AS expected,
       round(sum(actual) / nullif(sum(expected), 0), 6) AS ae
FROM experience GROUP BY 1, 2, 3
""", experience=X.EXPERIENCE_SQL))
def q_ae_by_segment(spark, sf_dir):
    a = M.ae(X.experience(spark, sf_dir), "actual", "expected", by=["dataset", "c_mktsegment", "o_orderpriority"])
    return a.select("dataset", "c_mktsegment", "o_orderpriority", r6("actual"), r6("expected"), r6("ae"))


@register("levels", X.with_views("""
SELECT DISTINCT c_mktsegment FROM experience
""", experience=X.EXPERIENCE_DIRTY_SQL))
def q_levels(spark, sf_dir):
    return M.levels(X.experience(spark, sf_dir, dirty=True), "c_mktsegment")


@register("ranges", X.with_views("""
SELECT min(quantity) AS quantity_min, max(quantity) AS quantity_max,
       min(discount_pct) AS discount_pct_min, max(discount_pct) AS discount_pct_max,
       min(obs_year) AS obs_year_min, max(obs_year) AS obs_year_max
FROM experience
""", experience=X.EXPERIENCE_SQL))
def q_ranges(spark, sf_dir):
    return M.ranges(X.experience(spark, sf_dir), ["quantity", "discount_pct", "obs_year"])


@register("totals", X.with_views("""
SELECT round(sum(actual), 6) AS actual, round(sum(expected), 6) AS expected
FROM experience
""", experience=X.EXPERIENCE_DIRTY_SQL))
def q_totals(spark, sf_dir):
    t = M.totals(X.experience(spark, sf_dir, dirty=True), ["actual", "expected"])
    return t.select(r6("actual"), r6("expected"))


@register("exposure_quality", X.with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_cells,
       CAST(count(*) FILTER (WHERE coalesce(expected, 0) = 0) AS BIGINT) AS n_zero_expected,
       CAST(count(*) FILTER (WHERE coalesce(expected, 0) = 0 AND coalesce(actual, 0) > 0) AS BIGINT)
           AS n_claims_zero_expected,
       round(sum(CASE WHEN coalesce(expected, 0) = 0 THEN actual END), 6) AS claims_zero_expected
FROM (SELECT c_mktsegment, l_returnflag, quantity, l_linenumber,
             sum(expected) AS expected, sum(actual) AS actual
      FROM experience GROUP BY 1, 2, 3, 4) c
""", experience=X.EXPERIENCE_DIRTY_SQL))
def q_exposure_quality(spark, sf_dir):
    c = M.cells(X.experience(spark, sf_dir, dirty=True), ["c_mktsegment", "l_returnflag", "quantity", "l_linenumber"],
                "expected", "actual")
    q = M.exposure_quality(c, "expected", "actual")
    return q.select(F.col("n_cells").cast("bigint").alias("n_cells"),
                    F.col("n_zero_expected").cast("bigint").alias("n_zero_expected"),
                    F.col("n_claims_zero_expected").cast("bigint").alias("n_claims_zero_expected"),
                    r6("claims_zero_expected"))


@register("n_rows", X.with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_rows FROM experience WHERE dataset = 'TEST'
""", experience=X.EXPERIENCE_SQL))
def q_n_rows(spark, sf_dir):
    t = P.take_split(X.experience(spark, sf_dir, split="TEST"), "TEST", "dataset")
    return t.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


# ---------------------------------------------------------------------------
# Cash flows (AGG-10/11, WIN-2)
# ---------------------------------------------------------------------------

@register("discount_factors", X.with_views("""
SELECT portfolio_id, t, round(amt, 6) AS amt, rate,
       round(product(1.0 / (1.0 + rate)) OVER (PARTITION BY portfolio_id ORDER BY t
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS v
FROM cash_flows
""", cash_flows=X.CASH_FLOWS_SQL))
def q_discount_factors(spark, sf_dir):
    v = M.discount_factors(X.cash_flows(spark, sf_dir))
    return v.select("portfolio_id", "t", r6("amt"), "rate", r6("v", 9))


@register("present_value", X.with_views("""
SELECT portfolio_id, round(sum(amt * v), 4) AS pv, CAST(count(*) AS BIGINT) AS n_periods
FROM (SELECT portfolio_id, amt,
             product(1.0 / (1.0 + rate)) OVER (PARTITION BY portfolio_id ORDER BY t
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
      FROM cash_flows) d
GROUP BY 1
""", cash_flows=X.CASH_FLOWS_SQL))
def q_present_value(spark, sf_dir):
    pv = M.present_value(X.cash_flows(spark, sf_dir))
    return pv.select("portfolio_id", r6("pv", 4), F.col("n_periods").cast("bigint").alias("n_periods"))


@register("pv_spread", X.with_views("""
SELECT CAST(count(pv) AS BIGINT) AS n, round(avg(pv), 4) AS mean, round(min(pv), 4) AS min,
       round(max(pv), 4) AS max, round(stddev_pop(pv), 4) AS sd_pop
FROM (SELECT portfolio_id, sum(amt * v) AS pv
      FROM (SELECT portfolio_id, amt,
                   product(1.0 / (1.0 + rate)) OVER (PARTITION BY portfolio_id ORDER BY t
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
            FROM cash_flows) d
      GROUP BY 1) p
""", cash_flows=X.CASH_FLOWS_SQL))
def q_pv_spread(spark, sf_dir):
    s = M.spread(M.present_value(X.cash_flows(spark, sf_dir)), "pv")
    return s.select(F.col("n").cast("bigint").alias("n"), r6("mean", 4), r6("min", 4), r6("max", 4),
                    r6("sd_pop", 4))


# ---------------------------------------------------------------------------
# Prediction files (AGG-8, AGG-13, WIN-1, WIN-5)
# ---------------------------------------------------------------------------

LL_SQL = """
SELECT file, sum(CASE WHEN actual = 0 THEN -MODEL_PRED
                      ELSE actual * ln(MODEL_PRED) - MODEL_PRED - lgamma(actual + 1) END) AS ll,
       count(*) AS n_rows
FROM predictions GROUP BY 1
"""


@register("poisson_loglik_by_file", X.with_views(
    "SELECT file, round(ll, 4) AS ll, CAST(n_rows AS BIGINT) AS n_rows FROM ll",
    predictions=X.PREDICTIONS_SQL, ll=LL_SQL))
def q_loglik(spark, sf_dir):
    ll = M.poisson_loglik(X.predictions(spark, sf_dir), "actual", "MODEL_PRED", by=["file"])
    return ll.select("file", r6("ll", 4), F.col("n_rows").cast("bigint").alias("n_rows"))


@register("poisson_loglik_by_segment", X.with_views("""
SELECT file, c_mktsegment,
       round(sum(CASE WHEN actual = 0 THEN -MODEL_PRED
                      ELSE actual * ln(MODEL_PRED) - MODEL_PRED - lgamma(actual + 1) END), 4) AS ll
FROM (SELECT file, c_mktsegment, quantity, sum(actual) AS actual, sum(MODEL_PRED) AS MODEL_PRED
      FROM predictions GROUP BY 1, 2, 3) c
GROUP BY 1, 2
""", predictions=X.PREDICTIONS_SQL))
def q_loglik_segment(spark, sf_dir):
    c = M.cells(X.predictions(spark, sf_dir), ["file", "c_mktsegment", "quantity"], "MODEL_PRED", "actual")
    ll = M.poisson_loglik(c, "actual", "MODEL_PRED", by=["file", "c_mktsegment"])
    return ll.select("file", "c_mktsegment", r6("ll", 4))


@register("best_run", X.with_views("""
SELECT file, round(ll, 4) AS ll FROM ll ORDER BY ll DESC, file LIMIT 1
""", predictions=X.PREDICTIONS_SQL, ll=LL_SQL))
def q_best_run(spark, sf_dir):
    ll = M.poisson_loglik(X.predictions(spark, sf_dir), "actual", "MODEL_PRED", by=["file"])
    b = M.best_run(ll, "ll", "file")
    return b.select("file", r6("ll", 4))


@register("run_index", X.with_views("""
SELECT file, round(ll, 4) AS ll, CAST(row_number() OVER (ORDER BY file) AS INTEGER) AS run_ix FROM ll
""", predictions=X.PREDICTIONS_SQL, ll=LL_SQL))
def q_run_index(spark, sf_dir):
    ll = M.poisson_loglik(X.predictions(spark, sf_dir), "actual", "MODEL_PRED", by=["file"])
    return M.run_index(ll, "file").select("file", r6("ll", 4), F.col("run_ix").cast("int").alias("run_ix"))


@register("first_per_key", X.with_views("""
SELECT c_mktsegment, obs_year, quantity, discount_pct, l_returnflag, o_orderpriority, expected, actual, dataset
FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment
          ORDER BY obs_year, quantity, discount_pct, o_orderpriority, l_returnflag, expected, actual, dataset) AS rn
      FROM experience) r
WHERE rn = 1
""", experience=X.EXPERIENCE_SQL))
def q_first_per_key(spark, sf_dir):
    e = X.experience(spark, sf_dir)
    f = M.first_per(e, "c_mktsegment", ["obs_year", "quantity", "discount_pct"])
    return f


# ---------------------------------------------------------------------------
# PRJ-3 by year, PRJ-8, PRJ-12, PRJ-14
# ---------------------------------------------------------------------------

@register("split_by_year", X.with_views("""
SELECT obs_year, CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual
FROM experience WHERE obs_year <= 1997 GROUP BY 1
""", experience=X.EXPERIENCE_SQL))
def q_split_by_year(spark, sf_dir):
    # the year bound as a range on the scan column, so that it reaches the Parquet reader
    t = X.experience(spark, sf_dir, until=f"{1997 + 1}-01-01 00:00:00")
    t = P.take_split_by_year(t, "obs_year", 1997, train=True)
    return t.groupBy("obs_year").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), r6(F.sum("actual")).alias("actual"))


@register("upper_columns", X.with_views("""
SELECT c_mktsegment AS C_MKTSEGMENT, dataset AS DATASET, round(sum(actual), 6) AS ACTUAL_SUM,
       round(sum(expected), 6) AS EXPECTED_SUM
FROM experience GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL))
def q_upper_columns(spark, sf_dir):
    u = P.upper_columns(X.experience(spark, sf_dir))
    a = M.ae(u, "actual", "EXPECTED", by=["c_mktsegment", "dataset"])  # names resolve case-insensitively
    return a.select("C_MKTSEGMENT", "DATASET", r6("actual").alias("ACTUAL_SUM"), r6("expected").alias("EXPECTED_SUM"))


@register("drop_constant_columns", X.with_views("""
SELECT c_mktsegment, o_orderpriority, CAST(count(*) AS BIGINT) AS n_rows,
       round(sum(actual), 6) AS claims
FROM experience WHERE l_returnflag = 'R' AND dataset = 'TRAIN' GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL))
def q_drop_constant_columns(spark, sf_dir):
    e = P.segment(X.experience(spark, sf_dir, split="TRAIN"), equals={"l_returnflag": "R"})
    kept = P.drop_constant_columns(e, ["l_returnflag", "dataset", "expected", "c_mktsegment", "o_orderpriority"])
    keys = [c for c in ["l_returnflag", "dataset", "expected", "c_mktsegment", "o_orderpriority"] if c in kept.columns]
    out = kept.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.sum("actual").alias("actual"))
    return P.rename_measures(out.withColumn("actual", r6("actual")), {"actual": "claims"})
