"""Surrogate study tables built from the driver's TPC-H-style test tables.

The reference works on a mortality experience table that is not shipped.  These
views play the same roles (see FIXTURES.md, S1-S4): ``experience`` is a
row-per-exposure table with predictors, an expected count (the offset) and an
actual count; ``cash_flows`` feeds present values; ``lineage_log`` is a
workspace tree; ``predictions`` is a scored dataset.

Each builder has a DataFrame form (what the library runs) and an SQL form
(``*_SQL``, DuckDB dialect) that the correctness oracle uses independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from expstudy.tools import TOOL_CREATE_DATASET, TOOL_GLM, TOOL_INFERENCE, TOOL_TREE

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# S1 experience
# ---------------------------------------------------------------------------

SPLIT_START = "1999-01-01 00:00:00"


def experience(spark: SparkSession, sf_dir: str, dirty: bool = False, split: str | None = None,
               until: str | None = None, with_order: bool = False) -> DataFrame:
    """One row per lineitem: predictors, ``expected`` (offset), ``actual`` (claims).

    The join order is chosen for scale: ``orders`` is joined to ``customer``
    first (the smaller pair, shuffled on ``o_custkey``) and only the result is
    joined to ``lineitem`` on the order key, so the biggest table is shuffled
    once.  Spark picks broadcast or sort-merge per side at run time (AQE and
    ``autoBroadcastJoinThreshold`` check the measured size).

    ``dirty=True`` adds the NULL / zero-exposure variants used by the data
    quality operators: ``expected = 0`` on line number 7 and a missing market
    segment (NULL on even line numbers, 'UNKNOWN' on odd) when quantity is 1.

    ``split='TRAIN'|'TEST'`` keeps one split with a plain range predicate on the
    lineitem scan, which Parquet can push down (the real experience table is
    written partitioned by observation year, where the same filter prunes
    partitions).  ``until`` keeps the rows shipped before a time, in the same way;
    ``with_order`` adds the order key.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_shipdate")
    if until is not None:
        li = li.filter(F.col("l_shipdate") < F.lit(until))
    if split == "TRAIN":
        li = li.filter(F.col("l_shipdate") < F.lit(SPLIT_START))
    elif split == "TEST":
        li = li.filter((F.col("l_shipdate") >= F.lit(SPLIT_START)) | F.col("l_shipdate").isNull())
    elif split is not None:
        raise ValueError("split must be TRAIN or TEST")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    oc = orders.join(cust, orders.o_custkey == cust.c_custkey)
    j = li.join(oc, li.l_orderkey == oc.o_orderkey)

    year = F.year("l_shipdate")
    disc = F.round(F.col("l_discount") * 100)
    building = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(6)).otherwise(F.lit(0))
    actual = F.when(F.col("l_quantity") + disc * 2 + building > 45.5, 1.0).otherwise(0.0)
    segment = F.col("c_mktsegment")
    expected = F.lit(0.25).cast("double")
    if dirty:
        qty1 = F.col("l_quantity").cast("int") == 1
        segment = (F.when(qty1 & (F.col("l_linenumber") % 2 == 0), F.lit(None).cast("string"))
                   .when(qty1, F.lit("UNKNOWN")).otherwise(segment))
        expected = F.when(F.col("l_linenumber") == 7, F.lit(0.0)).otherwise(F.lit(0.25))
    cols = [
        year.cast("int").alias("obs_year"),
        F.col("o_orderpriority"),
        segment.alias("c_mktsegment"),
        F.col("l_returnflag"),
        F.col("l_quantity").cast("int").alias("quantity"),
        disc.cast("int").alias("discount_pct"),
        expected.cast("double").alias("expected"),
        actual.cast("double").alias("actual"),
        # year < 1999, written as a range on the scan column
        F.when(F.col("l_shipdate") < F.lit(SPLIT_START), F.lit("TRAIN")).otherwise(F.lit("TEST")).alias("dataset"),
    ]
    if dirty:
        cols.append(F.col("l_linenumber"))
    if with_order:
        cols.append(F.col("l_orderkey"))
    return j.select(*cols)


EXPERIENCE_SQL = """
SELECT CAST(year(l_shipdate) AS INTEGER)       AS obs_year,
       o_orderpriority, c_mktsegment, l_returnflag,
       CAST(l_quantity AS INTEGER)             AS quantity,
       CAST(round(l_discount * 100) AS INTEGER) AS discount_pct,
       CAST(0.25 AS DOUBLE)                    AS expected,
       CAST(CASE WHEN l_quantity + round(l_discount * 100) * 2
                 + CASE WHEN c_mktsegment = 'BUILDING' THEN 6 ELSE 0 END > 45.5
            THEN 1 ELSE 0 END AS DOUBLE)       AS actual,
       CASE WHEN year(l_shipdate) < 1999 THEN 'TRAIN' ELSE 'TEST' END AS dataset
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey
"""

EXPERIENCE_DIRTY_SQL = """
SELECT CAST(year(l_shipdate) AS INTEGER)       AS obs_year,
       o_orderpriority,
       CASE WHEN CAST(l_quantity AS INTEGER) = 1 AND l_linenumber % 2 = 0 THEN NULL
            WHEN CAST(l_quantity AS INTEGER) = 1 THEN 'UNKNOWN'
            ELSE c_mktsegment END              AS c_mktsegment,
       l_returnflag,
       CAST(l_quantity AS INTEGER)             AS quantity,
       CAST(round(l_discount * 100) AS INTEGER) AS discount_pct,
       CAST(CASE WHEN l_linenumber = 7 THEN 0.0 ELSE 0.25 END AS DOUBLE) AS expected,
       CAST(CASE WHEN l_quantity + round(l_discount * 100) * 2
                 + CASE WHEN c_mktsegment = 'BUILDING' THEN 6 ELSE 0 END > 45.5
            THEN 1 ELSE 0 END AS DOUBLE)       AS actual,
       CASE WHEN year(l_shipdate) < 1999 THEN 'TRAIN' ELSE 'TEST' END AS dataset,
       l_linenumber
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
              JOIN customer ON o_custkey = c_custkey
"""

# ---------------------------------------------------------------------------
# S2 cash flows
# ---------------------------------------------------------------------------


def cash_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (supplier, ship year): ``portfolio_id, year, t, amt, rate``.

    Pre-aggregated by (supplier, year) with a partial hash aggregate before the
    shuffle; the period index ``t`` is a window over one portfolio, whose size is
    the number of distinct years (bounded by the calendar, not by row count).
    """
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_shipdate")
    by_year = (li.groupBy(F.col("l_suppkey").alias("portfolio_id"),
                          F.year("l_shipdate").cast("int").alias("year"))
               .agg(F.sum("l_quantity").cast("double").alias("amt")))
    w = Window.partitionBy("portfolio_id").orderBy("year")
    return by_year.select(
        "portfolio_id", "year",
        F.row_number().over(w).cast("int").alias("t"),
        "amt",
        (F.lit(0.01) * (1 + F.col("year") % 5)).cast("double").alias("rate"),
    )


CASH_FLOWS_SQL = """
SELECT portfolio_id, year,
       CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY year) AS INTEGER) AS t,
       amt,
       CAST(0.01 * (1 + year % 5) AS DOUBLE) AS rate
FROM (SELECT l_suppkey AS portfolio_id, CAST(year(l_shipdate) AS INTEGER) AS year,
             CAST(sum(l_quantity) AS DOUBLE) AS amt
      FROM lineitem GROUP BY 1, 2) s
"""

# ---------------------------------------------------------------------------
# S3 lineage log
# ---------------------------------------------------------------------------


def _tool_name(role, turn):
    return (F.when(role == "system", F.lit(None).cast("string"))
            .when(turn == 0, F.lit(None).cast("string"))
            .when(turn == 1, F.lit(TOOL_CREATE_DATASET))
            .when((role == "assistant") & (turn % 3 == 0), F.lit(TOOL_GLM))
            .when(role == "assistant", F.lit(TOOL_INFERENCE))
            .otherwise(F.lit(TOOL_TREE)))


def lineage_log(spark: SparkSession, sf_dir: str, branching: bool = False) -> DataFrame:
    """Workspace nodes: ``node, parent, conv_id, created, tool_name, args``.

    ``node = conv_id * 100 + turn``; the parent is the previous turn (chains),
    or with ``branching=True`` turn ``floor((turn - 1) / 2)`` (binary trees).
    Turn 0 is the root (NULL parent, no tool).  ``args`` is the JSON list of the
    step's arguments: the node id as text and the whole message text.
    """
    conv = table(spark, sf_dir, "conversations")
    node = F.col("conv_id") * 100 + F.col("turn")
    if branching:
        parent = F.col("conv_id") * 100 + F.floor((F.col("turn") - 1) / 2).cast("bigint")
    else:
        parent = node - 1
    return conv.select(
        node.cast("bigint").alias("node"),
        F.when(F.col("turn") > 0, parent).cast("bigint").alias("parent"),
        F.col("conv_id"),
        F.col("turn").cast("bigint").alias("created"),
        _tool_name(F.col("role"), F.col("turn")).alias("tool_name"),
        F.when(F.col("turn") > 0,
               F.to_json(F.array(node.cast("string"), F.col("text")))).alias("args"),
    )


def _lineage_sql(branching: bool) -> str:
    parent = ("conv_id * 100 + CAST(floor((turn - 1) / 2) AS BIGINT)" if branching
              else "conv_id * 100 + turn - 1")
    return f"""
SELECT CAST(conv_id * 100 + turn AS BIGINT) AS node,
       CAST(CASE WHEN turn > 0 THEN {parent} END AS BIGINT) AS parent,
       conv_id,
       CAST(turn AS BIGINT) AS created,
       CASE WHEN role = 'system' THEN NULL
            WHEN turn = 0 THEN NULL
            WHEN turn = 1 THEN '{TOOL_CREATE_DATASET}'
            WHEN role = 'assistant' AND turn % 3 = 0 THEN '{TOOL_GLM}'
            WHEN role = 'assistant' THEN '{TOOL_INFERENCE}'
            ELSE '{TOOL_TREE}' END AS tool_name
FROM conversations
"""


LINEAGE_SQL = _lineage_sql(False)
LINEAGE_BRANCHING_SQL = _lineage_sql(True)

# ---------------------------------------------------------------------------
# S4 predictions
# ---------------------------------------------------------------------------

# Literal coefficients of the surrogate scored model.
PRED_INTERCEPT = -0.9
PRED_QUANTITY = 0.02
PRED_DISCOUNT = 0.03
PRED_BUILDING = 0.2


def predictions(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """``experience`` plus ``MODEL_PRED`` and the prediction ``file`` name."""
    e = experience(spark, sf_dir, split=split)
    eta = (F.lit(PRED_INTERCEPT) + F.lit(PRED_QUANTITY) * F.col("quantity")
           + F.lit(PRED_DISCOUNT) * F.col("discount_pct")
           + F.when(F.col("c_mktsegment") == "BUILDING", F.lit(PRED_BUILDING)).otherwise(F.lit(0.0)))
    return e.select(
        "*",
        (F.col("expected") * F.exp(eta)).alias("MODEL_PRED"),
        F.concat(F.lit("model_data_"), F.lower("dataset"), F.lit("_preds")).alias("file"),
    )


PREDICTIONS_SQL = f"""
SELECT e.*,
       expected * exp({PRED_INTERCEPT} + {PRED_QUANTITY} * quantity + {PRED_DISCOUNT} * discount_pct
                      + CASE WHEN c_mktsegment = 'BUILDING' THEN {PRED_BUILDING} ELSE 0.0 END) AS MODEL_PRED,
       'model_data_' || lower(dataset) || '_preds' AS file
FROM ({EXPERIENCE_SQL}) e
"""


def with_views(body: str, **views: str) -> str:
    """Prefix an SQL body with ``WITH name AS (...)`` clauses."""
    if not views:
        return body
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in views.items())
    return f"WITH {ctes}\n{body}"
