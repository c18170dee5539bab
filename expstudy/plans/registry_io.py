"""Registered queries that write through a sink, read the files back and aggregate.

Each run writes below a fresh folder in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expstudy.operators import factors as FT
from expstudy.operators import limits as LM
from expstudy.operators import measures as M
from expstudy.operators import prepare as P
from expstudy.plans import fixtures as X
from expstudy.plans import models as MD
from expstudy.plans.registry import LL_SQL, REGISTRY, r6, register
from expstudy.schema import EXPERIENCE
from expstudy.session import ensure_checkpoint_dir
from expstudy.sources import catalog as CAT
from expstudy.sources import io as IO


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surrogate experience in the raw table's 30 columns."""
    e = X.experience(spark, sf_dir)
    known = {"Observation_Year": "obs_year", "Gender": "l_returnflag", "Insurance_Plan": "c_mktsegment", "Face_Amount_Band": "o_orderpriority",
             "Attained_Age": "quantity", "Duration": "discount_pct", "Number_Of_Deaths": "actual", "ExpDeathQx2015VBTwMI_byPol": "expected"}
    return e.select(*[(F.col(known[f.name]) if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in EXPERIENCE.fields])


@register("ingest_tsv", X.with_views("""
SELECT obs_year AS "Observation_Year", c_mktsegment AS "Insurance_Plan", CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS claims,
       round(sum(CAST(quantity AS DOUBLE)), 6) AS ages, CAST(sum(count(*)) OVER () AS BIGINT) AS n_ingested
FROM experience GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL))
def q_ingest_tsv(spark, sf_dir):
    """SRC-1: tab-separated text into Parquet by year."""
    root = _folder(spark)
    _raw(spark, sf_dir).write.option("sep", "\t").option("header", True).csv(f"{root}/raw")
    n = IO.ingest_experience(spark, f"{root}/raw", f"{root}/experience")
    df = IO.read_dataset(spark, f"{root}/experience")
    return (df.groupBy("Observation_Year", "Insurance_Plan")
            .agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("Number_Of_Deaths")).alias("claims"), r6(F.sum("Attained_Age")).alias("ages"))
            .withColumn("n_ingested", F.lit(n).cast("long")))


_SUMS_SQL = X.with_views("""
SELECT c_mktsegment, dataset, CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual, round(sum(expected), 6) AS expected
FROM experience GROUP BY 1, 2
""", experience=X.EXPERIENCE_SQL)


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy("c_mktsegment", "dataset").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("actual")).alias("actual"),
                                                     r6(F.sum("expected")).alias("expected"))


@register("dataset_round_trip", X.with_views("""
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual, CAST(sum(count(*)) OVER () AS BIGINT) AS n_written
FROM experience WHERE dataset = 'TRAIN' GROUP BY 1
""", experience=X.EXPERIENCE_SQL))
def q_dataset_round_trip(spark, sf_dir):
    """SNK-1 + SRC-3: a dataset made by a SELECT, resolved by name."""
    root, view = _folder(spark), f"experience_{uuid.uuid4().hex}"
    X.experience(spark, sf_dir).createOrReplaceTempView(view)
    try:
        n = IO.create_dataset(spark, root, "train", f"SELECT * FROM {view} WHERE dataset = 'TRAIN';")
    finally:
        spark.catalog.dropTempView(view)
    return (IO.resolve(spark, "train", root).groupBy("c_mktsegment")
            .agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("actual")).alias("actual")).withColumn("n_written", F.lit(n).cast("long")))


@register("parquet_round_trip", _SUMS_SQL)
def q_parquet_round_trip(spark, sf_dir):
    """SNK-2."""
    return _sums(IO.read_dataset(spark, IO.export_parquet(X.experience(spark, sf_dir), f"{_folder(spark)}/out")))


@register("csv_round_trip", _SUMS_SQL)
def q_csv_round_trip(spark, sf_dir):
    """SNK-3."""
    e = X.experience(spark, sf_dir)
    path = IO.export_csv(e, f"{_folder(spark)}/out")
    return _sums(spark.read.schema(e.schema).option("header", True).option("quote", '"').option("escape", '"').csv(path))


@register("scored_round_trip", X.with_views("""
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, round(sum(MODEL_PRED), 4) AS predicted FROM predictions GROUP BY 1
""", predictions=X.PREDICTIONS_SQL))
def q_scored_round_trip(spark, sf_dir):
    """SNK-6."""
    df = IO.read_dataset(spark, IO.write_scored(X.predictions(spark, sf_dir).drop("file"), _folder(spark), "scored"))
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("MODEL_PRED"), 4).alias("predicted"))


@register("prediction_file_scores", X.with_views(
    "SELECT 1 AS run_ix, file || '.parquet' AS filename, round(ll, 4) AS ll, CAST(n_rows AS BIGINT) AS n_rows FROM ll WHERE file LIKE '%test%'",
    predictions=X.PREDICTIONS_SQL, ll=LL_SQL))
def q_prediction_file_scores(spark, sf_dir):
    """SRC-8, WIN-1, AGG-8, SNK-9, WIN-5: scan prediction files, one place per name, log-likelihood per
    file, scores written as CSV and read back.  The root also holds files of other kinds, and the test
    predictions a second time below another node."""
    root = _folder(spark)
    p = X.predictions(spark, sf_dir).persist()
    for node, kind in (("a1", "train"), ("a1", "test"), ("b2", "test")):
        IO.export_parquet(p.filter(F.col("dataset") == kind.upper()).drop("file"), f"{root}/runs/{node}/model_data_{kind}_preds.parquet")
    IO.export_parquet(X.table(spark, sf_dir, "nation"), f"{root}/runs/a0/a_train.parquet")
    p.unpersist()
    ll = M.poisson_loglik(IO.read_prediction_files(spark, f"{root}/runs"), "actual", "MODEL_PRED", by=["filename"])
    path = IO.write_run_scores(ll, f"{root}/scores")
    back = spark.read.schema(ll.schema).option("header", True).csv(path)
    return M.run_index(back, "filename").select("run_ix", "filename", r6("ll", 4), F.col("n_rows").cast("bigint").alias("n_rows"))


EXPORT_CAP = 5_000


@register("export_capped", X.with_views(f"""
SELECT dataset, CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual, CAST(sum(quantity) AS BIGINT) AS quantity,
       (SELECT count(*) FROM experience) > {EXPORT_CAP} AS truncated
FROM (SELECT * FROM experience ORDER BY quantity, discount_pct, obs_year, c_mktsegment, l_returnflag, o_orderpriority, dataset, actual LIMIT {EXPORT_CAP}) q
GROUP BY 1
""", experience=X.EXPERIENCE_SQL))
def q_export_capped(spark, sf_dir):
    """SNK-4: the first rows in a stated order, and whether the cap cut any."""
    order = ["quantity", "discount_pct", "obs_year", "c_mktsegment", "l_returnflag", "o_orderpriority", "dataset", "actual"]
    cut, path = IO.export_capped(X.experience(spark, sf_dir), f"{_folder(spark)}/capped", cap=EXPORT_CAP, fmt="parquet", order=order)
    return (IO.read_dataset(spark, path).groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("n_rows"), r6(F.sum("actual")).alias("actual"), F.sum("quantity").cast("long").alias("quantity"))
            .withColumn("truncated", F.lit(cut)))


@register("factor_export", REGISTRY["factor_table_main"][1])
def q_factor_export(spark, sf_dir):
    """SNK-5: factor tables written by sheet name and read back; the main effects."""
    model = MD.fixed_model(spark, sf_dir)
    path = IO.write_factor_tables(FT.sheets(model, spark), f"{_folder(spark)}/factors", FT.overview(model, spark))
    back = spark.read.schema("term_group string, level_key string, contribution_log double, contribution_multiplier double, sheet string").parquet(f"{path}/tables")
    return (back.filter(~F.col("sheet").contains("_X_"))
            .select("term_group", "level_key", r6("contribution_log"), r6("contribution_multiplier")))


@register("select_columns", "SELECT c_mktsegment, c_custkey, c_nationkey FROM customer")
def q_select_columns(spark, sf_dir):
    """PRJ-1: names resolved in any case, order as asked."""
    return P.select_columns(X.table(spark, sf_dir, "customer"), ["C_MKTSEGMENT", "c_custkey", "C_NationKey"])


@register("view_over_files", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1")
def q_view_over_files(spark, sf_dir):
    """SRC-4: a named view of SQL text over Parquet files."""
    name = f"lines_{uuid.uuid4().hex}"
    df = CAT.register_view(spark, name, f"SELECT l_returnflag, l_quantity FROM parquet.`{sf_dir.rstrip('/')}/lineitem.parquet`")
    out = df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").cast("double").alias("quantity"))
    spark.catalog.dropTempView(name)
    return out


@register("order_and_head", "SELECT c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_name LIMIT 25")
def q_order_and_head(spark, sf_dir):
    """LIM-3, LIM-4, LIM-5: an explicit order, the first rows, some columns."""
    c = X.table(spark, sf_dir, "customer")
    ordered = [F.col("c_acctbal").desc_nulls_last(), F.col("c_name").asc_nulls_last()]
    return LM.pick_columns(LM.head(c, 25, ordered), ["c_name", "c_acctbal"])


@register("claims_without_expected", X.with_views("""
SELECT c_mktsegment, quantity, round(sum(expected), 6) AS expected, round(sum(actual), 6) AS actual
FROM experience GROUP BY 1, 2 HAVING coalesce(sum(expected), 0) = 0 AND coalesce(sum(actual), 0) > 0
""", experience=X.EXPERIENCE_SQL.replace("CAST(0.25 AS DOUBLE)", "CAST(CASE WHEN l_quantity > 40 THEN 0 ELSE 0.25 END AS DOUBLE)")))
def q_claims_without_expected(spark, sf_dir):
    """AGG-9: the cells that have claims but no expected claims."""
    e = X.experience(spark, sf_dir).withColumn("expected", F.when(F.col("quantity") > 40, 0.0).otherwise(F.col("expected")))
    c = M.cells_with_claims_no_expected(M.cells(e, ["c_mktsegment", "quantity"], "expected", "actual"), "expected", "actual")
    return c.select("c_mktsegment", "quantity", r6("expected"), r6("actual"))
