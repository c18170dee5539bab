"""Physical-plan properties that the scale design relies on."""

import contextlib
import io

from conftest import SF001
from expstudy.plans import all_queries
from expstudy.plans import models as MD


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_flagship_pushes_split_and_prunes_columns(spark):
    p = plan(all_queries()["ae_by_segment_cells"][0](spark, SF001))
    assert "LessThan(l_shipdate" in p
    assert "l_extendedprice" not in p and "l_tax" not in p and "o_totalprice" not in p
    assert "partial_sum" in p or "partial_count" in p


def test_cells_use_partial_aggregation(spark):
    p = plan(all_queries()["cells"][0](spark, SF001))
    assert p.count("HashAggregate") >= 2 and "partial_sum" in p


def test_scoring_is_a_projection_without_python(spark):
    model = MD.fixed_model(spark, SF001)
    df = model.score(MD.train_rows(spark, SF001), on_unseen="null")
    p = plan(df)
    for python_node in ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas"):
        assert python_node not in p
    assert "EXP(" in p.upper() and "AS MODEL_PRED" in p.upper()


def test_first_per_key_is_an_aggregate_not_a_window(spark):
    p = plan(all_queries()["first_per_key"][0](spark, SF001))
    assert "Window" not in p and "partial_min" in p


def test_ingested_experience_split_is_partition_pruning(tmp_path, spark):
    """On the real schema the TRAIN filter on Observation_Year prunes partitions."""
    import csv

    from pyspark.sql import functions as F

    from expstudy.operators import prepare as P
    from expstudy.schema import EXPERIENCE
    from expstudy.sources import io as IO

    src = tmp_path / "experience.txt"
    with open(src, "w", newline="") as fh:
        w = csv.writer(fh, delimiter="\t")
        w.writerow([f.name for f in EXPERIENCE.fields])
        for i in range(40):
            w.writerow([str(2010 + i % 8), "ALB", "M", "NS", "Term", "40", "3", "100000-249999", "2005", "43",
                        "", "", "", "S", "1", "2", "1", "1000", "1", "0", "1" if i % 3 == 0 else "0",
                        "0.01", "0.02", "0.3", "0.04", "0", "0", "0", "0", "0"])
    IO.ingest_experience(spark, str(src), str(tmp_path / "pq"))
    df = P.add_split(spark.read.parquet(str(tmp_path / "pq")), "Observation_Year", 2016)
    train = P.take_split_by_year(df, "Observation_Year", 2015)
    p = plan(train.select("Number_Of_Deaths"))
    assert "PartitionFilters: [isnotnull(Observation_Year" in p and "(Observation_Year#" in p
    assert train.count() == 30 and train.agg(F.max("Observation_Year")).first()[0] == 2015


def test_prediction_rows_are_never_the_broadcast_side(tmp_path, spark):
    """Packed files of millions of like rows look small: the chosen places are broadcast, not the rows."""
    from expstudy.sources import io as IO

    one = spark.range(2000).selectExpr("1.0D AS actual", "0.5D AS MODEL_PRED")
    for node in ("a1", "b2"):
        IO.export_parquet(one.coalesce(1), f"{tmp_path}/{node}/run_test_preds.parquet")
    df = IO.read_prediction_files(spark, str(tmp_path))
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [" in x]
    assert "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = IO.read_prediction_files(spark, str(tmp_path))
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [" in x]
        assert "BroadcastHashJoin" in joins[0] and "BuildRight" in joins[0]
        assert df.groupBy("filename").count().collect() == [("run_test_preds.parquet", 2000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
