"""Skew-safe numbering equals a plain window, well above the sample sizes of range partitioning."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from expstudy.functions.ranking import row_number_within, running_sums_within

ROWS = 600_000


def _frame(spark):
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    return spark.range(0, ROWS, 1, 16).select(
        F.when(F.col("id") % 1001 == 0, F.lit(None)).otherwise(g).alias("g"), F.xxhash64("id").alias("o"), F.col("id"),
        (F.col("id") % 10).cast("double").alias("v"), F.repeat(F.lit("payload "), 8).alias("pay"), F.rand(7).alias("r"))


def test_row_numbers_equal_a_plain_window(spark):
    df = row_number_within(_frame(spark), ["g"], ["o", "id"], num_partitions=16)
    plain = F.row_number().over(Window.partitionBy("g").orderBy("o", "id"))
    got = df.withColumn("plain", plain).agg(F.count("*").alias("n"), F.count_if(F.col("rn") != F.col("plain")).alias("bad"),
                                            F.max(F.length("pay")).alias("pay"), F.max("r")).first()
    assert (got["n"], got["bad"]) == (ROWS, 0)


def test_running_sums_equal_a_plain_window(spark):
    df = running_sums_within(_frame(spark), ["g"], ["o", "id"], ["v"], next_of="o", num_partitions=16)
    w = Window.partitionBy("g").orderBy("o", "id")
    got = (df.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("p", F.row_number().over(w)).withColumn("nx", F.lead("o").over(w))
           .agg(F.count("*").alias("n"), F.count_if(F.col("s") != F.col("cum_v")).alias("sums"), F.count_if(F.col("p") != F.col("pos")).alias("pos"),
                F.count_if(~F.col("nx").eqNullSafe(F.col("next_o"))).alias("nexts"), F.max("r"), F.max("pay")).first())
    assert (got["n"], got["sums"], got["pos"], got["nexts"]) == (ROWS, 0, 0, 0)
