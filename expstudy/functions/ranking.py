"""Row numbers within groups that stay correct and balanced when one group is huge.

``row_number() OVER (PARTITION BY g ORDER BY o)`` sends every row of a group to
one task.  Here the rows are first range-partitioned on ``(g, o)`` (Spark
samples the key distribution, so a group holding a third of the data is spread
over many range partitions) and written, with the number of their piece, to the
reliable checkpoint folder: numbering and piece sizes are two reads of the same
pieces, never of two range exchanges sampled apart.  Rows are numbered inside
each (range partition, group) piece and shifted by the sizes of the group's
earlier pieces.  The offset table has one row per (piece, group): a group spans
at most as many pieces as there are range partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from expstudy.session import reliable_checkpoint


def row_number_within(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "rn",
                      num_partitions: int | None = None) -> DataFrame:
    """``row_number()`` over ``by`` ordered by ``order`` (1-based), skew-safe.

    ``order`` should make rows unique within a group for a deterministic result.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = _pieces(df, list(by) + list(order), n)
    local = tagged.withColumn("__rn", F.row_number().over(Window.partitionBy("__piece", *by).orderBy(*order)))
    sizes = local.groupBy("__piece", *by).agg(F.max("__rn").alias("__size"))
    before = (Window.partitionBy(*by).orderBy("__piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    joined = _join_pieces(local, offsets, by)
    return joined.select(*df.columns, (F.col("__off") + F.col("__rn")).cast("int").alias(out))


def _pieces(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``df`` in ``n`` range pieces, each row with its ``__piece``; materialised once."""
    return reliable_checkpoint(df.repartitionByRange(n, *keys).withColumn("__piece", F.spark_partition_id()))


def _join_pieces(local: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-piece offsets back by (piece, group); NULL group keys match each other."""
    renamed = offsets.withColumnRenamed("__piece", "__piece_r")
    for i, c in enumerate(by):
        renamed = renamed.withColumnRenamed(c, f"__by_r{i}")
    cond = F.col("__piece") == F.col("__piece_r")
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__by_r{i}"))
    return local.join(renamed, cond)


def running_sums_within(df: DataFrame, by: Sequence[str], order: Sequence[str], measures: Sequence[str],
                        next_of: str | None = None, pos: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Running sums (``cum_<m>``), 1-based position and the next row's ``next_of``
    within each group of ``by`` in ``order`` - without one task per group.

    Same piece/offset scheme as ``row_number_within``: range pieces are summed
    locally, shifted by the totals of the group's earlier pieces, and the last
    row of a piece takes its "next" value from the first row of the next piece.
    ``order`` must be unique within a group.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = _pieces(df, list(by) + list(order), n)
    w = Window.partitionBy("__piece", *by).orderBy(*order)
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = [F.row_number().over(w).alias("__rn")] + [F.sum(m).over(wr).alias(f"__c_{m}") for m in measures]
    if next_of:
        cols.append(F.lead(next_of).over(w).alias("__next"))
    local = tagged.select("*", *cols)
    piece_aggs = [F.max("__rn").alias("__size")] + [F.sum(m).alias(f"__p_{m}") for m in measures]
    if next_of:
        piece_aggs.append(F.min_by(next_of, F.struct(*order)).alias("__first"))
    pieces = local.groupBy("__piece", *by).agg(*piece_aggs)
    wp = Window.partitionBy(*by).orderBy("__piece")
    before = wp.rowsBetween(Window.unboundedPreceding, -1)
    off_cols = [F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__o_rows")]
    off_cols += [F.coalesce(F.sum(f"__p_{m}").over(before), F.lit(0)).alias(f"__o_{m}") for m in measures]
    if next_of:
        off_cols.append(F.lead("__first").over(wp).alias("__next_piece"))
    offsets = pieces.select("__piece", *by, *off_cols)
    out = list(df.columns)
    out.append((F.col("__o_rows") + F.col("__rn")).cast("int").alias(pos))
    out += [(F.col(f"__o_{m}") + F.col(f"__c_{m}")).alias(f"cum_{m}") for m in measures]
    if next_of:
        out.append(F.coalesce(F.col("__next"), F.col("__next_piece")).alias(f"next_{next_of}"))
    return _join_pieces(local, offsets, by).select(*out)


def running_products_within(df: DataFrame, by: Sequence[str], order: Sequence[str], factor: str, out: str,
                            num_partitions: int | None = None) -> DataFrame:
    """Running product ``out`` of ``factor`` within each group of ``by`` in ``order`` (unique within a group).

    The product is associative, so the same scheme as for sums holds: each range piece multiplies its
    own rows and takes the product of the group's earlier pieces as its start.  Zeros, infinities
    and negative factors go through as in one long product.
    """
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = _pieces(df, list(by) + list(order), n)
    w = Window.partitionBy("__piece", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = tagged.withColumn("__own", F.product(F.col(factor)).over(w))
    whole = tagged.groupBy("__piece", *by).agg(F.product(F.col(factor)).alias("__whole"))
    before = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.withColumn("__start", F.coalesce(F.product(F.col("__whole")).over(before), F.lit(1.0))).drop("__whole")
    return _join_pieces(local, starts, by).select(*df.columns, (F.col("__start") * F.col("__own")).alias(out))
