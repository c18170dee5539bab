"""Readers and writers (SRC-1 .. SRC-4, SRC-8, SNK-1 .. SNK-6, SNK-9).

Formats: tab-separated text in, Parquet in and out, CSV out.  Writers go
through Spark's commit protocol (task output is atomic per job), so a lost
executor re-runs its tasks without leaving partial files behind.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expstudy.schema import EXPERIENCE

# Export settings of the reference (rows per Parquet group, sheet row cap,
# CSV date and timestamp formats), trailing-semicolon and dataset-statement patterns.
ROWS_PER_GROUP = 100_000
SHEET_ROW_CAP = 1_048_576
CSV_DATE_FORMAT = "yyyy-MM-dd"
CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
_TRAILING_SEMIS = re.compile(r";+\s*$", re.MULTILINE)
_SELECT = re.compile(r"(?is)^\s*select\b.*;?\s*$")


def is_select(sql: str) -> bool:
    """SNK-1 statement check: a SELECT (no LIMIT needed)."""
    return bool(_SELECT.match(sql))


def strip_semicolons(sql: str) -> str:
    """STR-7: drop trailing semicolons."""
    return _TRAILING_SEMIS.sub("", sql)


def read_experience(spark: SparkSession, path: str, schema=EXPERIENCE) -> DataFrame:
    """SRC-1: tab-delimited file with a header, columns matched by position to the
    fixed 30-column schema; a malformed row fails the job."""
    return (spark.read.schema(schema).option("sep", "\t").option("header", True)
            .option("mode", "FAILFAST").option("enforceSchema", True).csv(path))


def ingest_experience(spark: SparkSession, src: str, dest: str, partition_by: str = "Observation_Year") -> int:
    """SRC-1 to Parquet partitioned by observation year; returns the row count
    (observed in the same job as the write)."""
    from pyspark.sql import Observation

    obs = Observation("ingest")
    df = read_experience(spark, src).observe(obs, F.count(F.lit(1)).alias("n"))
    # AQE evens the pieces out by year: a task writes few years, a large year gets several files
    df.hint("rebalance", partition_by).write.mode("errorifexists").partitionBy(partition_by).parquet(dest)
    return int(obs.get["n"])


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """SRC-2."""
    return spark.read.parquet(path)


def dataset_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}.parquet"


def try_read(spark: SparkSession, path: str) -> DataFrame | None:
    """Read Parquet at ``path`` through Spark's file system layer, or None when absent.

    Works the same for local, HDFS and object-store paths.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return None
        raise


def _grouped(df: DataFrame):
    """A Parquet writer that bounds the rows of a row group; a file holds many groups."""
    return df.write.mode("errorifexists").option("parquet.block.row.count.limit", str(ROWS_PER_GROUP))


def _refuse_existing(write, path: str, what: str) -> None:
    """Run a writer in ``errorifexists`` mode; an existing target becomes FileExistsError.

    Spark checks the target while planning the write, before any job runs.
    """
    try:
        write(path)
    except AnalysisException as exc:
        if "PATH_ALREADY_EXISTS" in str(exc) or "already exists" in str(exc):
            raise FileExistsError(f"{what} already exists") from exc
        raise


def resolve(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    """SRC-3: the dataset file in the workspace if present, else the catalog table/view."""
    if root is not None:
        df = try_read(spark, dataset_path(root, name))
        if df is not None:
            return df
    return spark.table(name)


def create_dataset(spark: SparkSession, root: str, name: str, sql: str) -> int:
    """SNK-1: run a query, write it as Parquet, refuse to overwrite; return the row count.

    The count comes from an ``Observation`` on the written frame, so the query
    runs once.
    """
    from pyspark.sql import Observation

    if not is_select(sql):
        raise ValueError("a dataset is made from one SELECT statement")
    obs = Observation(f"create_{name}")
    df = spark.sql(strip_semicolons(sql)).observe(obs, F.count(F.lit(1)).alias("n"))
    _refuse_existing(_grouped(df).parquet, dataset_path(root, name), f"dataset {name}")
    return int(obs.get["n"])


def export_parquet(df: DataFrame, path: str) -> str:
    """SNK-2: write a result as Parquet."""
    _grouped(df).parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    """SNK-3: header, ``,`` delimiter, ``"`` quote and escape, NULL as empty, fixed date formats."""
    (df.write.mode("errorifexists").option("header", True).option("sep", ",")
     .option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", '""')
     .option("dateFormat", CSV_DATE_FORMAT).option("timestampFormat", CSV_TIMESTAMP_FORMAT).csv(path))
    return path


def export_capped(df: DataFrame, path: str, cap: int = SHEET_ROW_CAP, fmt: str = "csv", order=None) -> tuple[bool, str]:
    """SNK-4: export at most ``cap`` rows, the first in ``order`` (default: all columns);
    return (truncated, path).

    ``cap + 1`` ordered rows are taken once and kept in the checkpoint folder, so the rows and
    the flag (is there an extra row?) come from one evaluation.
    """
    from expstudy.session import reliable_checkpoint

    keys = list(order or df.columns)
    plus = reliable_checkpoint(df.orderBy(*keys).limit(cap + 1))
    truncated = plus.count() > cap
    (export_csv if fmt == "csv" else export_parquet)(plus.orderBy(*keys).limit(cap), path)
    return truncated, path


def write_factor_tables(long_tables: DataFrame, path: str, overview: DataFrame | None = None) -> str:
    """SNK-5: one output folder per term group (``partitionBy``), named by ``sheet``, and the overview."""
    long_tables.write.mode("errorifexists").partitionBy("sheet").parquet(f"{path}/tables")
    if overview is not None:
        overview.coalesce(1).write.mode("errorifexists").parquet(f"{path}/overview")
    return path


def write_scored(df: DataFrame, root: str, name: str) -> str:
    """SNK-6: refuse if the output exists, then write the scored frame."""
    path = dataset_path(root, name)
    _refuse_existing(_grouped(df).parquet, path, f"dataset {name}")
    return path


def write_run_scores(scores: DataFrame, path: str) -> str:
    """SNK-9: run, file and log-likelihood as CSV."""
    return export_csv(scores, path)


def _named_places(files: DataFrame) -> DataFrame:
    """``files`` (with a ``path``) with ``name``, the dataset folder of a ``part-*`` file or else the file's
    own name, and ``place``, the path of what the name stands for."""
    parts = F.split("path", "/")
    in_folder = F.element_at(parts, -1).startswith("part-")
    return files.select("*", F.when(in_folder, F.element_at(parts, -2)).otherwise(F.element_at(parts, -1)).alias("name"),
                        F.when(in_folder, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.col("path")).alias("place"))


def _below(reader, root: str):
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet"), root


def prediction_files(spark: SparkSession, root: str, must_contain=("preds", "test")) -> DataFrame:
    """SRC-8, the listing: ``(name, place, path)`` of the Parquet files below ``root`` whose name holds every marker.

    A name found in several places stands for the first of them in path order.  Only paths are
    read (one row per file); nothing is collected.
    """
    reader, at = _below(spark.read.format("binaryFile"), root)
    files = _named_places(reader.load(at).select(F.col("_metadata.file_path").alias("path")))
    for m in must_contain:
        files = files.filter(F.col("name").contains(m))
    first = files.groupBy("name").agg(F.min("place").alias("place"))
    return files.join(first, ["name", "place"]).select("name", "place", "path")


def read_prediction_files(spark: SparkSession, root: str, must_contain=("preds", "test"), schema=None) -> DataFrame | None:
    """SRC-8: the rows of the matching prediction files, one place per name, with ``filename`` (file or
    dataset folder) and ``path``; None when no file matches.

    One scan of everything below ``root`` whatever the number of names: each row carries its file's
    path, files of other names are dropped by a filter on it, and the places are chosen by a join.
    The columns are those of ``schema``, or of the first matching file; a file without one of them gives NULL.

    The places are the broadcast side, never the rows: Spark guesses the rows' size from their packed
    files, which may hold millions of like rows in a few MB.  There is one place for each name, less than
    what the file listing keeps on the driver for every file.
    """
    if schema is None:
        first = prediction_files(spark, root, must_contain).orderBy("name", "path").select("path").first()
        if first is None:
            return None
        schema = spark.read.parquet(first["path"]).schema
    reader, at = _below(spark.read.schema(schema), root)
    columns = [F.col(c) for c in (schema.names if hasattr(schema, "names") else spark.createDataFrame([], schema).columns)]
    rows = reader.parquet(at).select(F.struct(*columns).alias("__row"), F.col("_metadata.file_path").alias("path"))
    rows = _named_places(rows)
    for m in must_contain:
        rows = rows.filter(F.col("name").contains(m))
    chosen = prediction_files(spark, root, must_contain).select("name", "place").distinct()
    return rows.join(F.broadcast(chosen), ["name", "place"]).select("__row.*", F.col("name").alias("filename"), "path")
