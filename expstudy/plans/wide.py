"""The mortality models at real width: surrogate predictors, the two specs, and their SQL.

``wide_experience`` gives the predictors of the experience schema that the models use, derived from
the driver's tables (FIXTURES.md, S5).  ``AGE_SPEC`` has 11 predictors, three of them splines;
``CROSSED_SPEC`` has 13 terms over 6 predictors with spline-factor and factor-factor interactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expstudy.functions.spline import NaturalSpline
from expstudy.operators.design import NS, Interact, Main
from expstudy.plans import fixtures as X

OFFSET, TARGET = "expected", "actual"

#: Lower ends and labels of the surrogate face amount bands.
BANDS = [(0, "00001-09999"), (10_000, "10000-24999"), (25_000, "25000-49999"), (50_000, "50000-99999"), (75_000, "100000-249999")]


def wide_experience(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """One row per lineitem with 11 predictors, ``expected`` and ``actual``; joins as ``fixtures.experience``."""
    li = X.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                                   "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    if split == "TRAIN":
        li = li.filter(F.col("l_shipdate") < F.lit(X.SPLIT_START))
    elif split == "TEST":
        li = li.filter((F.col("l_shipdate") >= F.lit(X.SPLIT_START)) | F.col("l_shipdate").isNull())
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    cust = X.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = li.join(orders.join(cust, orders.o_custkey == cust.c_custkey), F.col("l_orderkey") == F.col("o_orderkey"))
    disc = F.round(F.col("l_discount") * 100).cast("int")
    band = F.lit(None)
    for low, name in BANDS:
        band = F.when(F.col("l_extendedprice") >= low, F.lit(name)).otherwise(band)
    issue_age, duration = F.col("l_quantity").cast("int") + 15, (F.col("l_partkey") % 30).cast("int") + 1
    female = F.col("c_nationkey") % 2 == 1
    smoker = F.when(F.col("l_returnflag") == "R", "Smoker").when(F.col("l_returnflag") == "A", "Unknown").otherwise("NonSmoker")
    actual = F.when(F.col("l_quantity") + disc * 2 + F.when(female, 0).otherwise(4) + F.when(F.col("l_returnflag") == "R", 5).otherwise(0) > 45.5, 1.0)
    return j.select(
        issue_age.alias("Issue_Age"), duration.alias("Duration"), (issue_age + duration - 1).alias("Attained_Age"),
        (F.col("l_linenumber") % 3 + 2).cast("int").alias("Number_Of_Preferred_Classes"),
        F.when(F.col("l_linestatus") == "F", "1").otherwise("0").alias("Preferred_Indicator"),
        (disc % 4 + 1).cast("string").alias("Preferred_Class"), band.alias("Face_Amount_Band"),
        F.when(female, "Female").otherwise("Male").alias("Gender"), smoker.alias("Smoker_Status"),
        F.year("o_orderdate").cast("int").alias("Issue_Year"), F.when(F.col("o_orderstatus") == "P", "ANB").otherwise("ALB").alias("Age_Basis"),
        F.lit(0.25).alias("expected"), actual.otherwise(0.0).alias("actual"),
        F.when(F.col("l_shipdate") < F.lit(X.SPLIT_START), "TRAIN").otherwise("TEST").alias("dataset"))


WIDE_SQL = f"""
SELECT CAST(l_quantity AS INTEGER) + 15 AS Issue_Age, CAST(l_partkey % 30 AS INTEGER) + 1 AS Duration,
       CAST(l_quantity AS INTEGER) + 15 + CAST(l_partkey % 30 AS INTEGER) AS Attained_Age,
       l_linenumber % 3 + 2 AS Number_Of_Preferred_Classes,
       CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS Preferred_Indicator,
       CAST(CAST(round(l_discount * 100) AS INTEGER) % 4 + 1 AS VARCHAR) AS Preferred_Class,
       CASE {' '.join(f"WHEN l_extendedprice >= {low} THEN '{name}'" for low, name in reversed(BANDS))} END AS Face_Amount_Band,
       CASE WHEN c_nationkey % 2 = 1 THEN 'Female' ELSE 'Male' END AS Gender,
       CASE l_returnflag WHEN 'R' THEN 'Smoker' WHEN 'A' THEN 'Unknown' ELSE 'NonSmoker' END AS Smoker_Status,
       CAST(year(o_orderdate) AS INTEGER) AS Issue_Year, CASE WHEN o_orderstatus = 'P' THEN 'ANB' ELSE 'ALB' END AS Age_Basis,
       CAST(0.25 AS DOUBLE) AS expected,
       CAST(CASE WHEN l_quantity + 2 * round(l_discount * 100) + CASE WHEN c_nationkey % 2 = 1 THEN 0 ELSE 4 END
                 + CASE WHEN l_returnflag = 'R' THEN 5 ELSE 0 END > 45.5 THEN 1 ELSE 0 END AS DOUBLE) AS actual,
       CASE WHEN year(l_shipdate) < 1999 THEN 'TRAIN' ELSE 'TEST' END AS dataset
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
"""

# Predictors, splines, default levels and clips of the two models.
AGE_VARS = ["Number_Of_Preferred_Classes", "Preferred_Indicator", "Issue_Age", "Preferred_Class", "Face_Amount_Band", "Gender",
            "Attained_Age", "Duration", "Smoker_Status", "Issue_Year", "Age_Basis"]
AGE_SPEC = [Main(NS("Issue_Age", [25, 45, 65], [0, 97])), Main(NS("Attained_Age", [50, 65, 80], [0, 120])),
            Main(NS("Duration", [1, 5, 10, 20], [1, 95])), *map(Main, ["Number_Of_Preferred_Classes", "Preferred_Indicator",
            "Preferred_Class", "Face_Amount_Band", "Gender", "Smoker_Status", "Issue_Year", "Age_Basis"])]
AGE_DEFAULTS = {"Gender": "Male", "Smoker_Status": "NonSmoker", "Preferred_Class": "1", "Preferred_Indicator": "0",
                "Face_Amount_Band": "100000-249999", "Age_Basis": "ALB"}
AGE_CLIP = {"Issue_Age": (0, 97), "Attained_Age": (0, 120), "Duration": (1, 30), "Issue_Year": (1985, 2018),
            "Number_Of_Preferred_Classes": (0, 4)}
CROSSED_VARS = ["Attained_Age", "Gender", "Smoker_Status", "Preferred_Class", "Face_Amount_Band", "Preferred_Classes"]
_AGES = NS("Attained_Age", [65.5, 80], [20, 90])
CROSSED_SPEC = [*map(Main, [_AGES, *CROSSED_VARS[1:]]), Interact(_AGES, "Face_Amount_Band"), Interact(_AGES, "Preferred_Class"),
                Interact("Gender", "Face_Amount_Band"), Interact("Gender", "Smoker_Status"), Interact("Smoker_Status", "Face_Amount_Band"),
                Interact("Preferred_Class", "Face_Amount_Band"), Interact("Smoker_Status", "Preferred_Class")]
CROSSED_DEFAULTS = {"Gender": "Male", "Smoker_Status": "NonSmoker", "Preferred_Class": "2", "Face_Amount_Band": "100000-249999",
                    "Preferred_Classes": "2"}
CROSSED_CLIP = {"Attained_Age": (20, 90)}


def crossed_rows(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """``wide_experience`` with the number of preferred classes as a factor."""
    return wide_experience(spark, sf_dir, split).withColumn("Preferred_Classes", F.col("Number_Of_Preferred_Classes").cast("string"))


# ---- SQL of the designs, written out term by term --------------------------------

LEVELS = {"Gender": ["Male", "Female"], "Smoker_Status": ["NonSmoker", "Smoker", "Unknown"], "Preferred_Indicator": ["0", "1"],
          "Face_Amount_Band": ["100000-249999", "00001-09999", "10000-24999", "25000-49999", "50000-99999"], "Age_Basis": ["ALB", "ANB"]}


def _level(var: str, levels: list[str]) -> list[tuple[str, str]]:
    return [(f"{var}{x}", f"(CASE WHEN {var} = '{x}' THEN 1.0 ELSE 0.0 END)") for x in levels]


def _spline(var: str, n: int, prefix: str) -> list[tuple[str, str]]:
    return [(f"ns({var}){j + 1}", f"{prefix}{j + 1}") for j in range(n)]


def _crossed(a: list, b: list) -> list[tuple[str, str]]:
    """Products; the first varies fastest."""
    return [(f"{n}:{m}", f"{x} * {y}") for m, y in b for n, x in a]


def age_columns() -> list[tuple[str, str]]:
    """(column, SQL) of AGE_SPEC: the first factor has all levels, the others drop the default."""
    return [*_spline("Issue_Age", 4, "ia"), *_spline("Attained_Age", 4, "aa"), *_spline("Duration", 5, "du"),
            ("Number_Of_Preferred_Classes", "Number_Of_Preferred_Classes"), *_level("Preferred_Indicator", LEVELS["Preferred_Indicator"]),
            *_level("Preferred_Class", ["2", "3", "4"]), *_level("Face_Amount_Band", LEVELS["Face_Amount_Band"][1:]),
            *_level("Gender", ["Female"]), *_level("Smoker_Status", ["Smoker", "Unknown"]), ("Issue_Year", "Issue_Year"),
            *_level("Age_Basis", ["ANB"])]


def crossed_columns() -> list[tuple[str, str]]:
    ages, face, smoker = _spline("Attained_Age", 3, "aa"), _level("Face_Amount_Band", LEVELS["Face_Amount_Band"][1:]), _level(
        "Smoker_Status", ["Smoker", "Unknown"])
    pref, female = _level("Preferred_Class", ["1", "3", "4"]), _level("Gender", ["Female"])
    return [*ages, *_level("Gender", LEVELS["Gender"]), *smoker, *pref, *face, *_level("Preferred_Classes", ["3", "4"]),
            *_crossed(ages, face), *_crossed(ages, pref), *_crossed(female, face), *_crossed(female, smoker), *_crossed(smoker, face),
            *_crossed(pref, face), *_crossed(smoker, pref)]


def spline_sql(spline: NaturalSpline, x: str, prefix: str, source: str) -> str:
    """SELECT x and the basis columns ``<prefix>1`` .. of the distinct values of ``x`` in ``source``, by the
    B-spline recursion, linear beyond the boundary."""
    lo, hi = spline.boundary
    t = [lo] * 4 + sorted(spline.knots) + [hi] * 4

    def basis(i: int, order: int) -> str:
        if order == 1:
            last = f" OR x = {hi}" if t[i] < t[i + 1] == hi else ""
            return f"(CASE WHEN x >= {t[i]} AND x < {t[i + 1]}{last} THEN 1.0 ELSE 0.0 END)" if t[i] < t[i + 1] else "0.0"
        up, down = t[i + order - 1] - t[i], t[i + order] - t[i + 1]
        parts = [f"(x - {t[i]}) / {up} * {basis(i, order - 1)}"] * (up > 0) + [f"({t[i + order]} - x) / {down} * {basis(i + 1, order - 1)}"] * (down > 0)
        return f"({' + '.join(parts)})" if parts else "0.0"

    def slope(i: int) -> str:
        up, down = t[i + 3] - t[i], t[i + 4] - t[i + 1]
        parts = [f"3 * {basis(i, 3)} / {up}"] * (up > 0) + [f"(-3) * {basis(i + 1, 3)} / {down}"] * (down > 0)
        return f"({' + '.join(parts)})" if parts else "0.0"

    proj, n = spline._projection(), len(t) - 4
    cols = ", ".join(f"{basis(i, 4)} AS b{i}, {slope(i)} AS d{i}" for i in range(1, n))
    out = ", ".join(" + ".join(f"CAST({float(proj[i - 1][j])!r} AS DOUBLE) * (b{i} + (v - x) * d{i})" for i in range(1, n)) + f" AS {prefix}{j + 1}"
                    for j in range(spline.n_columns))
    return (f"SELECT v AS {prefix}, {out} FROM (SELECT v, x, {cols} FROM (SELECT v, least(greatest(v, {lo}), {hi}) AS x "
            f"FROM (SELECT DISTINCT CAST({x} AS DOUBLE) AS v FROM {source}) q) c) b")


def _sums(spec: str, columns: list[tuple[str, str]], source: str) -> list[str]:
    return [f"SELECT '{spec}' AS spec, {i + 1} AS position, '{n}' AS term, round(sum({e} * expected), 3) AS exposure_sum, "
            f"round(sum({e} * actual), 3) AS event_sum FROM {source}" for i, (n, e) in enumerate(columns)]


def design_sql() -> str:
    """All columns of both designs with their sums over the TRAIN rows."""
    issue, age, dur = (t.components[0].spline for t in AGE_SPEC[:3])
    views = {"wide": WIDE_SQL,
             "train": "SELECT *, CAST(Number_Of_Preferred_Classes AS VARCHAR) AS Preferred_Classes FROM wide WHERE dataset = 'TRAIN'",
             "s1": spline_sql(issue, "Issue_Age", "ia", "train"), "s2": spline_sql(age, "Attained_Age", "aa", "train"),
             "s3": spline_sql(dur, "Duration", "du", "train"),
             "clipped": "SELECT train.*, least(greatest(Attained_Age, 20), 90) AS age FROM train",
             "s4": spline_sql(_AGES.spline, "age", "aa", "clipped"),
             "rows1": "SELECT * FROM train JOIN s1 ON Issue_Age = ia JOIN s2 ON Attained_Age = aa JOIN s3 ON Duration = du",
             "rows2": "SELECT * FROM clipped JOIN s4 ON age = aa"}
    return X.with_views("\nUNION ALL\n".join(_sums("age", age_columns(), "rows1") + _sums("crossed", crossed_columns(), "rows2")), **views)
