"""Fixed schema of the raw experience table and name resolution helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The 30 columns of the raw mortality experience table, in file order.
_EXPERIENCE_COLUMNS = [
    ("Observation_Year", T.IntegerType()),
    ("Age_Ind", T.StringType()),
    ("Gender", T.StringType()),
    ("Smoker_Status", T.StringType()),
    ("Insurance_Plan", T.StringType()),
    ("Issue_Age", T.DoubleType()),
    ("Duration", T.DoubleType()),
    ("Face_Amount_Band", T.StringType()),
    ("Issue_Year", T.DoubleType()),
    ("Attained_Age", T.DoubleType()),
    ("SOA_Anticipated_Level_Term_Period", T.StringType()),
    ("SOA_Guaranteed_Level_Term_Period", T.StringType()),
    ("SOA_Post_level_Term_Indicator", T.StringType()),
    ("Select_Ultimate_Indicator", T.StringType()),
    ("Preferred_Indicator", T.StringType()),
    ("Number_Of_Preferred_Classes", T.StringType()),
    ("Preferred_Class", T.StringType()),
    ("Amount_Exposed", T.DoubleType()),
    ("Policies_Exposed", T.DoubleType()),
    ("Death_Claim_Amount", T.DoubleType()),
    ("Number_Of_Deaths", T.DoubleType()),
    ("Expected_Death_QX2015VBT_by_Policy", T.DoubleType()),
    ("Expected_Death_QX2015VBT_by_Amount", T.DoubleType()),
    ("ExpDeathQx2015VBTwMI_byPol", T.DoubleType()),
    ("ExpDeathQx2015VBTwMI_byAmt", T.DoubleType()),
    ("Cen2MomP1wMI_Amt", T.DoubleType()),
    ("Cen2MomP2wMI_Amt", T.DoubleType()),
    ("Cen3MomP1wMI_Amt", T.DoubleType()),
    ("Cen3MomP2wMI_Amt", T.DoubleType()),
    ("Cen3MomP3wMI_Amt", T.DoubleType()),
]

EXPERIENCE = T.StructType([T.StructField(n, t, True) for n, t in _EXPERIENCE_COLUMNS])

SPLIT_COLUMN = "DATASET"
TRAIN = "TRAIN"
TEST = "TEST"


def resolve_col(df: DataFrame, name: str) -> str:
    """Return the actual column name in ``df`` matching ``name`` case-insensitively."""
    exact = [c for c in df.columns if c == name]
    if exact:
        return exact[0]
    hits = [c for c in df.columns if c.lower() == name.lower()]
    if len(hits) == 1:
        return hits[0]
    if not hits:
        raise KeyError(f"column {name!r} not found in {df.columns}")
    raise KeyError(f"column {name!r} is ambiguous: {hits}")


def resolve_cols(df: DataFrame, names) -> list[str]:
    return [resolve_col(df, n) for n in names]


def is_string_col(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[resolve_col(df, name)].dataType, T.StringType)


def is_numeric_col(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[resolve_col(df, name)].dataType, T.NumericType)
