"""Model specs used by the registered queries.

``FIXED`` is a model with literal coefficients whose recipe (levels, clip
ranges) is still learned from the training split, so its queries read the
whole tables and have an exact SQL oracle.  ``FITTED`` is the spec given to the
distributed lasso.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from expstudy.operators import measures as M
from expstudy.operators.design import NS, Interact, Main, build_design, learn_recipe
from expstudy.operators.score import GlmModel
from expstudy.plans import fixtures as X

X_VARS = ["c_mktsegment", "l_returnflag", "quantity", "discount_pct"]

FIXED_TERMS = [Main("c_mktsegment"), Main("l_returnflag"), Main("quantity"), Main("discount_pct"),
               Interact("l_returnflag", "discount_pct")]
FIXED_DEFAULTS = {"c_mktsegment": "BUILDING"}
FIXED_CLIP = {"quantity": (5, 45)}
# Literal coefficients of the surrogate rating model, by design column.
FIXED_INTERCEPT = -2.0
FIXED_COEFS = {
    "c_mktsegmentBUILDING": -1.0,
    "c_mktsegmentAUTOMOBILE": -1.4,
    "c_mktsegmentFURNITURE": -1.35,
    "c_mktsegmentHOUSEHOLD": -1.3,
    "c_mktsegmentMACHINERY": -1.45,
    "l_returnflagN": 0.05,
    "l_returnflagR": -0.03,
    "quantity": 0.06,
    "discount_pct": 0.1,
    "l_returnflagN:discount_pct": -0.01,
    "l_returnflagR:discount_pct": 0.015,
}

FITTED_TERMS = [Main("c_mktsegment"), Main("l_returnflag"), NS("quantity", [20, 35], [5, 45]),
                Main("discount_pct"), Interact("discount_pct", "c_mktsegment")]
FITTED_DEFAULTS = {"c_mktsegment": "AUTOMOBILE"}

SPLINE = NS("quantity", [20, 35], [5, 45])


def train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.experience(spark, sf_dir, split="TRAIN")


def fixed_model(spark: SparkSession, sf_dir: str) -> GlmModel:
    """Learn the recipe on the training cells (one aggregate job), attach literal coefficients."""
    cells = M.cells(train_rows(spark, sf_dir), X_VARS, "expected", "actual")
    recipe = learn_recipe(cells, X_VARS, FIXED_DEFAULTS, FIXED_CLIP)
    design = build_design(FIXED_TERMS, recipe)
    coefs = [FIXED_COEFS.get(n, 0.0) for n in design.names]
    return GlmModel(design, FIXED_INTERCEPT, coefs, "expected", "actual", X_VARS)


_FITS: dict = {}


def fitted(spark: SparkSession, sf_dir: str, nlambda: int | None = None):
    """The lasso fit on the training split, memoised per session and data folder."""
    from expstudy.operators.lasso import NLAMBDA, fit_glm

    key = (spark.sparkContext.applicationId, sf_dir, nlambda)
    if key not in _FITS:
        _FITS[key] = fit_glm(train_rows(spark, sf_dir), X_VARS, FITTED_TERMS, "expected", "actual",
                             factor_defaults=FITTED_DEFAULTS, nlambda=nlambda or NLAMBDA)
    return _FITS[key]


# ---- SQL fragments of the fixed model for the DuckDB oracle -----------------

FIXED_RANGES_SQL = """
rng AS (SELECT greatest(min(quantity), 5) AS q_lo, least(max(quantity), 45) AS q_hi,
               min(discount_pct) AS d_lo, max(discount_pct) AS d_hi
        FROM experience WHERE dataset = 'TRAIN')"""

Q_BAKED = "CAST(CASE WHEN quantity < q_lo THEN q_lo WHEN quantity > q_hi THEN q_hi ELSE quantity END AS DOUBLE)"
D_BAKED = "CAST(CASE WHEN discount_pct < d_lo THEN d_lo WHEN discount_pct > d_hi THEN d_hi ELSE discount_pct END AS DOUBLE)"


def fixed_columns_sql() -> list[tuple[str, str]]:
    """(design column, SQL expression) pairs of the fixed model over ``experience`` x ``rng``."""
    cols = []
    for lv in ["BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]:
        cols.append((f"c_mktsegment{lv}", f"CASE WHEN c_mktsegment = '{lv}' THEN 1.0 ELSE 0.0 END"))
    for lv in ["N", "R"]:
        cols.append((f"l_returnflag{lv}", f"CASE WHEN l_returnflag = '{lv}' THEN 1.0 ELSE 0.0 END"))
    cols.append(("quantity", Q_BAKED))
    cols.append(("discount_pct", D_BAKED))
    for lv in ["N", "R"]:
        cols.append((f"l_returnflag{lv}:discount_pct",
                     f"(CASE WHEN l_returnflag = '{lv}' THEN 1.0 ELSE 0.0 END) * {D_BAKED}"))
    return cols


def fixed_eta_sql() -> str:
    terms = [f"{FIXED_INTERCEPT}"] + [f"({FIXED_COEFS[n]}) * ({e})" for n, e in fixed_columns_sql()]
    return " + ".join(terms)
