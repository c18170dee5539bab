"""Registered queries of the models at real width, and of a small lasso checked by SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from expstudy.operators import lasso as L
from expstudy.operators import measures as M
from expstudy.operators.design import Main, build_design, learn_recipe
from expstudy.operators.prepare import assert_positive_exposure
from expstudy.plans import fixtures as X
from expstudy.plans import models as MD
from expstudy.plans import wide as W
from expstudy.plans.registry import register, r6
from expstudy.session import reliable_checkpoint


def prepared(rows, x_vars, terms, defaults, clip):
    """Design cells (checkpointed) and the design of a spec."""
    cells = reliable_checkpoint(M.cells(rows, x_vars, W.OFFSET, W.TARGET))
    assert_positive_exposure(cells, W.OFFSET)
    design = build_design(terms, learn_recipe(cells, x_vars, defaults, clip))
    return reliable_checkpoint(L.design_cells(cells, x_vars, W.OFFSET, W.TARGET, design, is_cells=True)), design


def wide_designs(spark, sf_dir):
    return {"age": prepared(W.wide_experience(spark, sf_dir, "TRAIN"), W.AGE_VARS, W.AGE_SPEC, W.AGE_DEFAULTS, W.AGE_CLIP),
            "crossed": prepared(W.crossed_rows(spark, sf_dir, "TRAIN"), W.CROSSED_VARS, W.CROSSED_SPEC, W.CROSSED_DEFAULTS, W.CROSSED_CLIP)}


@register("wide_design", W.design_sql())
def q_wide_design(spark, sf_dir):
    """MOD-5 .. MOD-8: all design columns of both mortality models, in order, with exposure and event sums."""
    rows = []
    for spec, (dcells, design) in wide_designs(spark, sf_dir).items():
        _, _, events, exposure, _ = L._Jobs(dcells, design).start()
        rows += [(spec, i + 1, n, round(float(exposure[i]), 3) + 0.0, round(float(events[i]), 3) + 0.0) for i, n in enumerate(design.names)]
    return spark.createDataFrame(rows, "spec string, position int, term string, exposure_sum double, event_sum double")


#: Penalties of the registered wide path.
WIDE_LAMBDAS = 20


@register("wide_lasso_path", None)
def q_wide_lasso_path(spark, sf_dir):
    """MOD-9 at the width of the 13-term model: the screened path."""
    dcells, design = prepared(W.crossed_rows(spark, sf_dir, "TRAIN"), W.CROSSED_VARS, W.CROSSED_SPEC, W.CROSSED_DEFAULTS, W.CROSSED_CLIP)
    path = L.fit_lasso_path(dcells.persist(), design, nlambda=WIDE_LAMBDAS)
    path.chosen = L.pick_lambda(path)
    dcells.unpersist()
    return path.path_df(spark)


# ---- a small lasso, solved by SQL ------------------------------------------------

SMALL_VARS = ["quantity", "discount_pct", "obs_year"]
SMALL_LAMBDAS, SMALL_RATIO, SMALL_SWEEPS = 3, 0.01, 60


def _small_sql(body: str) -> str:
    """Proximal Newton steps, one coordinate each, as a recursive query over the cells: ``fit`` has a
    row for each step, ``done`` the last of each penalty, with coefficients b0 .. b3 of the standardised columns.
    The largest penalty, which has all slopes zero, is guarded from rounding."""
    k = len(SMALL_VARS)
    z = ", ".join(f"({v} - avg({v}) OVER ()) / stddev_pop({v}) OVER () AS x{i + 1}" for i, v in enumerate(SMALL_VARS))
    scale = ", ".join(f"avg({v}) AS m{i + 1}, stddev_pop({v}) AS s{i + 1}" for i, v in enumerate(SMALL_VARS))
    eta = "b0 + " + " + ".join(f"b{i} * x{i}" for i in range(1, k + 1))
    own = "CASE j " + " ".join(f"WHEN {i} THEN x{i}" for i in range(1, k + 1)) + " ELSE 1.0 END"
    at = "CASE j " + " ".join(f"WHEN {i} THEN b{i}" for i in range(k + 1)) + " END"
    b = [f"b{i}" for i in range(k + 1)]
    grad = ", ".join(f"abs(sum(x{i} * (y - t * r))) / count(*)" for i in range(1, k + 1))
    steps = SMALL_SWEEPS * (k + 1)
    return X.with_views(f"""
SELECT 1 AS unused""", experience=X.EXPERIENCE_SQL).replace("\nSELECT 1 AS unused", "").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
cells AS (SELECT {', '.join(SMALL_VARS)}, sum(expected) AS t, sum(actual) AS y FROM experience WHERE dataset = 'TRAIN' GROUP BY {', '.join(SMALL_VARS)}),
z AS (SELECT t, y, {z} FROM cells),
scale AS (SELECT {scale} FROM cells),
tot AS (SELECT count(*) AS n, sum(y) / sum(t) AS r, 2 * sum(CASE WHEN y > 0 THEN y * ln(y / t) ELSE 0 END - y * ln(ry / rt) - y + t * ry / rt) AS nulldev
        FROM z, (SELECT sum(y) AS ry, sum(t) AS rt FROM z) q),
top AS (SELECT greatest({grad}) AS lm FROM z, tot),
fit AS (
  SELECT 0 AS step, ln(r) AS b0, {', '.join('CAST(0 AS DOUBLE) AS ' + x for x in b[1:])} FROM tot
  UNION ALL
  SELECT step + 1, {', '.join(f'CASE WHEN j = {i} THEN v ELSE {x} END' for i, x in enumerate(b))}
  FROM (SELECT step, j, {', '.join(b)},
               CASE WHEN j = 0 THEN w / h ELSE sign(w) * greatest(abs(w) - l, 0) / h END AS v
        FROM (SELECT step, j, l, {', '.join(b)}, sum(own * (y - mu)) / any_value(n) + any_value({at}) * sum(mu * own * own) / any_value(n) AS w,
                     sum(mu * own * own) / any_value(n) AS h
              FROM (SELECT *, {own} AS own, t * exp({eta}) AS mu
                    FROM (SELECT fit.*, step % {k + 1} AS j, lm * power({SMALL_RATIO}, (step // {steps}) / {SMALL_LAMBDAS - 1}.0) * CASE WHEN step < {steps} THEN 1 + 1e-9 ELSE 1 END AS l, n
                          FROM fit, top, tot WHERE step < {steps * SMALL_LAMBDAS}) f, z) g
              GROUP BY step, j, l, {', '.join(b)}) s) u),
done AS (SELECT step // {steps} AS lambda_ix, {', '.join(b)} FROM fit WHERE step > 0 AND step % {steps} = 0)
{body}"""


def _small_coefficients_sql() -> str:
    k = len(SMALL_VARS)
    raw = [f"b{i + 1} / s{i + 1}" for i in range(k)]
    rows = [("(Intercept)", "b0 - " + " - ".join(f"{c} * m{i + 1}" for i, c in enumerate(raw)))] + list(zip(SMALL_VARS, raw, strict=True))
    return _small_sql("\nUNION ALL\n".join(
        f"SELECT CAST(lambda_ix AS INTEGER) AS lambda_ix, '{n}' AS term, round({e}, 4) + 0.0 AS estimate FROM done, scale" for n, e in rows))


def _small_path_sql() -> str:
    k = len(SMALL_VARS)
    eta = "b0 + " + " + ".join(f"b{i} * x{i}" for i in range(1, k + 1))
    df = " + ".join(f"CAST(any_value(b{i}) <> 0 AS INTEGER)" for i in range(1, k + 1))
    return _small_sql(f"""SELECT CAST(lambda_ix AS INTEGER) AS lambda_ix, round(any_value(lm) * power({SMALL_RATIO}, (lambda_ix - 1) / {SMALL_LAMBDAS - 1}.0), 6) AS lambda,
       round(1 - 2 * sum(CASE WHEN y > 0 THEN y * ln(y / (t * exp({eta}))) ELSE 0 END - y + t * exp({eta})) / any_value(nulldev), 4) + 0.0 AS dev_ratio, {df} AS df
FROM done, z, top, tot GROUP BY lambda_ix""")


def _small_path(spark, sf_dir):
    dcells, design = prepared(MD.train_rows(spark, sf_dir), SMALL_VARS, [Main(v) for v in SMALL_VARS], None, None)
    return L.fit_lasso_path(dcells.persist(), design, nlambda=SMALL_LAMBDAS, lambda_min_ratio=SMALL_RATIO, tol=1e-13)


@register("lasso_small_coefficients", _small_coefficients_sql())
def q_lasso_small_coefficients(spark, sf_dir):
    """MOD-9, MOD-19: intercept and coefficients at each penalty of a short path."""
    rows = _small_path(spark, sf_dir).coef_df(spark, all_lambdas=True)
    return rows.select("lambda_ix", "term", (F.round("estimate", 4) + F.lit(0.0)).alias("estimate"))


@register("lasso_small_path", _small_path_sql())
def q_lasso_small_path(spark, sf_dir):
    """MOD-9, MOD-24: penalties, deviance ratios and numbers of coefficients of the same path."""
    return _small_path(spark, sf_dir).path_df(spark).select("lambda_ix", r6("lambda"), (F.round("dev_ratio", 4) + F.lit(0.0)).alias("dev_ratio"), "df")
