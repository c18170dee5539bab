"""The lasso at real width: sparse rows, screening, and the path of all columns."""

import numpy as np
import pytest

from conftest import SF001
from expstudy.operators import lasso as L
from expstudy.operators.design import NS, Cross, Interact, Main, Recipe, build_design
from expstudy.operators.sparse_design import SparseRows, dense
from expstudy.plans import registry_wide as RW
from expstudy.plans import wide as W


@pytest.fixture(scope="module")
def crossed(spark):
    return RW.prepared(W.crossed_rows(spark, SF001, "TRAIN"), W.CROSSED_VARS, W.CROSSED_SPEC, W.CROSSED_DEFAULTS, W.CROSSED_CLIP)


def test_designs_have_the_published_width(spark):
    for spec, (_, design) in RW.wide_designs(spark, SF001).items():
        own = W.age_columns() if spec == "age" else W.crossed_columns()
        assert design.names == [n for n, _ in own]
    assert len(W.crossed_columns()) >= 60 and len(W.CROSSED_SPEC) == 13 and len(W.AGE_VARS) == 11


def test_sparse_rows_are_the_design_rows(spark, crossed):
    """The batch expansion against the column expressions that scoring uses."""
    dcells, design = crossed
    x = np.array([r.x for r in L.design_rows(dcells, design).orderBy("x").collect()])
    rows = dcells.drop("T", "Y", "n", "A", "B").toPandas()
    index, value = SparseRows(design)([rows[c].to_numpy() for c in rows.columns])
    p = len(design.names)
    assert index.shape[1] < p / 2
    got = dense(index, value, np.arange(p), p)[:, 1:]
    assert np.allclose(got[np.lexsort(got.T[::-1])], x[np.lexsort(x.T[::-1])], atol=1e-9)


def test_sparse_rows_of_awkward_levels():
    """A value without a level, splines crossed with each other and with numbers, no rows at all."""
    recipe = Recipe(levels={"g": ["F", "M"], "s": ["N", "S", "U"]}, ranges={"a": (20.0, 90.0), "d": (1.0, 20.0)})
    design = build_design([Main("g"), Cross("s", "d"), Interact(NS("a", [65.5, 80], [20, 90]), NS("d", [5], [1, 20])), Interact("g", "s", "d")], recipe)
    rows = SparseRows(design)
    place = {v: i for i, v in enumerate(design.variables)}
    codes = {"g": [0, 1, 2, 1], "s": [0, 1, 2, 3], "a": [20.0, 50.0, 90.0, 66.0], "d": [1.0, 7.5, 20.0, 3.0]}
    index, value = rows([np.array(codes[v]) for v in sorted(place, key=place.get)])
    got = dense(index, value, np.arange(rows.p), rows.p)[:, 1:]
    a, d = (next(c.spline for c in design.terms[-2].components if c.var == v) for v in "ad")
    for i in range(4):
        parts = {"g": recipe.levels["g"] + [None], "s": recipe.levels["s"] + [None]}
        for j, c in enumerate(design.columns):
            want = 1.0
            for comp, part in zip(c.term.components, c.parts, strict=True):
                x = codes[comp.var][i]
                want *= (x if part[0] == "num" else float(parts[comp.var][x] == part[1]) if part[0] == "lvl"
                         else (a if comp.var == "a" else d).evaluate(np.array([x]))[0, part[1]])
            assert np.isclose(got[i, j], want)
    none = rows([np.zeros(0)] * len(place))
    assert none[0].shape[0] == 0 and none[1].shape == none[0].shape


def test_screened_path_is_the_whole_path(crossed):
    dcells, design = crossed
    dcells = dcells.persist()
    screened = L.fit_lasso_path(dcells, design, nlambda=25, lambda_min_ratio=0.02, tol=1e-10)
    whole = L.fit_lasso_path(dcells, design, nlambda=25, lambda_min_ratio=0.02, tol=1e-10, screen=False)
    assert np.allclose(screened.dev_ratio, whole.dev_ratio, atol=1e-6)
    # the levels of the first factor add up to the intercept, so points are compared by what they predict
    x = np.array([r.x for r in L.design_rows(dcells, design).select("x").distinct().collect()])
    link = lambda path: np.array(path.intercepts)[:, None] + np.array(path.coefs) @ x.T
    assert np.allclose(link(screened), link(whole), atol=1e-3)
    active, p = screened.info["active"], len(design.names)
    assert active[0] <= 5 and active == sorted(active) and sum(active) < 0.75 * p * len(active)
    assert len(screened.info["seconds"]) == len(active) and max(active) <= p


def test_gram_has_active_size(crossed, monkeypatch):
    """What a pass sends is one number for each pair of active columns and three for each column."""
    dcells, design = crossed
    sent, summed = [], L._summed
    monkeypatch.setattr(L, "_summed", lambda *a: sent.append(out := summed(*a)) or out)
    jobs = L._Jobs(dcells, design)
    jobs.at(np.zeros(jobs.p), -2.0, np.array([3, 7, 8]))
    assert len(sent[0]) == 4 ** 2 + 1 + 3 * jobs.p + 2


def test_columns_that_the_rule_misses_come_back(crossed, monkeypatch):
    """With a rule that lets nothing in, the check of the gradient alone finds the path's columns."""
    dcells, design = crossed
    path = L.fit_lasso_path(dcells, design, nlambda=8, lambda_min_ratio=0.1, tol=1e-9)
    monkeypatch.setattr(L, "STRONG", 0.0)
    late = L.fit_lasso_path(dcells, design, nlambda=8, lambda_min_ratio=0.1, tol=1e-9)
    assert np.allclose(late.dev_ratio, path.dev_ratio, atol=1e-6)
    assert len(late.info["active"]) > len(path.info["active"]) or late.info["active"] != path.info["active"]


def test_wide_path_conditions(crossed):
    """The optimality conditions at the path's points with numpy on the collected design rows."""
    dcells, design = crossed
    path = L.fit_lasso_path(dcells, design, nlambda=8, tol=1e-10)
    rows = L.design_rows(dcells, design).toPandas()
    x, n, t, y = np.array(rows.x.tolist()), rows.n.to_numpy(), rows["T"].to_numpy(), rows.Y.to_numpy()
    mean = n @ x / n.sum()
    sd = np.sqrt(n @ x ** 2 / n.sum() - mean ** 2)
    for lam, b0, b in zip(path.lambdas, path.intercepts, path.coefs, strict=True):
        mu = t * np.exp(b0 + x @ np.array(b))
        assert abs(mu.sum() / y.sum() - 1) < 1e-4
        grad = (y - mu) @ (x - mean) / (n.sum() * sd)
        on = np.array(b) != 0
        assert (np.abs(grad[~on]) <= lam * (1 + 1e-3) + 1e-6).all()
        assert np.allclose(grad[on], lam * np.sign(np.array(b)[on]), atol=2e-3 * lam + 1e-6)
