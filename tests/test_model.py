"""Spline, design coding, Poisson tree and lasso: properties and brute-force checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from expstudy.functions.spline import NaturalSpline
from expstudy.operators import lasso as L
from expstudy.operators import measures as M
from expstudy.operators import tree as TR
from expstudy.operators.design import NS, Cross, Interact, Main, Recipe, build_design, learn_recipe
from expstudy.operators.score import GlmModel
from expstudy.plans import fixtures as X
from expstudy.plans import models as MD


# ---------------------------------------------------------------- spline

def test_spline_matches_published_values():
    h = np.arange(58, 73, dtype=float)
    ns = NaturalSpline(tuple(np.quantile(h, [0.2, 0.4, 0.6, 0.8])), (58.0, 72.0))
    row2 = ns.evaluate(h)[1]
    assert np.allclose(row2, [0.00759232, 0, -0.08670223, 0.26010669, -0.17340446], atol=1e-8)


def test_spline_natural_and_linear_outside():
    ns = NaturalSpline((20.0, 35.0), (5.0, 45.0))
    e = 1e-3
    for b in (5.0, 45.0):
        x = np.array([b - 2 * e, b - e, b]) if b == 45.0 else np.array([b, b + e, b + 2 * e])
        v = ns.evaluate(x)
        assert np.allclose((v[0] - 2 * v[1] + v[2]) / e ** 2, 0, atol=1e-3)
    out = ns.evaluate(np.array([0.0, 1.0, 2.0, 50.0, 51.0, 52.0]))
    assert np.allclose(out[1] - out[0], out[2] - out[1])
    assert np.allclose(out[4] - out[3], out[5] - out[4])


def test_spline_columns_match_numpy(spark):
    ns = NaturalSpline((20.0, 35.0), (5.0, 45.0))
    xs = [0.0, 5.0, 12.5, 20.0, 27.0, 35.0, 44.9, 45.0, 60.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = df.select(*ns.columns(F.col("x"))).collect()
    want = ns.evaluate(np.array(xs))
    for i in range(len(xs)):
        assert np.allclose(list(got[i]), want[i], atol=1e-9)
    assert all(v is None for v in got[-1])


# ---------------------------------------------------------------- design

def _recipe():
    return Recipe(levels={"g": ["F", "M"], "s": ["N", "S", "U"]}, ranges={"a": (20.0, 90.0), "d": (1.0, 20.0)})


def test_first_factor_full_other_contrasts():
    d = build_design([Main("g"), Main("s"), Main("a")], _recipe())
    assert d.names == ["gF", "gM", "sS", "sU", "a"]


def test_interaction_coding_rule():
    # gender in, smoker out: gender:smoker keeps all genders and drops the reference smoker level
    d = build_design([Main("g"), Main("a"), Interact("g", "s")], _recipe())
    assert d.names == ["gF", "gM", "a", "gF:sS", "gM:sS", "gF:sU", "gM:sU"]


def test_cross_and_spline_interaction_order():
    d = build_design([NS("a", [65.5, 80], [20, 90]), Cross("g", "d")], _recipe())
    assert d.names[:3] == ["ns(a)1", "ns(a)2", "ns(a)3"]
    assert d.names[3:] == ["gF", "gM", "d", "gM:d"]
    tm = dict((n, g) for n, g, _ in d.term_map())
    assert tm["gM:d"] == "g_X_d" and tm["ns(a)2"] == "a"


def test_learn_recipe_levels_and_clip(spark):
    cells = M.cells(MD.train_rows(spark, SF001), MD.X_VARS, "expected", "actual")
    rec = learn_recipe(cells, MD.X_VARS, {"c_mktsegment": "MACHINERY"}, {"quantity": (5, 45)})
    assert rec.levels["c_mktsegment"][0] == "MACHINERY"
    assert rec.levels["c_mktsegment"][1:] == sorted(rec.levels["c_mktsegment"][1:])
    assert rec.ranges["quantity"] == (5.0, 45.0)
    with pytest.raises(ValueError):
        learn_recipe(cells, MD.X_VARS, {"quantity": "1"})
    with pytest.raises(ValueError):
        learn_recipe(cells, ["c_mktsegment"], max_levels=3)


def test_score_response_link_and_unseen(spark):
    rec = Recipe(levels={"g": ["F", "M"]}, ranges={"a": (20.0, 90.0)})
    model = GlmModel(build_design([Main("g"), Main("a")], rec), -3.0, [0.1, 0.2, 0.01], "o", "y", ["g", "a"])
    df = spark.createDataFrame([("F", 10.0, 2.0), ("M", 95.0, 0.0), ("X", 50.0, 1.0)], "g string, a double, o double")
    r = df.select(model.predict(df).alias("p"), model.predict(df, type="link").alias("l"),
                  model.predict(df, use_offset=False).alias("rate")).collect()
    assert math.isclose(r[0]["p"], 2.0 * math.exp(-3.0 + 0.1 + 0.01 * 20.0))
    assert r[1]["p"] == 0.0 and r[1]["l"] == float("-inf")
    assert math.isclose(r[1]["rate"], math.exp(-3.0 + 0.2 + 0.01 * 90.0))
    assert r[2]["p"] is None
    with pytest.raises(Exception, match="unseen in training"):
        model.score(df).collect()
    assert model.score(df.filter("g <> 'X'")).count() == 2


# ---------------------------------------------------------------- tree

def _cells_np(spark, sf):
    c = M.cells(MD.train_rows(spark, sf), MD.X_VARS, "expected", "actual").collect()
    return c


def _brute_root(cells, var, numeric, min_bucket=7):
    def f(y, t):
        return y * math.log(y / t) if y > 0 and t > 0 else 0.0
    groups = {}
    for r in cells:
        k = r[var]
        g = groups.setdefault(k, [0.0, 0.0, 0])
        g[0] += r["expected"]
        g[1] += r["actual"]
        g[2] += 1
    keys = sorted(groups) if numeric else sorted(groups, key=lambda k: (groups[k][1] / groups[k][0], k))
    T = sum(g[0] for g in groups.values())
    Y = sum(g[1] for g in groups.values())
    N = sum(g[2] for g in groups.values())
    best, lt, ly, ln = None, 0.0, 0.0, 0
    for k in keys[:-1]:
        lt += groups[k][0]
        ly += groups[k][1]
        ln += groups[k][2]
        if ln < min_bucket or N - ln < min_bucket:
            continue
        imp = f(ly, lt) + f(Y - ly, T - lt) - f(Y, T)
        if best is None or imp > best[0] + 1e-12:
            best = (imp, k)
    return best


def test_tree_root_split_brute_force(spark):
    cells = _cells_np(spark, SF001)
    tbl = {r["feature"]: r for r in TR.root_split_table(MD.train_rows(spark, SF001), MD.X_VARS, "expected", "actual").collect()}
    for v, numeric in [("quantity", True), ("discount_pct", True), ("c_mktsegment", False)]:
        imp, _ = _brute_root(cells, v, numeric)
        assert math.isclose(tbl[v]["improve"], imp, rel_tol=1e-9)


def test_tree_leaves_partition_cells_and_deviance_falls(spark):
    train = MD.train_rows(spark, SF001)
    tree = TR.poisson_tree(train, MD.X_VARS, "expected", "actual", max_depth=3, cp=0.0001, min_split=10)
    leaves = tree.leaves_df(spark).collect()
    cells = M.cells(train, MD.X_VARS, "expected", "actual")
    tot = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("y"), F.sum("expected").alias("t")).first()
    assert sum(r["n"] for r in leaves) == tot["n"]
    assert math.isclose(sum(r["events"] for r in leaves), tot["y"])
    assert math.isclose(sum(r["exposure"] for r in leaves), tot["t"])
    # leaf_column assigns every cell to the leaf whose totals the tree reports
    by_leaf = {r["leaf"]: r for r in leaves}
    got = cells.groupBy(tree.leaf_column(cells).alias("leaf")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["leaf"]: r["n"] for r in got} == {k: v["n"] for k, v in by_leaf.items()}
    for k, sp in tree.splits.items():
        kids = tree.nodes[2 * k].deviance + tree.nodes[2 * k + 1].deviance
        assert kids < tree.nodes[k].deviance
        assert tree.nodes[2 * k].rate <= tree.nodes[2 * k + 1].rate + 1e-12


def test_tree_limits():
    with pytest.raises(ValueError):
        TR.check_tree_args(list("abcdef"), 3, 0.01)
    with pytest.raises(ValueError):
        TR.check_tree_args(["a"], 5, 0.01)
    assert TR.check_tree_args(["a"], 3, 0.0) == TR.MIN_CP


def test_snip_keeps_only_shallow_splits(spark):
    tree = TR.poisson_tree(MD.train_rows(spark, SF001), MD.X_VARS, "expected", "actual", max_depth=3, cp=0.0001,
                           min_split=10)
    snipped = tree.snip(1)
    assert all(k == 1 for k in snipped.splits)


# ---------------------------------------------------------------- lasso

@pytest.fixture(scope="module")
def small_fit(spark):
    return L.fit_glm(MD.train_rows(spark, SF001), MD.X_VARS, MD.FITTED_TERMS, "expected", "actual",
                     factor_defaults=MD.FITTED_DEFAULTS, nlambda=20, residual_tree=False, gate=False)


def test_lambda_max_zero_and_path_monotone(small_fit):
    p = small_fit.path
    assert all(v == 0.0 for v in p.coefs[0])
    assert all(a > b for a, b in zip(p.lambdas, p.lambdas[1:]))
    assert all(b >= a - 1e-6 for a, b in zip(p.dev_ratio, p.dev_ratio[1:]))


def test_kkt_and_balance_brute_force(spark, small_fit):
    """Check the optimality conditions with numpy on the collected small cells."""
    rows = small_fit.design_cells.collect()
    X_ = np.array([r["x"] for r in rows])
    T_ = np.array([r["T"] for r in rows])
    Y_ = np.array([r["Y"] for r in rows])
    n_ = np.array([r["n"] for r in rows])
    N = n_.sum()
    mean = (n_[:, None] * X_).sum(0) / N
    sd = np.sqrt(np.maximum((n_[:, None] * X_ ** 2).sum(0) / N - mean ** 2, 0))
    p = small_fit.path
    for k in (3, len(p.lambdas) // 2, len(p.lambdas) - 1):
        b0, b = p.intercepts[k], np.array(p.coefs[k])
        mu = T_ * np.exp(b0 + X_ @ b)
        assert abs(mu.sum() - Y_.sum()) / Y_.sum() < 1e-3
        sd_safe = np.where(sd > 1e-12, sd, 1.0)
        grad = ((X_ - mean) * (Y_ - mu)[:, None]).sum(0) / (N * sd_safe)  # standardised-scale gradient
        lam = p.lambdas[k]
        for j in range(len(b)):
            if sd[j] < 1e-12:
                continue
            if b[j] == 0.0:
                assert abs(grad[j]) <= lam * (1 + 1e-3) + 1e-5
            else:
                assert abs(grad[j] - lam * np.sign(b[j])) <= 1e-3 * lam + 1e-5


def test_pick_lambda_rules():
    path = L.LassoPath(["a", "b"], [1.0, 0.5, 0.25, 0.1], [0.0, 0.5, 0.6, 0.6], [0, 1, 2, 2], [0] * 4,
                       [[0, 0]] * 4, 100.0, 10, 50.0)
    assert L.pick_lambda(path, "AIC") == 2 and L.pick_lambda(path, "BIC") == 2
    tail = np.log([0.5, 0.6, 0.6])
    thr = math.exp(math.log(0.6) - np.std(tail, ddof=1))
    assert L.pick_lambda(path, "1se") == max(i for i, d in enumerate(path.dev_ratio) if d <= thr)
    with pytest.raises(ValueError):
        L.pick_lambda(path, "CV")


def test_smallest_lambda_near_unpenalised_glm(spark):
    """Numeric-only design: the last path point is close to MLlib's unpenalised Poisson fit with offset."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    train = MD.train_rows(spark, SF001)
    terms = [Main("quantity"), Main("discount_pct")]
    fit = L.fit_glm(train, ["quantity", "discount_pct"], terms, "expected", "actual", nlambda=100,
                    residual_tree=False, gate=False)
    cells = M.cells(train, ["quantity", "discount_pct"], "expected", "actual")
    data = VectorAssembler(inputCols=["quantity", "discount_pct"], outputCol="features").transform(
        cells.withColumn("off", F.log("expected")))
    glm = GeneralizedLinearRegression(family="poisson", link="log", offsetCol="off", labelCol="actual",
                                      maxIter=100, regParam=0.0).fit(data)
    k = len(fit.path.lambdas) - 1
    assert np.allclose(fit.path.coefs[k], glm.coefficients.toArray(), atol=5e-3)
    assert abs(fit.path.intercepts[k] - glm.intercept) < 5e-2


def test_model_roundtrip(tmp_path, spark, small_fit):
    from expstudy.operators.score import load_model, save_model

    path = str(tmp_path / "model.json")
    save_model(small_fit.model, path)
    with pytest.raises(FileExistsError):
        save_model(small_fit.model, path)
    m2 = load_model(path)
    df = MD.train_rows(spark, SF001)
    a = df.select(F.sum(small_fit.model.predict(df))).first()[0]
    b = df.select(F.sum(m2.predict(df))).first()[0]
    assert math.isclose(a, b)


def test_factor_tables_reproduce_score(spark, small_fit):
    """exp(intercept + sum of group contributions) equals the prediction at the same values."""
    from expstudy.operators.factors import factor_tables

    model = small_fit.model
    tabs = factor_tables(model, spark)
    rec = model.design.recipe
    seg = rec.levels["c_mktsegment"][1]
    flag = rec.levels["l_returnflag"][-1]
    q, d = 30, 7
    total = model.intercept
    for g, df in tabs.items():
        cond = F.lit(True)
        for v, val in (("c_mktsegment", seg), ("l_returnflag", flag), ("quantity", q), ("discount_pct", d)):
            if v in df.columns:
                cond = cond & (F.col(v) == val)
        total += df.filter(cond).first()["contribution_log"]
    row = spark.createDataFrame([(seg, flag, float(q), float(d), 1.0)],
                                "c_mktsegment string, l_returnflag string, quantity double, discount_pct double, expected double")
    pred = row.select(model.predict(row)).first()[0]
    assert math.isclose(pred, math.exp(total), rel_tol=1e-9)


def test_tree_running_sums_match_plain_windows(spark):
    """The range-partitioned running sums of every level are those of a plain window."""
    from pyspark.sql import Window

    train = MD.train_rows(spark, SF001)
    xs = list(MD.X_VARS)
    cells = TR.prepare_tree_cells(train, xs, "expected", "actual")
    a, b = TR._cell_terms(F.col("__t"), F.col("__y"))
    cells = cells.select(*xs, "__t", "__y", a.alias("__a"), b.alias("__b"), (F.col("quantity") % 3).cast("long").alias("node"))
    numeric = {v: v in ("quantity", "discount_pct") for v in xs}
    stats = TR.level_stats(cells, xs, numeric)
    w = Window.partitionBy("node", "f").orderBy("ord", "sv")
    plain = stats.select("node", "f", "ord", "sv", F.row_number().over(w).alias("p"), F.lead("nv").over(w).alias("n"),
                         F.sum("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    both = TR.level_split_candidates(stats, 7).alias("r").join(plain.alias("q"), ["node", "f", "ord"]).where("r.sv <=> q.sv")
    bad = both.where("p <> pos OR NOT (n <=> next_nv) OR abs(s - ly) > 1e-9")
    assert both.count() == stats.count() and bad.count() == 0


def test_tree_with_missing_predictor_values(spark):
    """Cells with a NULL segment follow the larger side; leaves still partition all cells."""
    dirty = X.experience(spark, SF001, dirty=True).filter(F.col("dataset") == "TRAIN")
    tree = TR.poisson_tree(dirty, MD.X_VARS, "expected", "actual", max_depth=2, cp=0.0001, min_split=10)
    cells = M.cells(dirty, MD.X_VARS, "expected", "actual")
    n_cells = cells.count()
    assert cells.filter(F.col("c_mktsegment").isNull()).count() > 0
    leaves = tree.leaves_df(spark).collect()
    assert sum(r["n"] for r in leaves) == n_cells
    got = cells.groupBy(tree.leaf_column(cells).alias("leaf")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["leaf"]: r["n"] for r in got} == {r["leaf"]: r["n"] for r in leaves}


def test_cells_are_lossless_for_the_poisson_likelihood(spark):
    """Unpenalised Poisson fits with log offset agree on raw rows and on collapsed cells."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    train = MD.train_rows(spark, SF001)
    cells = M.cells(train, ["quantity", "discount_pct"], "expected", "actual")

    def fit(df):
        data = VectorAssembler(inputCols=["quantity", "discount_pct"], outputCol="features").transform(
            df.withColumn("off", F.log("expected")).withColumn("quantity", F.col("quantity").cast("double"))
            .withColumn("discount_pct", F.col("discount_pct").cast("double")))
        m = GeneralizedLinearRegression(family="poisson", link="log", offsetCol="off", labelCol="actual",
                                        maxIter=100, tol=1e-10, regParam=0.0).fit(data)
        return np.concatenate([[m.intercept], m.coefficients.toArray()])

    assert np.allclose(fit(train), fit(cells), atol=1e-6)


def test_weakest_link_pruning_by_hand():
    """g(t) = (R(t) - R(subtree)) / (leaves - 1); cut the weakest while g <= cp * R(root)."""
    nodes = {k: TR.NodeStats(k, 10, 1.0, 1.0, 0.0, 0.0, deviance=d)
             for k, d in {1: 100.0, 2: 40.0, 3: 50.0, 4: 20.0, 5: 19.0, 6: 10.0, 7: 10.0}.items()}
    grown = {k: TR.Split(k, "x", "num", cut=float(k)) for k in (1, 2, 3)}
    # g(2) = 1, g(3) = 30, g(1) = 41/3; at alpha 5 only node 2 goes, then g(1) = 20 > 5
    kept, cpx = TR._prune(nodes, grown, 5.0, 100.0)
    assert sorted(kept) == [1, 3]
    assert math.isclose(cpx[2], 0.01) and math.isclose(cpx[1], 0.20) and math.isclose(cpx[3], 0.30)
    # at alpha 25 node 2 goes first, then the root's g = 20 <= 25 collapses the tree
    kept, _ = TR._prune(nodes, grown, 25.0, 100.0)
    assert kept == {}


def test_fit_guards(spark):
    from expstudy.operators.score import training_gate

    training_gate(1.02)
    training_gate(0.975)
    for bad in (1.031, 0.97, None, 0.0):
        with pytest.raises(ValueError):
            training_gate(bad)
    dirty = X.experience(spark, SF001, dirty=True).filter(F.col("dataset") == "TRAIN")
    with pytest.raises(ValueError, match="zero exposure"):
        L.fit_glm(dirty, ["quantity", "l_linenumber"], [Main("quantity")], "expected", "actual", nlambda=5)


def test_tree_on_many_levels_joins(spark):
    """100,000 levels: sides stay a table, no plan holds their names, rows meet them by a join."""
    n = 100_000
    rows = spark.range(4 * n).select(
        F.concat(F.lit("v"), F.col("id") % n).alias("name"), (F.col("id") % 5).cast("int").alias("k"), F.lit(1.0).alias("e"),
        F.when((F.col("id") % n) % 10 < 3, 1.0).otherwise(0.0).alias("a"))
    tree = TR.poisson_tree(rows, ["name", "k"], "e", "a", max_depth=2, cp=0.0001)
    split = tree.splits[1]
    assert split.feature == "name" and split.left_levels is None and split.n_left_levels == 0.7 * n
    assert split.describe(True) == "name in (70000 levels)"
    leaves = tree.assign_leaves(rows)
    got = {r["leaf"]: (r["n"], r["a"]) for r in leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a")).collect()}
    assert sum(x for x, _ in got.values()) == 4 * n and sum(a for _, a in got.values()) == 1.2 * n
    assert all(a in (0.0, x) for x, a in got.values())
    plan = leaves._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "collect_list" not in plan and " IN (v" not in plan and "INSET" not in plan
    with pytest.raises(ValueError, match="assign_leaves"):
        tree.leaf_column(rows)
    odd = spark.createDataFrame([("never met", 1), (None, 1)], "name string, k int")
    first = {r["name"]: r["leaf"] for r in tree.snip(1).assign_leaves(odd).collect()}
    assert first["never met"] == 3 and first[None] == (2 if split.null_left else 3)


def test_assigned_leaves_are_the_case(spark):
    train = MD.train_rows(spark, SF001)
    tree = TR.poisson_tree(train, MD.X_VARS, "expected", "actual", max_depth=3, cp=0.0001, min_split=10)
    both = tree.assign_leaves(train).withColumn("by_case", tree.leaf_column(train))
    assert both.where("leaf <> by_case").count() == 0 and both.count() == train.count()


# ---------------------------------------------------------------- the predictor's expression

def test_predictor_by_term_equals_the_sum_of_columns_and_compiles(spark):
    """Every kind of term, missing numbers, rows at and beyond the knots; the JVM compiles methods of up to 8,000 bytes."""
    from expstudy.operators.design import Cross, Interact

    rec = Recipe({"g": list("ABCDE"), "h": ["x", "y", "z"]}, {"q": (1.0, 50.0), "d": (0.0, 10.0)})
    ns, other = NS("q", [20, 35], [5, 45]), NS("d", [4], [1, 9])
    rows = [(g, h, q, d, 2.0, 1.0) for g in "ABCDE" for h in "xyz" for q in (None, -3, 1, 5, 17, 20, 35, 45, 49, 80) for d in (None, 0, 4, 11)]
    df = spark.createDataFrame(rows, "g string, h string, q int, d int, t double, y double")
    rng = np.random.default_rng(3)
    for spec in ([Main("g"), Main("h"), ns, Main("d"), Interact("d", "g")], [Main("g"), ns, Interact("d", "g", "q"), Interact(ns, "h")],
                 Cross("q", "d") + [Interact(ns, other), Interact("g", "h"), Interact("g", other, "h")]):
        design = build_design(spec, rec)
        coefs = [0.0 if i % 5 == 4 else float(b) for i, b in enumerate(rng.normal(size=len(design.names)) * 1e-2)]
        model = GlmModel(design, -0.7, coefs, "t", "y", ["g", "h", "q", "d"])
        want = F.lit(-0.7)
        for b, c in zip(coefs, design.basis(df), strict=True):
            want = want + F.lit(b) * c if b else want
        got = df.select(model.eta(df).alias("got"), want.alias("want")).collect()
        assert sum(r["got"] is None for r in got) > 0
        for r in got:
            assert (r["got"] is None) == (r["want"] is None)
            assert r["got"] is None or math.isclose(r["got"], r["want"], rel_tol=1e-12, abs_tol=1e-13)

    model = GlmModel(build_design(MD.FITTED_TERMS, Recipe({"c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "l_returnflag": list("ANR")},
                                                          {"quantity": (1.0, 50.0), "discount_pct": (0.0, 10.0)})), -0.7, [], "expected", "actual", MD.X_VARS)
    model.coefs = [0.01 * (i + 1) for i in range(len(model.design.names))]
    wide = spark.range(8).selectExpr("if(id > 3, 'BUILDING', 'FURNITURE') AS c_mktsegment", "if(id > 5, 'A', 'N') AS l_returnflag", "int(id) AS quantity",
                                     "int(id) AS discount_pct", "0.25D AS expected", "1.0D AS actual")
    plan = model.score(wide)._jdf.queryExecution().executedPlan()
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and 0 < max(sizes) < 8000
