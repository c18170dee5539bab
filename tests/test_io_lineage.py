"""Sources, sinks, catalog, bounded queries, lineage and streaming scoring."""

import csv
import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from expstudy.functions.expr import log_factorial, poisson_logpmf
from expstudy.operators import factors as FT
from expstudy.operators import limits as LM
from expstudy.operators import lineage as LN
from expstudy.operators import measures as M
from expstudy.plans import fixtures as X
from expstudy.plans import models as MD
from expstudy.schema import EXPERIENCE
from expstudy.sources import catalog as CAT
from expstudy.sources import io as IO


# ---------------------------------------------------------------- sources

def _tsv_rows(n=20):
    rows = []
    for i in range(n):
        r = [str(2010 + i % 8), "ALB", "M" if i % 2 else "F", "UNKNOWN" if i == 3 else "NS", "Term",
             str(30 + i), str(1 + i % 5), "100000-249999", str(2000 + i), str(31 + i), "", "", "", "S",
             "1", "2", "1", "0" if i == 5 else "1000.5", "0" if i == 5 else "1.5", "0", str(i % 2),
             "0.01", "0.02", "0.03", "0.04", "0", "0", "0", "0", "0"]
        if i == 7:
            r[2] = ""
        rows.append(r)
    return rows


def test_read_experience_tsv(tmp_path, spark):
    p = tmp_path / "experience.txt"
    with open(p, "w", newline="") as fh:
        w = csv.writer(fh, delimiter="\t")
        w.writerow([f.name for f in EXPERIENCE.fields])
        w.writerows(_tsv_rows())
    df = IO.read_experience(spark, str(p))
    rows = df.collect()
    assert len(rows) == 20 and df.schema == EXPERIENCE
    assert rows[7]["Gender"] is None and rows[3]["Smoker_Status"] == "UNKNOWN"
    assert rows[5]["Policies_Exposed"] == 0.0
    n = IO.ingest_experience(spark, str(p), str(tmp_path / "pq"))
    assert n == 20
    assert spark.read.parquet(str(tmp_path / "pq")).filter("Observation_Year = 2011").count() == 3


def test_read_experience_bad_row_fails(tmp_path, spark):
    p = tmp_path / "bad.txt"
    rows = _tsv_rows(3)
    rows[1][0] = "not-a-year"
    with open(p, "w", newline="") as fh:
        w = csv.writer(fh, delimiter="\t")
        w.writerow([f.name for f in EXPERIENCE.fields])
        w.writerows(rows)
    with pytest.raises(Exception):
        IO.read_experience(spark, str(p)).collect()


def test_create_dataset_and_resolve(tmp_path, spark):
    X.experience(spark, SF001).createOrReplaceTempView("exp_view")
    n = IO.create_dataset(spark, str(tmp_path), "train_ds", "SELECT * FROM exp_view WHERE dataset = 'TRAIN';")
    assert n == X.experience(spark, SF001).filter("dataset = 'TRAIN'").count()
    with pytest.raises(FileExistsError):
        IO.create_dataset(spark, str(tmp_path), "train_ds", "SELECT 1")
    with pytest.raises(ValueError):
        IO.create_dataset(spark, str(tmp_path), "other_ds", "DROP VIEW exp_view")
    assert IO.resolve(spark, "train_ds", str(tmp_path)).count() == n
    assert IO.resolve(spark, "exp_view", str(tmp_path)).count() > n


def test_export_csv_format(tmp_path, spark):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "x", "y")], "id int, s string, t string").withColumn(
        "ts", F.to_timestamp(F.lit("2020-01-02 03:04:05"))).withColumn("d", F.to_date(F.lit("2020-01-02")))
    out = IO.export_csv(df.coalesce(1), str(tmp_path / "csv"))
    text = open(glob.glob(os.path.join(out, "part-*.csv"))[0]).read().splitlines()
    assert text[0] == "id,s,t,ts,d"
    assert text[1] == '1,"a ""q"", b",,2020-01-02 03:04:05,2020-01-02'


def test_export_capped(tmp_path, spark):
    df = spark.range(50)
    t, path = IO.export_capped(df, str(tmp_path / "cap"), cap=10, fmt="parquet")
    assert t and spark.read.parquet(path).count() == 10
    t2, _ = IO.export_capped(df, str(tmp_path / "cap2"), cap=100, fmt="parquet")
    assert not t2


def test_catalog_view_text(spark):
    spark.sql("CREATE OR REPLACE VIEW cat_kept AS SELECT 2 AS z")
    try:
        assert CAT.view_definition(spark, "cat_kept") == "SELECT 2 AS z"
    finally:
        spark.sql("DROP VIEW cat_kept")


def test_prediction_files(tmp_path, spark):
    pred = X.predictions(spark, SF001)
    runs = tmp_path / "runs"
    X.table(spark, SF001, "nation").write.parquet(str(runs / "a0" / "a_train.parquet"))  # another schema, read first by name
    for node in ("r1", "r2"):  # the same file below two nodes counts once
        for name in ("model_data_test_preds", "model_data_train_preds", "other_test"):
            pred.filter(F.col("file") == name).write.parquet(str(runs / node / f"{name}.parquet"))
    assert {r["name"] for r in IO.prediction_files(spark, str(runs)).collect()} == {"model_data_test_preds.parquet"}
    df = IO.read_prediction_files(spark, str(runs))
    assert {("/r1/" in r["path"]) for r in df.select("path").distinct().collect()} == {True}
    ll = M.poisson_loglik(df, "actual", "MODEL_PRED", by=["filename"]).first()
    want = M.poisson_loglik(pred.filter(F.col("file") == "model_data_test_preds"), "actual", "MODEL_PRED").first()
    assert ll["n_rows"] == want["n_rows"] and math.isclose(ll["ll"], want["ll"], rel_tol=1e-9)
    assert IO.read_prediction_files(spark, str(runs), ("nothing",)) is None


def test_row_groups_are_bounded_not_files(tmp_path, spark):
    import pyarrow.parquet as pq

    path = IO.export_parquet(spark.range(0, 250_000, 1, 1), str(tmp_path / "big"))
    files = glob.glob(os.path.join(path, "part-*.parquet"))
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert len(files) == 1
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= IO.ROWS_PER_GROUP + 10_000


def _chain(n: int, name: str = "c") -> list:
    return [(f"{name}{i}", f"{name}{i - 1}" if i else None) for i in range(n)]


@pytest.mark.parametrize("n,fits", [(999, True), (1000, False), (1011, False)])
def test_lineage_depth_cap(spark, n, fits):
    nodes = spark.createDataFrame(_chain(n), "node string, parent string")
    leaf = nodes.filter(F.col("node") == f"c{n - 1}")
    if fits:
        assert LN.root_depth(nodes).agg(F.max("depth")).first()[0] == n - 1
        assert LN.branches(nodes, leaf).count() == n
    else:
        for call in (lambda: LN.root_depth(nodes), lambda: LN.branches(nodes, leaf)):
            with pytest.raises(ValueError, match="nodes"):
                call()


def test_lineage_dangling_cycle_and_unrelated_chain(spark):
    rows = [("a", None), ("b", "a"), ("x", "gone"), ("y", "x"), ("p", "q"), ("q", "p"), *_chain(1005, "deep")]
    nodes = spark.createDataFrame(rows, "node string, parent string")
    assert {tuple(r) for r in LN.branches(nodes, nodes.filter("node = 'b'")).collect()} == {("b", "b", 0), ("b", "a", 1)}
    with pytest.raises(ValueError, match="not in the log"):
        LN.branches(nodes, nodes.filter("node = 'y'"))
    with pytest.raises(ValueError, match="circle"):
        LN.branches(nodes, nodes.filter("node = 'p'"))
    with pytest.raises(ValueError, match="not in the log"):
        LN.root_depth(nodes.filter("node IN ('a', 'b', 'x', 'y')"))


def test_names_like_naming_row_by_row(spark):
    names = [f"A_{i}" for i in range(1, 56)] + ["A", "A", "B", "B_1", "B", "B_1", "B" * 40, "B" * 35, "x/y", "x_y"]
    got = FT.safe_names(spark.createDataFrame(list(enumerate(names)), "ix long, raw string"), "raw", "ix").orderBy("ix").collect()
    seen: list[str] = []
    for n in names:  # one row after another, the first free suffix
        base = n.replace("/", "_")[:31]
        k, name = 0, base
        while name in seen:
            k += 1
            name = base[:31 - len(f"_{k}")] + f"_{k}"
        seen.append(name)
    assert [r["safe_name"] for r in got] == seen and seen[56] == "A_56"


def test_study_refuses_a_name_on_the_chain(tmp_path, spark):
    from expstudy.study import Study

    st = Study(spark, str(tmp_path / "study"))
    root = st.start()
    n1, _ = st.create_dataset(root, "train", "SELECT 1 AS x")
    with pytest.raises(FileExistsError, match="branch"):
        st.create_dataset(n1, "train", "SELECT 2 AS x")
    n2, _ = st.create_dataset(root, "train", "SELECT 3 AS x")  # another branch may use the name
    assert st.resolve(n2, "train").first()[0] == 3 and st.resolve(n1, "train").first()[0] == 1


def test_failed_fit_is_no_model(tmp_path, spark):
    log = LN.StudyLog(spark, str(tmp_path / "log"))
    root = log.start()
    bad = log.step(root, X.TOOL_GLM, ["train"], success=False)
    with pytest.raises(ValueError, match="fitted model"):
        log.finalize(bad)
    good = log.step(bad, X.TOOL_GLM, ["train"])
    log.finalize(good)


def test_catalog(spark):
    CAT.register_view(spark, "cat_v1", "SELECT 1 AS a, 'x' AS b")
    CAT.register_view(spark, "cat_v2", spark.range(3))
    assert {"cat_v1", "cat_v2"} <= set(CAT.list_views(spark))
    assert CAT.view_definition(spark, "CAT_V1") == "SELECT 1 AS a, 'x' AS b"
    with pytest.raises(ValueError, match="no SQL text"):
        CAT.view_definition(spark, "cat_v2")
    rows = CAT.table_schema(spark, "cat_v1").collect()
    assert [(r[0], r[1]) for r in rows] == [("a", "INT"), ("b", "STRING")]
    with pytest.raises(ValueError):
        CAT.table_schema(spark, "bad name;")


# ---------------------------------------------------------------- limits

def test_bounded_query(spark):
    spark.range(2000).createOrReplaceTempView("nums")
    assert not LM.is_bounded_select("SELECT * FROM nums")
    assert not LM.is_bounded_select("SELECT 1 LIMIT 1; DROP TABLE x LIMIT 1")
    r = LM.bounded_query(spark, "select id from nums order by id limit 1500;")
    assert r.success and len(r.rows) == 1000 and r.truncated
    r2 = LM.bounded_query(spark, "SELECT id FROM nums LIMIT 10 OFFSET 5")
    assert r2.success and len(r2.rows) == 10 and not r2.truncated
    bad = LM.bounded_query(spark, "SELECT nope FROM nums LIMIT 3")
    assert not bad.success and bad.message
    p = LM.preview(spark, "SELECT id FROM nums", limit=-1)
    assert len(list(p.rows)) == 2000 and not p.truncated
    assert LM.last_index_where(spark.range(10), "id", F.col("id") % 4 == 1) == 9


# ---------------------------------------------------------------- measures

def test_present_value_constant_rate_is_annuity(spark):
    cf = spark.createDataFrame([(1, t, 100.0, 0.05) for t in range(1, 31)], "portfolio_id int, t int, amt double, rate double")
    pv = M.present_value(cf).first()["pv"]
    assert math.isclose(pv, 100.0 * (1 - 1.05 ** -30) / 0.05, rel_tol=1e-12)


def test_poisson_logpmf_edges(spark):
    rows = [(0.0, 2.0), (3.0, 2.5), (25.0, 20.0), (1.0, 0.0), (0.0, 0.0), (1.5, 2.0), (2.0, -1.0)]
    df = spark.createDataFrame(rows, "y double, mu double")
    got = [r[0] for r in df.select(poisson_logpmf("y", "mu")).collect()]
    assert math.isclose(got[0], -2.0)
    assert math.isclose(got[1], 3 * math.log(2.5) - 2.5 - math.lgamma(4), rel_tol=1e-12)
    assert math.isclose(got[2], 25 * math.log(20) - 20 - math.lgamma(26), rel_tol=1e-12)
    assert got[3] == float("-inf") and got[4] == 0.0 and got[5] == float("-inf") and math.isnan(got[6])
    lf = [r[0] for r in spark.range(0, 60).select(log_factorial(F.col("id"))).collect()]
    assert all(math.isclose(v, math.lgamma(i + 1), abs_tol=1e-10) for i, v in enumerate(lf))


# ---------------------------------------------------------------- lineage

def _walk(rows):
    parent = {r["node"]: r["parent"] for r in rows}
    out = {}
    for n in parent:
        d, c = 0, n
        while parent[c] is not None:
            c, d = parent[c], d + 1
        out[n] = (c, d)
    return out


def test_root_depth_and_branches_match_python(spark):
    log = X.lineage_log(spark, SF001, branching=True)
    rows = log.select("node", "parent").collect()
    want = _walk(rows)
    got = {r["node"]: (r["root"], r["depth"]) for r in LN.root_depth(log).collect()}
    assert got == want
    leaves = log.groupBy("conv_id").agg(F.max("node").alias("node"))
    br = LN.branches(log, leaves).collect()
    parent = {r["node"]: r["parent"] for r in rows}
    for leaf in {r["leaf"] for r in br}:
        path = sorted((r["pos"], r["node"]) for r in br if r["leaf"] == leaf)
        c, expect = leaf, []
        while c is not None:
            expect.append(c)
            c = parent[c]
        assert [n for _, n in path] == expect


def test_deep_chain_and_errors(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "node long, parent long")
    rd = {r["node"]: r["depth"] for r in LN.root_depth(chain).collect()}
    assert rd[299] == 299
    with pytest.raises(ValueError):
        LN.root_depth(chain, max_depth=100)
    broken = spark.createDataFrame([(1, None), (2, 7)], "node long, parent long")
    with pytest.raises(ValueError):
        LN.root_depth(broken)
    with pytest.raises(ValueError):
        LN.tree_of(chain, 5)
    assert LN.tree_of(chain, 0).count() == 300


def test_parse_pointers(spark):
    df = spark.createDataFrame([("root",), ('"a1"->"b2"',)], "pointer string")
    assert [tuple(r) for r in LN.parse_pointers(df).collect()] == [("b2", "a1")]
    bad = spark.createDataFrame([("a->b",)], "pointer string")
    with pytest.raises(ValueError):
        LN.parse_pointers(bad)


def test_study_log_guards(tmp_path, spark):
    log = LN.StudyLog(spark, str(tmp_path / "log"))
    root = log.start()
    ds = log.step(root, X.TOOL_CREATE_DATASET, ["train", "SELECT 1"])
    fit = log.step(ds, X.TOOL_GLM, ["train"])
    with pytest.raises(ValueError):
        log.step(fit, X.TOOL_GLM, ["train"])
    side = log.step(ds, X.TOOL_TREE, ["train"])
    with pytest.raises(ValueError):
        log.finalize(side)
    log.finalize(fit)
    with pytest.raises(ValueError):
        log.step(fit, X.TOOL_INFERENCE, ["test", "scored"])
    log.log_query("count", "SELECT count(*) FROM t LIMIT 1", True)
    assert log.queries().count() == 1
    steps = log.steps().select("node", "parent", "tool_name", "args")
    cls = LN.classify_steps(LN.branches(steps, steps.filter(F.col("node") == fit)).join(
        LN.fill_missing_steps(steps).select("node", "tool_name"), "node"))
    phases = {r["tool_name"]: r["phase"] for r in cls.collect() if r["tool_name"]}
    assert phases == {X.TOOL_CREATE_DATASET: "datasets", X.TOOL_GLM: "model"}


# ---------------------------------------------------------------- streaming

def test_streaming_scoring_matches_batch(tmp_path, spark):
    from expstudy.streaming.scoring import run_scoring_stream, score_stream

    model = MD.fixed_model(spark, SF001)
    src = X.experience(spark, SF001)
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = score_stream(spark, model, str(tmp_path / "in"), src.schema)
    q = run_scoring_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("MODEL_PRED")).first()[0]
    want = model.score(src).agg(F.sum("MODEL_PRED")).first()[0]
    assert math.isclose(got, want, rel_tol=1e-12)


def test_model_outputs_written(tmp_path, spark):
    from expstudy.operators.design import validate_model_view
    from expstudy.operators.factors import coefficient_table, overview, sheets, term_map_df

    model = MD.fixed_model(spark, SF001)
    out = IO.write_factor_tables(sheets(model, spark), str(tmp_path / "factors"), overview(model, spark))
    back = spark.read.parquet(f"{out}/tables")
    assert {tuple(r) for r in back.select("term_group", "sheet").distinct().collect()} == \
           {(g, g[:31].replace(":", "_")) for _, g, _ in model.design.term_map()}
    assert spark.read.parquet(f"{out}/overview").count() == 3
    scored = model.score(X.experience(spark, SF001))
    IO.write_scored(scored, str(tmp_path), "scored")
    with pytest.raises(FileExistsError):
        IO.write_scored(scored, str(tmp_path), "scored")
    ll = M.poisson_loglik(scored.withColumn("file", F.lit("run1")), "actual", "MODEL_PRED", by=["file"])
    IO.write_run_scores(ll.coalesce(1), str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).columns == ["file", "ll", "n_rows"]
    assert coefficient_table(model, spark).count() == len(model.design.names) + 1
    assert term_map_df(model, spark).count() == len(model.design.names)
    assert overview(model, spark).count() == 3
    assert model.design.terms_by_variable()["discount_pct"] == ["discount_pct", "l_returnflag:discount_pct"]
    preds = validate_model_view(X.experience(spark, SF001), "actual", "EXPECTED", split_col="dataset")
    assert "actual" not in preds and "expected" not in preds and "quantity" in preds
    with pytest.raises(ValueError):
        validate_model_view(X.experience(spark, SF001), "actual", "actual", split_col="dataset")


def test_order_by_nulls(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert [r[0] for r in LM.order_by(df, ["x"], nulls="last").collect()] == [1, 3, None]
    assert [r[0] for r in LM.order_by(df, ["x"], descending=True, nulls="first").collect()] == [None, 3, 1]


# The 30-period cash flow of the reference's present-value example
# (t, amount, one-year rate at t) and its exact present value.
PV_EXAMPLE = """
1,900,0.05
2,944,0.04
3,580,0.03
4,946,0.05
5,689,0.01
6,996,0.01
7,850,0.05
8,796,0.01
9,919,0.03
10,652,0.03
11,881,0.03
12,767,0.05
13,689,0.05
14,864,0.03
15,844,0.02
16,987,0.02
17,762,0.04
18,937,0.01
19,816,0.04
20,538,0.02
21,516,0.01
22,592,0.05
23,799,0.05
24,814,0.02
25,555,0.01
26,997,0.04
27,528,0.01
28,673,0.01
29,699,0.01
30,978,0.04"""
PV_EXAMPLE_VALUE = 15259.867327641188


def test_present_value_reference_example(spark):
    rows = [(1, int(t), float(a), float(r)) for t, a, r in (ln.split(",") for ln in PV_EXAMPLE.strip().splitlines())]
    cf = spark.createDataFrame(rows, "portfolio_id int, t int, amt double, rate double")
    pv = M.present_value(cf).first()["pv"]
    assert math.isclose(pv, PV_EXAMPLE_VALUE, rel_tol=1e-12)


# The 20 recorded present-value answers of the reference, in file order.
PV_ANSWERS = [15241.68, 15256.94, 15252.649959611723, 15258.16, 15251.52, 15260.29, 15255.93,
              15257.524024142856, 15251.323715, 15258.2016860718, 15254.587839428572, 15258.85, 15252.43,
              15254.43, 15265.91, 15234.3, 15259.86, 15243.48, 15256.22, 15251.655042142856]


def test_spread_of_recorded_answers(spark):
    df = spark.createDataFrame([(v,) for v in PV_ANSWERS], "pv double")
    r = M.spread(df, "pv").first()
    assert r["n"] == 20 and r["min"] == 15234.3 and r["max"] == 15265.91
    assert round(r["mean"], 3) == 15253.797 and round(r["sd_pop"], 3) == 6.990


def test_study_workflow(tmp_path, spark):
    from expstudy.operators.design import Main
    from expstudy.study import Study

    X.experience(spark, SF001).createOrReplaceTempView("experience_v")
    st = Study(spark, str(tmp_path / "study"))
    root = st.start()
    n1, rows = st.create_dataset(root, "train", "SELECT * FROM experience_v WHERE dataset = 'TRAIN'")
    n1b, _ = st.create_dataset(n1, "test", "SELECT * FROM experience_v WHERE dataset = 'TEST'")
    assert rows == X.experience(spark, SF001).filter("dataset = 'TRAIN'").count()
    n2, tree = st.tree(n1b, "train", MD.X_VARS, "expected", "actual", max_depth=2, cp=0.001)
    assert tree.leaves()
    with pytest.raises(ValueError):
        st.tree(n2, "train", MD.X_VARS + ["obs_year", "o_orderpriority"], "expected", "actual")
    n3, fit = st.glm(n2, "train", MD.X_VARS, [Main("c_mktsegment"), Main("quantity"), Main("discount_pct")],
                     "expected", "actual", nlambda=10)
    assert abs(fit.ae_train - 1) < 0.03
    with pytest.raises(ValueError):
        st.glm(n3, "train", MD.X_VARS, [Main("quantity")], "expected", "actual", nlambda=5)
    with pytest.raises(FileNotFoundError):
        st.run_inference(n2, "test", "scored")   # no model on that branch yet
    n4 = st.run_inference(n3, "test", "scored")
    assert [d for d, _ in st.visible_datasets(n4)] == ["scored", "test", "train"]
    assert [d for d, _ in st.visible_datasets(n1)] == ["train"]
    assert st.resolve(n4, "scored").filter("MODEL_PRED IS NULL").count() == 0
    with pytest.raises(Exception):
        st.resolve(n1, "scored").count()          # a sibling/ancestor does not see later datasets
    out = st.finalize(n4)
    assert spark.read.parquet(f"{out}/tables").count() > 0 and spark.read.parquet(f"{out}/overview").count() == 3
    with pytest.raises(ValueError):
        st.create_dataset(n4, "more", "SELECT 1 AS a")
    failed = st.log.steps().filter("NOT success").select("tool_name").collect()
    assert sorted(r[0] for r in failed) == ["cmd_glmnet", "cmd_run_inference"]
    ok = st.sql_run("segments", "SELECT c_mktsegment, count(*) AS n FROM experience_v GROUP BY 1 LIMIT 10")
    bad = st.sql_run("no limit", "SELECT * FROM experience_v")
    assert ok.success and len(ok.rows) == 5 and not bad.success
    assert [r["success"] for r in st.log.queries().collect()] == [True, False]
    assert st.register_outputs(n4) == "scored"
    assert spark.table("scored").count() == st.resolve(n4, "scored").count()


def test_fill_missing_steps(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "node string, parent string")
    steps = spark.createDataFrame([("a", X.TOOL_TREE, '["ds"]')], "node string, tool_name string, args string")
    got = {r["node"]: (r["tool_name"], r["args"]) for r in LN.fill_missing_steps(nodes, steps).collect()}
    assert got == {"r": (None, None), "a": (X.TOOL_TREE, '["ds"]'), "b": ("unknown", "[]")}


def test_safe_names_unique_after_collisions(spark):
    from expstudy.operators.factors import safe_names

    def names(vals):
        df = spark.createDataFrame(list(enumerate(vals)), "i int, raw string")
        return [r["safe_name"] for r in safe_names(df, "raw", "i").orderBy("i").collect()]

    assert names(["A", "A", "A_1"]) == ["A", "A_1", "A_1_1"]
    assert names(["A_1", "A", "A"]) == ["A_1", "A", "A_2"]
    assert names(["a/b", "a:b", " ", "x" * 40, "x" * 40]) == ["a_b", "a_b_1", "Sheet", "x" * 31, "x" * 29 + "_1"]


# ---------------------------------------------------------------- ancestor paths and marks

def test_paths_equal_branches(spark):
    """A forest with long chains, and with branching: root, depth and path of every node."""
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 120)] + [(1000, None)] + [(1000 + i, 1000 + (i - 1) // 3) for i in range(1, 60)]
    nodes = spark.createDataFrame(rows, "node long, parent long")
    up = dict(rows)

    def chain(n):
        return [] if up[n] is None else [*chain(up[n]), up[n]]

    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in LN.with_paths(nodes).collect()}
    assert got == {n: ((chain(n) or [n])[0], len(chain(n)), chain(n)) for n in up}
    with pytest.raises(ValueError, match="1000 or more|100 or more"):
        LN.with_paths(nodes, max_depth=100)
    with pytest.raises(ValueError, match="not in the log"):
        LN.with_paths(spark.createDataFrame([(1, 7)], "node long, parent long"))
    assert LN.with_paths(nodes.where("false")).count() == 0


def test_branch_from_paths_is_one_scan(tmp_path, spark):
    log = LN.StudyLog(spark, str(tmp_path / "log"))
    root = log.start()
    chain = [root]
    for i in range(4):
        chain.append(log.step(chain[-1], X.TOOL_TREE, [i]))
    side = log.step(chain[1], X.TOOL_CREATE_DATASET, ["d"])
    leaf = chain[-1]
    got = LN.path_branches(log.steps().where(F.col("node") == leaf))
    assert [r["node"] for r in got.orderBy("pos").collect()] == chain[::-1] == log.ancestors(leaf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan
    assert {r["node"] for r in LN.seen_from(log.steps(), side).collect()} == {root, chain[1], side}
    own = {r["node"]: (r["root"], r["path"]) for r in log.steps().collect()}
    same = {r["node"]: (r["root"], r["path"]) for r in LN.with_paths(log.steps()).collect()}
    assert own == same


def test_final_study_takes_nothing(tmp_path, spark):
    log = LN.StudyLog(spark, str(tmp_path / "log"))
    root = log.start()
    fit = log.step(root, X.TOOL_GLM, ["train"])
    other = log.step(root, X.TOOL_TREE, ["train"])
    log.finalize(fit)
    for again in (lambda: log.finalize(fit), lambda: log.step(other, X.TOOL_TREE, ["x"]), lambda: log.step(fit, X.TOOL_TREE, ["x"])):
        with pytest.raises(ValueError, match="final"):
            again()
    assert log.finals().count() == 1
    second = log.start()  # another study of the log stays open
    log.finalize(log.step(second, X.TOOL_GLM, ["train"]))
    assert log.finals().count() == 2


def test_two_writers_one_mark(tmp_path, spark, monkeypatch):
    """Both pass the guards before either has marked; one is refused by the marker itself."""
    log = LN.StudyLog(spark, str(tmp_path / "log"))
    root = log.start()
    fit = log.step(root, X.TOOL_GLM, ["train"])
    late = LN.StudyLog(spark, str(tmp_path / "log"))
    monkeypatch.setattr(late, "check_can_finalize", lambda node: root)
    log.finalize(fit)
    with pytest.raises(ValueError, match="exists already"):
        late.finalize(fit)
    assert log.finals().count() == 1
    log.claim("model", "n1")
    with pytest.raises(ValueError, match="exists already"):
        late.claim("model", "n1")
    late.claim("model", "n2")


def test_failed_factor_write_leaves_the_branch_open(tmp_path, spark, monkeypatch):
    from expstudy.operators.design import Main
    from expstudy.study import Study
    from expstudy.sources import io as IO

    X.experience(spark, SF001).createOrReplaceTempView("experience_w")
    st = Study(spark, str(tmp_path / "study"))
    n1, _ = st.create_dataset(st.start(), "train", "SELECT * FROM experience_w WHERE dataset = 'TRAIN'")
    n2, _ = st.glm(n1, "train", ["quantity", "discount_pct"], [Main("quantity"), Main("discount_pct")], "expected", "actual", nlambda=5)
    write = IO.write_factor_tables

    def broken(tables, path, overview=None):
        write(tables, path, overview)
        raise OSError("the store is full")

    monkeypatch.setattr(IO, "write_factor_tables", broken)
    with pytest.raises(OSError):
        st.finalize(n2)
    assert st.log.finals().count() == 0
    monkeypatch.setattr(IO, "write_factor_tables", write)
    out = st.finalize(n2)
    assert spark.read.parquet(f"{out}/overview").count() == 3 and st.log.finals().count() == 1
    with pytest.raises(ValueError, match="final"):
        st.finalize(n2)


# ---------------------------------------------------------------- scans and scans of products

def test_many_prediction_files_are_one_scan(tmp_path, spark):
    """2,000 names, some in two places, among files of other kinds: one scan node, one place per name."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(tmp_path / "b")
    os.makedirs(tmp_path / "a")
    for i in range(2000):
        table = pa.table({"actual": [float(i), 1.0], "MODEL_PRED": [0.5, float(i + 1)]})
        pq.write_table(table, tmp_path / "b" / f"run_{i:04}_test_preds.parquet")
        if i % 500 == 0:
            pq.write_table(table.slice(0, 1), tmp_path / "a" / f"run_{i:04}_test_preds.parquet")
    pq.write_table(pa.table({"actual": ["text"], "n_nationkey": [1]}), tmp_path / "b" / "nation.parquet")
    df = IO.read_prediction_files(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Union" not in plan
    got = {r["filename"]: (r["n"], r["s"]) for r in df.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.sum("actual").alias("s")).collect()}
    assert len(got) == 2000
    assert all(got[f"run_{i:04}_test_preds.parquet"] == ((1, float(i)) if i % 500 == 0 else (2, i + 1.0)) for i in range(2000))


def test_product_scan_equals_window(spark):
    """One portfolio holds a third of the periods; rates of -1 and below, and an infinite one, are among them."""
    from pyspark.sql import Window

    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("portfolio_id"), F.col("id").alias("t"), F.lit(1.0).alias("amt"),
        F.when(F.col("id") == 25_002, -1.0).when(F.col("id") % 997 == 0, -1.5).when(F.col("id") == 20_001, float("inf"))
        .otherwise((F.col("id") % 7 - 3) / 1000.0).alias("rate"))
    got = M.discount_factors(rows)
    growth = 1.0 + F.col("rate")
    w = Window.partitionBy("portfolio_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = got.join(rows.withColumn("want", F.product(F.when(growth == 0, float("inf")).otherwise(F.try_divide(F.lit(1.0), growth))).over(w))
                    .select("t", "want"), "t")
    bad = both.where(~(F.col("v").eqNullSafe(F.col("want")) | (F.abs(F.col("v") - F.col("want")) <= 1e-9 * F.abs("want"))))
    assert both.count() == n and bad.count() == 0
    assert both.where("v < 0").count() > 0 and both.where("v = 0").count() > 0 and both.where("isnan(v)").count() > 0


def test_run_index_has_no_single_partition(spark):
    runs = spark.range(5000).select(F.format_string("run %05d", (F.col("id") * 7919) % 5000).alias("file"))
    got = M.run_index(runs, "file")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert all(r["file"] == f"run {r['run_ix'] - 1:05d}" for r in got.collect())


def test_first_seen_order(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "c"), (2, None), (4, "c"), (5, "b"), (1, "c")], "i int, v string")
    assert M.first_seen(rows, "v", ["i"]).first()["values"] == ["c", None, "a", "b"]
    assert M.first_seen(rows.where("false"), "v", ["i"]).first()["values"] == []
