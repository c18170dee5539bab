"""Registered queries of the modelling, lineage and bounded-query operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from expstudy.operators import factors as FT
from expstudy.operators import lineage as LN
from expstudy.operators import limits as LM
from expstudy.operators import measures as M
from expstudy.operators import tree as TR
from expstudy.operators.design import learn_recipe
from expstudy.plans import fixtures as X
from expstudy.plans import models as MD
from expstudy.plans.registry import register, r6
from expstudy.session import reliable_checkpoint


# ---------------------------------------------------------------------------
# Design and scoring with the fixed-coefficient model (MOD-2, 3, 5, 7, 8, 12)
# ---------------------------------------------------------------------------

ENC_VARS = {"c_mktsegment": "BUILDING", "l_returnflag": None, "o_orderpriority": "3-MEDIUM"}


@register("factor_encoding", X.with_views("""
SELECT l.variable, l.level, c.code, CAST(count(*) AS BIGINT) AS n_rows
FROM (SELECT 'c_mktsegment' AS variable, c_mktsegment AS level FROM experience
      UNION ALL SELECT 'l_returnflag', l_returnflag FROM experience
      UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM experience) l
LEFT JOIN codes c ON c.variable = l.variable AND c.level = l.level
GROUP BY 1, 2, 3
""", experience=X.EXPERIENCE_SQL, lv="""
SELECT DISTINCT 'c_mktsegment' AS variable, c_mktsegment AS level FROM experience WHERE dataset = 'TRAIN' AND c_mktsegment IS NOT NULL
UNION ALL SELECT DISTINCT 'l_returnflag', l_returnflag FROM experience WHERE dataset = 'TRAIN' AND l_returnflag IS NOT NULL
UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM experience WHERE dataset = 'TRAIN' AND o_orderpriority IS NOT NULL
""", codes="""
SELECT variable, level,
       CAST(row_number() OVER (PARTITION BY variable ORDER BY
            CASE WHEN (variable = 'c_mktsegment' AND level = 'BUILDING')
                   OR (variable = 'o_orderpriority' AND level = '3-MEDIUM') THEN 0 ELSE 1 END, level) AS INTEGER) AS code
FROM lv
"""))
def q_factor_encoding(spark, sf_dir):
    e = X.experience(spark, sf_dir)
    train = e.filter(F.col("dataset") == "TRAIN")
    defaults = {k: v for k, v in ENC_VARS.items() if v}
    rec = learn_recipe(train, list(ENC_VARS), defaults)
    long = e.select(F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).alias("level"),
                                                 F.array(*[F.lit(x) for x in rec.levels[v]]).alias("lv"))
                                        for v in ENC_VARS])).alias("r"))
    code = F.array_position(F.col("r.lv"), F.col("r.level")).cast("int")
    coded = long.select(F.col("r.variable").alias("variable"), F.col("r.level").alias("level"),
                        F.when(code > 0, code).alias("code"))
    return coded.groupBy("variable", "level", "code").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def _dummy_sql() -> str:
    parts = [f"SELECT '{n}' AS term, round(sum({e}), 6) AS basis_sum, round(sum(({e}) * actual), 6) AS basis_actual "
             f"FROM experience, rng WHERE dataset = 'TRAIN'" for n, e in MD.fixed_columns_sql()]
    return "WITH experience AS (" + X.EXPERIENCE_SQL + ")," + MD.FIXED_RANGES_SQL + "\n" + "\nUNION ALL\n".join(parts)


@register("dummy_design", _dummy_sql())
def q_dummy_design(spark, sf_dir):
    model = MD.fixed_model(spark, sf_dir)
    train = MD.train_rows(spark, sf_dir)
    basis = model.design.basis(train)
    long = train.select("actual", F.explode(F.array(*[
        F.struct(F.lit(n).alias("term"), b.alias("v")) for n, b in zip(model.design.names, basis)])).alias("e"))
    return (long.groupBy(F.col("e.term").alias("term"))
            .agg(r6(F.sum("e.v")).alias("basis_sum"), r6(F.sum(F.col("e.v") * F.col("actual"))).alias("basis_actual")))


@register("score_fixed_coefficients", "WITH experience AS (" + X.EXPERIENCE_SQL + ")," + MD.FIXED_RANGES_SQL + f"""
SELECT dataset, c_mktsegment, CAST(count(*) AS BIGINT) AS n_rows, round(sum(actual), 6) AS actual,
       round(sum(MODEL_PRED), 4) AS model_pred, round(sum(actual) / sum(MODEL_PRED), 6) AS ae
FROM (SELECT dataset, c_mktsegment, actual, expected * exp({MD.fixed_eta_sql()}) AS MODEL_PRED
      FROM experience, rng) s
GROUP BY 1, 2
""")
def q_score_fixed(spark, sf_dir):
    model = MD.fixed_model(spark, sf_dir)
    scored = model.score(X.experience(spark, sf_dir))
    return (scored.groupBy("dataset", "c_mktsegment")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"), r6(F.sum("actual")).alias("actual"),
                 r6(F.sum("MODEL_PRED"), 4).alias("model_pred"),
                 r6(F.sum("actual") / F.sum("MODEL_PRED")).alias("ae")))


def _grid_sql(var: str, lo: str, hi: str) -> str:
    return f"SELECT CAST(x AS INTEGER) AS {var} FROM rng, unnest(generate_series(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))) AS t(x)"


@register("factor_table_main", "WITH experience AS (" + X.EXPERIENCE_SQL + ")," + MD.FIXED_RANGES_SQL + f"""
SELECT 'c_mktsegment' AS term_group, 'c_mktsegment=' || lv AS level_key,
       round(c, 6) AS contribution_log, round(exp(c), 6) AS contribution_multiplier
FROM (SELECT lv, CAST(c0 AS DOUBLE) AS c FROM (VALUES ('BUILDING', {MD.FIXED_COEFS['c_mktsegmentBUILDING']}), ('AUTOMOBILE', {MD.FIXED_COEFS['c_mktsegmentAUTOMOBILE']}),
             ('FURNITURE', {MD.FIXED_COEFS['c_mktsegmentFURNITURE']}), ('HOUSEHOLD', {MD.FIXED_COEFS['c_mktsegmentHOUSEHOLD']}),
             ('MACHINERY', {MD.FIXED_COEFS['c_mktsegmentMACHINERY']})) v0(lv, c0)) v
UNION ALL
SELECT 'l_returnflag', 'l_returnflag=' || lv, round(c, 6), round(exp(c), 6)
FROM (SELECT lv, CAST(c0 AS DOUBLE) AS c FROM (VALUES ('A', 0.0), ('N', {MD.FIXED_COEFS['l_returnflagN']}), ('R', {MD.FIXED_COEFS['l_returnflagR']})) v0(lv, c0)) v
UNION ALL
SELECT 'quantity', 'quantity=' || CAST(quantity AS VARCHAR), round({MD.FIXED_COEFS['quantity']} * quantity, 6),
       round(exp({MD.FIXED_COEFS['quantity']} * quantity), 6)
FROM ({_grid_sql('quantity', 'q_lo', 'q_hi')}) g
UNION ALL
SELECT 'discount_pct', 'discount_pct=' || CAST(discount_pct AS VARCHAR), round({MD.FIXED_COEFS['discount_pct']} * discount_pct, 6),
       round(exp({MD.FIXED_COEFS['discount_pct']} * discount_pct), 6)
FROM ({_grid_sql('discount_pct', 'd_lo', 'd_hi')}) g
""")
def q_factor_table_main(spark, sf_dir):
    model = MD.fixed_model(spark, sf_dir)
    long = FT.factor_tables_long(model, spark)
    return (long.filter(~F.col("term_group").contains("_X_"))
            .select("term_group", "level_key", r6("contribution_log"), r6("contribution_multiplier")))


@register("factor_table_interaction", "WITH experience AS (" + X.EXPERIENCE_SQL + ")," + MD.FIXED_RANGES_SQL + f"""
SELECT lv AS l_returnflag, discount_pct, round(c * discount_pct, 6) AS contribution_log,
       round(exp(c * discount_pct), 6) AS contribution_multiplier
FROM (SELECT lv, CAST(c0 AS DOUBLE) AS c FROM (VALUES ('A', 0.0), ('N', {MD.FIXED_COEFS['l_returnflagN:discount_pct']}),
             ('R', {MD.FIXED_COEFS['l_returnflagR:discount_pct']})) v0(lv, c0)) v,
     ({_grid_sql('discount_pct', 'd_lo', 'd_hi')}) g
""")
def q_factor_table_interaction(spark, sf_dir):
    model = MD.fixed_model(spark, sf_dir)
    t = FT.factor_table(model, spark, "l_returnflag_X_discount_pct")
    return t.select("l_returnflag", "discount_pct", r6("contribution_log"), r6("contribution_multiplier"))


@register("safe_names", """
SELECT p_partkey,
       CASE WHEN dup = 0 THEN base
            ELSE substring(base, 1, greatest(1, 31 - length('_' || CAST(dup AS VARCHAR)))) || '_' || CAST(dup AS VARCHAR)
       END AS safe_name
FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS dup
      FROM (SELECT p_partkey,
                   substring(CASE WHEN trim(regexp_replace(p_brand || ':' || p_type || '?', '[\\[\\]\\*:\\?/\\\\]', '_', 'g')) = ''
                                  THEN 'Sheet'
                                  ELSE trim(regexp_replace(p_brand || ':' || p_type || '?', '[\\[\\]\\*:\\?/\\\\]', '_', 'g')) END,
                             1, 31) AS base
            FROM part) b) d
""")
def q_safe_names(spark, sf_dir):
    part = X.table(spark, sf_dir, "part")
    named = part.select("p_partkey", F.concat("p_brand", F.lit(":"), "p_type", F.lit("?")).alias("raw"))
    return FT.safe_names(named, "raw", "p_partkey").select("p_partkey", "safe_name")


# ---------------------------------------------------------------------------
# Poisson tree (MOD-14 .. MOD-18)
# ---------------------------------------------------------------------------

TREE_VARS = ["c_mktsegment", "l_returnflag", "quantity", "discount_pct"]


def _ylogy(y, t):
    return f"CASE WHEN ({y}) > 0 AND ({t}) > 0 THEN ({y}) * ln(({y}) / ({t})) ELSE 0.0 END"


ROOT_SPLIT_SQL = X.with_views(f"""
SELECT feature, cut, left_levels, round(improve, 4) AS improve, CAST(ln AS BIGINT) AS n_left,
       CAST(sn - ln AS BIGINT) AS n_right
FROM (SELECT b.*, row_number() OVER (PARTITION BY feature ORDER BY improve DESC, pos) AS rk,
             CASE WHEN b.sv IS NOT NULL THEN
                 (SELECT string_agg(r.sv, ',' ORDER BY r.sv) FROM run r WHERE r.feature = b.feature AND r.pos <= b.pos)
             END AS left_levels,
             (b.nv + b.next_nv) / 2.0 AS cut
      FROM cand b WHERE improve > 1e-12) w
WHERE rk = 1
""", experience=X.EXPERIENCE_SQL, cells="""
SELECT c_mktsegment, l_returnflag, quantity, discount_pct, sum(expected) AS t, sum(actual) AS y
FROM experience WHERE dataset = 'TRAIN' GROUP BY 1, 2, 3, 4
""", lng="""
SELECT 'c_mktsegment' AS feature, CAST(NULL AS DOUBLE) AS nv, c_mktsegment AS sv, t, y FROM cells
UNION ALL SELECT 'l_returnflag', NULL, l_returnflag, t, y FROM cells
UNION ALL SELECT 'quantity', CAST(quantity AS DOUBLE), NULL, t, y FROM cells
UNION ALL SELECT 'discount_pct', CAST(discount_pct AS DOUBLE), NULL, t, y FROM cells
""", stats="""
SELECT feature, nv, sv, sum(t) AS t, sum(y) AS y, count(*) AS n,
       coalesce(nv, CASE WHEN sum(t) > 0 THEN sum(y) / sum(t) ELSE 'Infinity'::DOUBLE END) AS ord
FROM lng GROUP BY 1, 2, 3
""", run="""
SELECT feature, nv, sv,
       row_number() OVER w AS pos, lead(nv) OVER w AS next_nv,
       sum(t) OVER wr AS lt, sum(y) OVER wr AS ly, sum(n) OVER wr AS ln,
       sum(t) OVER wa AS st, sum(y) OVER wa AS sy, sum(n) OVER wa AS sn
FROM stats
WINDOW w AS (PARTITION BY feature ORDER BY ord, sv),
       wr AS (PARTITION BY feature ORDER BY ord, sv ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
       wa AS (PARTITION BY feature)
""", cand=f"""
SELECT *, {_ylogy('ly', 'lt')} + {_ylogy('sy - ly', 'st - lt')} - {_ylogy('sy', 'st')} AS improve
FROM run WHERE ln >= 7 AND sn - ln >= 7
""")


@register("tree_root_split", ROOT_SPLIT_SQL)
def q_tree_root_split(spark, sf_dir):
    train = MD.train_rows(spark, sf_dir)
    return TR.root_split_table(train, TREE_VARS, "expected", "actual", min_bucket=7) \
        .select("feature", "cut", "left_levels", r6("improve", 4), "n_left", "n_right")


_TREES: dict = {}


def _grown(spark, sf_dir, kind, grow):
    """A tree grown once per session and data folder for the queries that read it, as in a study session."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _TREES:
        _TREES[key] = grow()
    return _TREES[key]


def _train_tree(spark, sf_dir):
    return _grown(spark, sf_dir, "train", lambda: TR.poisson_tree(
        MD.train_rows(spark, sf_dir), TREE_VARS, "expected", "actual", max_depth=3, cp=0.001))


def _ruled(leaves):
    return leaves.select("leaf", "rule", "n", r6("events"), r6("exposure"), r6("rate"), r6("ae"))


@register("tree_nodes", None)
def q_tree_nodes(spark, sf_dir):
    tree = TR.poisson_tree(MD.train_rows(spark, sf_dir), TREE_VARS, "expected", "actual",
                           max_depth=TR.MAX_TREE_DEPTH, cp=TR.check_tree_args(TREE_VARS, 4, 0.00001))
    return tree.snip(3).nodes_df(spark)


def _residual_tree(spark, sf_dir):
    return _grown(spark, sf_dir, "residual", lambda: TR.poisson_tree(
        X.predictions(spark, sf_dir, split="TRAIN"), TREE_VARS, "MODEL_PRED", "actual", max_depth=3, cp=0.001))


# ---------------------------------------------------------------------------
# Spline basis and the lasso fit (MOD-6, MOD-9 .. MOD-14, MOD-19 .. MOD-24)
# ---------------------------------------------------------------------------

def _spline_sql() -> str:
    """Cox-de Boor recursion, linear beyond the boundary knots, times the constant projection."""
    sp = MD.SPLINE.spline
    lo, hi = sp.boundary
    t = [lo] * 4 + sorted(sp.knots) + [hi] * 4

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
        return f"({' + '.join(parts)})"

    proj = sp._projection()
    n = len(t) - 4
    cols = ", ".join(f"{basis(i, 4)} AS b{i}, {slope(i)} AS d{i}" for i in range(1, n))
    out = ", ".join("round(" + " + ".join(f"CAST({proj[i - 1][j]!r} AS DOUBLE) * (b{i} + (quantity - x) * d{i})".replace("np.float64(", "").replace(") AS DOUBLE", " AS DOUBLE")
                                          for i in range(1, n)) + f", 6) AS ns{j + 1}" for j in range(sp.n_columns))
    return X.with_views(f"""
SELECT quantity, {out} FROM (SELECT quantity, x, {cols} FROM (
  SELECT quantity, least(greatest(quantity, {lo}), {hi}) AS x FROM (SELECT DISTINCT CAST(quantity AS DOUBLE) AS quantity FROM experience) q) c) b
""", experience=X.EXPERIENCE_SQL)


@register("spline_basis", _spline_sql())
def q_spline_basis(spark, sf_dir):
    e = X.experience(spark, sf_dir)
    q = e.select(F.col("quantity").cast("double").alias("quantity")).distinct()
    cols = MD.SPLINE.spline.columns(F.col("quantity"))
    return q.select("quantity", *[r6(c).alias(f"ns{j + 1}") for j, c in enumerate(cols)])


@register("lasso_coefficients", None)
def q_lasso_coefficients(spark, sf_dir):
    return MD.fitted(spark, sf_dir).path.coef_df(spark)


@register("lambda_path", None)
def q_lambda_path(spark, sf_dir):
    return MD.fitted(spark, sf_dir).path.path_df(spark)


@register("train_ae", X.with_views("""
SELECT c_mktsegment, round(sum(actual), 6) AS actual, CAST(count(*) AS BIGINT) AS n_rows,
       round(sum(sum(actual)) OVER () / 100, 1) AS fitted_total
FROM experience WHERE dataset = 'TRAIN' GROUP BY 1
""", experience=X.EXPERIENCE_SQL))
def q_train_ae(spark, sf_dir):
    """MOD-13 property: with an unpenalised intercept the fitted total of the training rows is
    their actual total (here in hundreds, one digit); actual counts by segment."""
    fit = MD.fitted(spark, sf_dir)
    scored = fit.model.score(MD.train_rows(spark, sf_dir))
    by = scored.groupBy("c_mktsegment").agg(F.sum("actual").alias("actual"), F.count(F.lit(1)).alias("n_rows"), F.sum("MODEL_PRED").alias("p"))
    total = F.sum("p").over(Window.partitionBy(F.lit(1)))  # one row for each segment
    return by.select("c_mktsegment", r6("actual"), "n_rows", F.round(total / 100, 1).alias("fitted_total"))


@register("glm_residual_tree", None)
def q_glm_residual_tree(spark, sf_dir):
    return MD.fitted(spark, sf_dir).residual_tree.leaves_df(spark)


@register("factor_table_fitted", None)
def q_factor_table_fitted(spark, sf_dir):
    return FT.factor_tables_long(MD.fitted(spark, sf_dir).model, spark)


@register("score_fitted_test", None)
def q_score_fitted_test(spark, sf_dir):
    """Fitted model on the held-out split: A/E and Poisson log-likelihood by segment.

    Both come from one aggregation over (segment, quantity) cells of the scored rows.
    """
    from expstudy.functions.expr import poisson_logpmf

    model = MD.fitted(spark, sf_dir).model
    scored = model.score(X.experience(spark, sf_dir, split="TEST"))
    cells = M.cells(scored, ["c_mktsegment", "quantity"], "MODEL_PRED", "actual")
    out = cells.groupBy("c_mktsegment").agg(
        F.sum("actual").alias("actual"), F.sum("MODEL_PRED").alias("expected"),
        F.sum(poisson_logpmf(F.col("actual"), F.col("MODEL_PRED"))).alias("ll"))
    return out.select("c_mktsegment", r6("actual"), r6("expected"),
                      r6(F.col("actual") / F.col("expected")).alias("ae"), r6("ll", 4))


# ---------------------------------------------------------------------------
# Lineage (LIN-2, 4 .. 6, 8 .. 10, 12)
# ---------------------------------------------------------------------------

LOG = {"log": X.LINEAGE_SQL}
FINALS_SQL = "SELECT max(node) AS node FROM log GROUP BY conv_id"
UP_SQL = """
WITH RECURSIVE up(leaf, node, pos) AS (
    SELECT node, node, 0 FROM finals
    UNION ALL
    SELECT u.leaf, l.parent, u.pos + 1 FROM up u JOIN log l ON l.node = u.node WHERE l.parent IS NOT NULL)
"""
WALK_SQL = """
WITH RECURSIVE walk(node, root, depth) AS (
    SELECT node, node, 0 FROM log WHERE parent IS NULL
    UNION ALL
    SELECT l.node, w.root, w.depth + 1 FROM log l JOIN walk w ON l.parent = w.node)
"""


def _log_views(branching=False):
    return f"log AS ({X.LINEAGE_BRANCHING_SQL if branching else X.LINEAGE_SQL}), finals AS ({FINALS_SQL})"


def _final_leaves(log):
    return log.groupBy("conv_id").agg(F.max("node").alias("node")).select("node")


@register("lineage_root_depth", WALK_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") +
          "SELECT node, root, CAST(depth AS INTEGER) AS depth FROM walk")
def q_lineage_root_depth(spark, sf_dir):
    rd = LN.root_depth(X.lineage_log(spark, sf_dir))
    return rd.select("node", "root", F.col("depth").cast("int").alias("depth"))


@register("lineage_branch", UP_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") +
          "SELECT leaf, node, CAST(pos AS INTEGER) AS pos FROM up")
def q_lineage_branch(spark, sf_dir):
    log = X.lineage_log(spark, sf_dir)
    return LN.branches(log, _final_leaves(log)).select("leaf", "node", F.col("pos").cast("int").alias("pos"))


@register("lineage_paths", UP_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") +
          "SELECT leaf, node, CAST(pos AS INTEGER) AS pos FROM up")
def q_lineage_paths(spark, sf_dir):
    """LIN-4 from materialised ancestor paths: a branch is one row, exploded."""
    log = X.lineage_log(spark, sf_dir)
    paths = reliable_checkpoint(LN.with_paths(log))
    return LN.path_branches(paths.join(_final_leaves(log), "node", "left_semi")).select("leaf", "node", F.col("pos").cast("int").alias("pos"))


@register("lineage_tree", WALK_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views(True) + ",") +
          "SELECT root, CAST(depth AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n_nodes FROM walk GROUP BY 1, 2")
def q_lineage_tree(spark, sf_dir):
    t = LN.tree_levels(X.lineage_log(spark, sf_dir, branching=True))
    return t.select("root", F.col("level").cast("int").alias("level"), F.col("n_nodes").cast("bigint").alias("n_nodes"))


@register("steps_by_time", WALK_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") + """
SELECT w.root, w.node, l.created, CAST(w.depth AS INTEGER) AS depth,
       CASE WHEN l.parent IS NOT NULL THEN coalesce(l.tool_name, 'unknown') END AS tool_name,
       CAST(row_number() OVER (PARTITION BY w.root ORDER BY l.created, w.node) AS INTEGER) AS step_ix
FROM walk w JOIN log l ON l.node = w.node
""")
def q_steps_by_time(spark, sf_dir):
    s = LN.steps_by_time(X.lineage_log(spark, sf_dir))
    return s.select("root", "node", "created", F.col("depth").cast("int").alias("depth"), "tool_name",
                    F.col("step_ix").cast("int").alias("step_ix"))


@register("steps_of_roots", WALK_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") + """
SELECT w.root, w.node, CAST(row_number() OVER (PARTITION BY w.root ORDER BY l.created, w.node) AS INTEGER) AS step_ix
FROM walk w JOIN log l ON l.node = w.node WHERE (w.root // 100) % 2 = 0
""")
def q_steps_of_roots(spark, sf_dir):
    """JN-5 + LIN-6: only the steps reached from chosen roots."""
    log = X.lineage_log(spark, sf_dir)
    roots = log.filter(F.col("parent").isNull() & (F.col("conv_id") % 2 == 0))
    return LN.steps_by_time(log, roots).select("root", "node", F.col("step_ix").cast("int").alias("step_ix"))


@register("pointer_parse", X.with_views(
    "SELECT 'n-' || CAST(node AS VARCHAR) AS node, 'n-' || CAST(parent AS VARCHAR) AS parent FROM log WHERE parent IS NOT NULL", log=X.LINEAGE_SQL))
def q_pointer_parse(spark, sf_dir):
    """STR-4: node and parent out of pointer text."""
    quoted = lambda c: F.concat(F.lit('"n-'), F.col(c).cast("string"), F.lit('"'))
    pointer = F.when(F.col("parent").isNull(), F.lit("root")).otherwise(F.concat(quoted("parent"), F.lit("->"), quoted("node")))
    return LN.parse_pointers(X.lineage_log(spark, sf_dir).select(pointer.alias("pointer")))


@register("log_json", """
SELECT CAST(conv_id * 100 + turn AS BIGINT) AS node, CAST(conv_id * 100 + turn AS VARCHAR) AS first_arg, CAST(2 AS INTEGER) AS n_args,
       CAST(length(text) AS BIGINT) AS text_chars
FROM conversations WHERE turn > 0
""")
def q_log_json(spark, sf_dir):
    """JSN-1: JSON lists written into the log and parsed back."""
    args = F.from_json("args", "array<string>")
    return (X.lineage_log(spark, sf_dir).filter(F.col("parent").isNotNull()).select("node", args.alias("a"))
            .select("node", F.col("a")[0].alias("first_arg"), F.size("a").cast("int").alias("n_args"),
                    F.length(F.col("a")[1]).cast("bigint").alias("text_chars")))


def _branch_steps(spark, sf_dir):
    log = X.lineage_log(spark, sf_dir)
    br = LN.branches(log, _final_leaves(log))
    return br.join(LN.fill_missing_steps(log).select("node", "tool_name", "args"), "node")


@register("classify_steps", UP_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") + """
SELECT leaf, node, CAST(pos AS INTEGER) AS pos, tool_name,
       CASE WHEN tool_name = 'cmd_create_dataset' THEN 'datasets'
            WHEN tool_name = 'cmd_glmnet' THEN 'model'
            WHEN tool_name = 'cmd_run_inference' THEN 'inference'
            WHEN tool_name = 'cmd_rpart' AND seen > 0 THEN 'validation'
            WHEN tool_name = 'cmd_rpart' THEN 'variable_importance' END AS phase
FROM (SELECT u.leaf, u.node, u.pos, CASE WHEN l.parent IS NOT NULL THEN coalesce(l.tool_name, 'unknown') END AS tool_name,
             max(CASE WHEN l.tool_name = 'cmd_glmnet' THEN 1 ELSE 0 END) OVER (PARTITION BY u.leaf ORDER BY u.pos DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen
      FROM up u JOIN log l ON l.node = u.node) s
""")
def q_classify_steps(spark, sf_dir):
    c = LN.classify_steps(_branch_steps(spark, sf_dir))
    return c.select("leaf", "node", F.col("pos").cast("int").alias("pos"), "tool_name", "phase")


@register("visible_datasets", UP_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") + """
SELECT u.leaf, u.node, CAST(u.pos AS INTEGER) AS pos, 'ds_' || CAST(l.node AS VARCHAR) AS dataset
FROM up u JOIN log l ON l.node = u.node WHERE l.tool_name = 'cmd_create_dataset'
""")
def q_visible_datasets(spark, sf_dir):
    log = X.lineage_log(spark, sf_dir)
    datasets = log.filter(F.col("tool_name") == X.TOOL_CREATE_DATASET).select(
        "node", F.concat(F.lit("ds_"), F.get_json_object("args", "$[0]")).alias("dataset"))
    v = LN.visible_datasets(LN.branches(log, _final_leaves(log)), datasets)
    return v.select("leaf", "node", F.col("pos").cast("int").alias("pos"), "dataset")


@register("model_outputs", UP_SQL.replace("WITH RECURSIVE", "WITH RECURSIVE " + _log_views() + ",") + """
SELECT leaf, node, CAST(pos AS INTEGER) AS pos, md5(out_dataset) AS out_dataset_md5,
       row_number() OVER (PARTITION BY leaf ORDER BY pos DESC) = 1 AS is_first
FROM (SELECT u.leaf, u.node, u.pos, c.text AS out_dataset
      FROM up u JOIN log l ON l.node = u.node
      JOIN conversations c ON c.conv_id * 100 + c.turn = u.node
      WHERE l.tool_name = 'cmd_run_inference') s
""")
def q_model_outputs(spark, sf_dir):
    m = LN.model_outputs(_branch_steps(spark, sf_dir))
    return m.select("leaf", "node", F.col("pos").cast("int").alias("pos"),
                    F.md5(F.col("out_dataset")).alias("out_dataset_md5"), "is_first")


FINISHED_SQL = ("WITH RECURSIVE " + _log_views() + ",\n"
                + UP_SQL.replace("WITH RECURSIVE", "").strip() + ",\n"
                + WALK_SQL.replace("WITH RECURSIVE", "").strip() + """
SELECT DISTINCT w.root
FROM up u JOIN log l ON l.node = u.node JOIN walk w ON w.node = u.leaf
WHERE l.tool_name = 'cmd_glmnet'
""")


@register("finished_studies", FINISHED_SQL)
def q_finished_studies(spark, sf_dir):
    """LIN-11/12: final leaves whose branch holds a model fit count as finished studies."""
    log = X.lineage_log(spark, sf_dir)
    steps = _branch_steps(spark, sf_dir)
    marks = steps.filter(F.col("tool_name") == X.TOOL_GLM).select(F.col("leaf").alias("node")).distinct()
    return LN.finished_studies(marks, log)


# ---------------------------------------------------------------------------
# Bounded queries and capped exports (LIM-1, LIM-2, SNK-4)
# ---------------------------------------------------------------------------

PREVIEW_ORDER = ["obs_year", "o_orderpriority", "c_mktsegment", "l_returnflag", "quantity", "discount_pct",
                 "expected", "actual", "dataset"]


@register("preview", X.with_views("""
SELECT *, (SELECT count(*) FROM (SELECT 1 FROM experience LIMIT 501) c) > 500 AS truncated
FROM (SELECT * FROM experience ORDER BY obs_year, o_orderpriority, c_mktsegment, l_returnflag, quantity,
      discount_pct, expected, actual, dataset LIMIT 500) h
""", experience=X.EXPERIENCE_SQL))
def q_preview(spark, sf_dir):
    e = X.experience(spark, sf_dir)
    return LM.with_truncation_flag(e, LM.PREVIEW_ROW_CAP, order=PREVIEW_ORDER)


BOUNDED_SQL = ("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem "
               "ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag LIMIT 1200")


@register("bounded_query", f"""
SELECT *, true AS truncated FROM ({BOUNDED_SQL}) q
ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag LIMIT 1000
""")
def q_bounded_query(spark, sf_dir):
    if not LM.is_bounded_select(BOUNDED_SQL):
        raise ValueError("not a bounded select")
    # the table is bound as a DataFrame parameter: no session-wide temp view is created
    df = spark.sql(BOUNDED_SQL.replace("FROM lineitem", "FROM {lineitem}"),
                   lineitem=X.table(spark, sf_dir, "lineitem"))
    return LM.with_truncation_flag(df, LM.QUERY_ROW_CAP,
                                   order=["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"])


def _tree_oracle_sql(depth: int = 3, min_split: int = 20, min_bucket: int = 7, cp: float = 0.001,
                     source: str = "experience", offset: str = "expected", route_rows: bool = False,
                     node_stats: bool = False, feats: list | None = None, rules: str | None = None) -> str:
    """Greedy Poisson-tree growth unrolled level by level in SQL (no pruning step).

    Independent of the Spark code path: per level it ranks candidate cuts per
    (node, feature) with window running sums and routes every cell to its child.
    """
    feats = feats or [("c_mktsegment", False), ("l_returnflag", False), ("quantity", True), ("discount_pct", True)]
    names = [n for n, _ in feats]
    plain, of_a = ", ".join(names), ", ".join("a." + n for n in names)
    ctes = {
        "experience": X.EXPERIENCE_SQL,
        "predictions": X.PREDICTIONS_SQL,
        "cells": f"""SELECT {plain}, sum({offset}) AS t, sum(actual) AS y
                    FROM {source} WHERE dataset = 'TRAIN' GROUP BY {plain}""",
        "a0": "SELECT *, CAST(1 AS BIGINT) AS node FROM cells",
        "root": "SELECT sum(y) / sum(t) AS rate FROM cells",
    }

    def nstats(a):
        return f"""SELECT node, count(*) AS n, sum(y) AS Y, sum(t) AS T,
                   sum(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END) AS A,
                   sum(CASE WHEN y > 0 AND t > 0 THEN y * ln(t) ELSE 0 END) AS B
                   FROM {a} GROUP BY node"""

    def dev(s):
        return f"""SELECT s.*, (1 + Y) / (1 / root.rate + T) AS lam,
                   2 * (A - B - CASE WHEN Y > 0 THEN Y * ln((1 + Y) / (1 / root.rate + T)) ELSE 0 END
                        - Y + (1 + Y) / (1 / root.rate + T) * T) AS dev
                   FROM {s} s, root"""

    ctes["ns0"] = nstats("a0")
    ctes["nd0"] = dev("ns0")
    ctes["rootdev"] = "SELECT dev AS d FROM nd0 WHERE node = 1"
    val = "CASE b.f " + " ".join(
        f"WHEN {i} THEN {'NULL' if num else 'a.' + name}" for i, (name, num) in enumerate(feats)) + " END"
    nval = "CASE b.f " + " ".join(
        f"WHEN {i} THEN {'CAST(a.' + name + ' AS DOUBLE)' if num else 'NULL'}" for i, (name, num) in enumerate(feats)) + " END"
    for k in range(depth):
        a, nxt = f"a{k}", f"a{k + 1}"
        if k > 0:
            ctes[f"ns{k}"] = nstats(a)
            ctes[f"nd{k}"] = dev(f"ns{k}")
        ctes[f"act{k}"] = (f"SELECT node FROM nd{k}, rootdev WHERE node >= {2 ** k} AND n >= {min_split} "
                           f"AND dev > {cp} * rootdev.d")
        ctes[f"lng{k}"] = " UNION ALL ".join(
            f"SELECT node, {i} AS f, {'CAST(' + name + ' AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS nv, "
            f"{'CAST(NULL AS VARCHAR)' if num else name} AS sv, t, y FROM {a} WHERE node IN (SELECT node FROM act{k})"
            for i, (name, num) in enumerate(feats))
        ctes[f"st{k}"] = (f"SELECT node, f, nv, sv, sum(t) AS t, sum(y) AS y, count(*) AS n, "
                          f"coalesce(nv, CASE WHEN sum(t) > 0 THEN sum(y) / sum(t) ELSE 'Infinity'::DOUBLE END) AS ord "
                          f"FROM lng{k} WHERE nv IS NOT NULL OR sv IS NOT NULL GROUP BY 1, 2, 3, 4")
        ctes[f"run{k}"] = f"""SELECT node, f, nv, sv, row_number() OVER w AS pos, lead(nv) OVER w AS next_nv,
               sum(t) OVER wr AS lt, sum(y) OVER wr AS ly, sum(n) OVER wr AS ln,
               sum(t) OVER wa AS st, sum(y) OVER wa AS sy, sum(n) OVER wa AS sn
            FROM st{k}
            WINDOW w AS (PARTITION BY node, f ORDER BY ord, sv),
                   wr AS (PARTITION BY node, f ORDER BY ord, sv ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                   wa AS (PARTITION BY node, f)"""
        ctes[f"cand{k}"] = (f"SELECT *, {_ylogy('ly', 'lt')} + {_ylogy('sy - ly', 'st - lt')} - {_ylogy('sy', 'st')} AS imp, "
                            f"(nv + next_nv) / 2.0 AS cut, "
                            f"CASE WHEN lt > 0 THEN ly / lt ELSE 'Infinity'::DOUBLE END <= "
                            f"CASE WHEN st - lt > 0 THEN (sy - ly) / (st - lt) ELSE 'Infinity'::DOUBLE END AS lower_first "
                            f"FROM run{k} WHERE ln >= {min_bucket} AND sn - ln >= {min_bucket}")
        ctes[f"best{k}"] = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY imp DESC, f, pos) AS rk "
                            f"FROM cand{k} WHERE imp > 1e-12) r WHERE rk = 1")
        ctes[f"lv{k}"] = (f"SELECT r.node, r.sv FROM run{k} r JOIN best{k} b ON r.node = b.node AND r.f = b.f "
                          f"WHERE r.pos <= b.pos AND r.sv IS NOT NULL")
        in_prefix = (f"(CASE WHEN {nval} IS NOT NULL THEN {nval} < b.cut "
                     f"ELSE EXISTS (SELECT 1 FROM lv{k} l WHERE l.node = a.node AND l.sv = {val}) END)")
        ctes[nxt] = (f"SELECT {of_a}, a.t, a.y, "
                     f"CASE WHEN b.node IS NULL THEN a.node "
                     f"WHEN {in_prefix} = b.lower_first THEN 2 * a.node ELSE 2 * a.node + 1 END AS node "
                     f"FROM {a} a LEFT JOIN best{k} b ON a.node = b.node")
    ctes["leaves"] = dev(f"({nstats(f'a{depth}')})")
    body = """SELECT CAST(node AS BIGINT) AS leaf, CAST(n AS BIGINT) AS n, round(Y, 6) AS events, round(T, 6) AS exposure,
                     round(lam, 6) AS rate, round(Y / T, 6) AS ae
              FROM leaves"""
    if node_stats:
        # every node of the grown tree, level by level (ids 2^k .. 2^(k+1)-1 at level k)
        levels = [f"SELECT node, {k} AS depth, n, Y, T, lam, dev FROM nd{k} WHERE node >= {2 ** k}"
                  for k in range(depth)]
        levels.append(f"SELECT node, {depth} AS depth, n, Y, T, lam, dev FROM leaves WHERE node >= {2 ** depth}")
        ctes["all_nodes"] = " UNION ALL ".join(levels)
        body = """SELECT CAST(node AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth, CAST(n AS BIGINT) AS n,
                         round(Y, 6) AS events, round(T, 6) AS exposure, round(lam, 6) AS rate,
                         round(dev, 4) AS deviance
                  FROM all_nodes"""
    if rules:
        name = "CASE b.f " + " ".join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(feats)) + " END"
        number = " OR ".join(f"b.f = {i}" for i, (_, num) in enumerate(feats) if num) or "false"
        ctes["path0"] = "SELECT CAST(1 AS BIGINT) AS node, '' AS rule"
        for k in range(depth):
            # both sides of each winner in words, the left one named by its lower rate
            ctes[f"say{k}"] = f"""SELECT b.node, b.imp, {name} AS split_var, ({number}) AS number, b.lower_first, printf('%.10g', b.cut) AS cut,
                     (SELECT string_agg(r.sv, ', ' ORDER BY r.sv) FROM run{k} r WHERE r.node = b.node AND r.f = b.f AND (r.pos <= b.pos) = b.lower_first) AS lv
                     FROM best{k} b"""
            ctes[f"side{k}"] = " UNION ALL ".join(
                f"SELECT 2 * node + {right} AS node, node AS up, CASE WHEN number THEN split_var || CASE WHEN lower_first = {not right} THEN ' < ' ELSE ' >= ' END || cut "
                f"ELSE split_var || ' {'not ' * right}in (' || lv || ')' END AS say FROM say{k}" for right in (0, 1))
            ctes[f"path{k + 1}"] = (f"SELECT s.node, CASE WHEN p.rule = '' THEN s.say ELSE p.rule || ' & ' || s.say END AS rule "
                                    f"FROM side{k} s JOIN path{k} p ON s.up = p.node")
        every = " UNION ALL ".join(f"SELECT * FROM path{k}" for k in range(depth + 1))
        body = f"""SELECT CAST(l.node AS BIGINT) AS leaf, p.rule, CAST(n AS BIGINT) AS n, round(Y, 6) AS events, round(T, 6) AS exposure,
                          round(lam, 6) AS rate, round(Y / T, 6) AS ae
                   FROM leaves l JOIN ({every}) p ON l.node = p.node"""
        if rules == "nodes":  # those above the last level, as a tree cut there
            shown = depth - 1
            levels = [f"SELECT node, {k} AS depth, n, Y, T, lam, dev FROM nd{k} WHERE node >= {2 ** k}" for k in range(depth)]
            says = " UNION ALL ".join(f"SELECT y.node, y.imp, y.split_var, s.say FROM say{k} y JOIN side{k} s ON s.node = 2 * y.node" for k in range(shown))
            body = f"""SELECT CAST(a.node AS BIGINT) AS node, CAST(depth AS INTEGER) AS depth, CAST(CASE WHEN a.node > 1 THEN a.node // 2 END AS BIGINT) AS parent,
                              split_var, say AS split, CAST(n AS BIGINT) AS n, round(Y, 6) AS events, round(T, 6) AS exposure, round(lam, 6) AS rate,
                              round(dev, 4) AS deviance, say IS NULL AS is_leaf, round(imp, 4) AS improve
                       FROM ({" UNION ALL ".join(levels)}) a LEFT JOIN ({says}) s ON a.node = s.node"""
    if route_rows:
        # send every row of the source (both splits) down the same winners
        ctes["r0"] = f"SELECT dataset, {plain}, {offset} AS t, actual AS y, " \
                     f"CAST(1 AS BIGINT) AS node FROM {source}"
        for k in range(depth):
            in_prefix = (f"(CASE WHEN {nval} IS NOT NULL THEN {nval} < b.cut "
                         f"ELSE EXISTS (SELECT 1 FROM lv{k} l WHERE l.node = a.node AND l.sv = {val}) END)")
            ctes[f"r{k + 1}"] = (f"SELECT a.dataset, {of_a}, a.t, a.y, "
                                 f"CASE WHEN b.node IS NULL THEN a.node "
                                 f"WHEN {in_prefix} = b.lower_first THEN 2 * a.node ELSE 2 * a.node + 1 END AS node "
                                 f"FROM r{k} a LEFT JOIN best{k} b ON a.node = b.node")
        body = f"""SELECT dataset, CAST(node AS BIGINT) AS leaf, round(sum(y), 6) AS actual, round(sum(t), 6) AS expected,
                          round(sum(y) / nullif(sum(t), 0), 6) AS ae
                   FROM r{depth} GROUP BY 1, 2"""
    return X.with_views(body, **ctes)


@register("residual_tree_leaf_stats", _tree_oracle_sql(source="predictions", offset="MODEL_PRED"))
def q_residual_tree_leaf_stats(spark, sf_dir):
    """MOD-14 on the scored training rows: leaf cells, events, expected (MODEL_PRED), rate, A/E."""
    leaves = _residual_tree(spark, sf_dir).leaves_df(spark)
    return leaves.select("leaf", "n", r6("events"), r6("exposure"), r6("rate"), r6("ae"))


@register("tree_leaf_stats", _tree_oracle_sql())
def q_tree_leaf_stats(spark, sf_dir):
    """Leaves of the depth-3 training tree: cells, events, exposure, shrunk rate, A/E."""
    leaves = _train_tree(spark, sf_dir).leaves_df(spark)
    return leaves.select("leaf", "n", r6("events"), r6("exposure"), r6("rate"), r6("ae"))


@register("tree_leaf_ae", _tree_oracle_sql(route_rows=True))
def q_tree_leaf_ae(spark, sf_dir):
    """Leaves of the training tree applied to every row (a generated CASE), A/E by split."""
    tree = _train_tree(spark, sf_dir)
    e = X.experience(spark, sf_dir)
    a = M.ae(e.withColumn("leaf", tree.leaf_column(e)), "actual", "expected", by=["dataset", "leaf"])
    return a.select("dataset", "leaf", r6("actual"), r6("expected"), r6("ae"))


def _lambda_max_sql() -> str:
    cols = MD.fixed_columns_sql()
    cells = ("SELECT c_mktsegment, l_returnflag, quantity, discount_pct, sum(expected) AS t, sum(actual) AS y "
             "FROM experience WHERE dataset = 'TRAIN' GROUP BY 1, 2, 3, 4")
    parts = []
    for name, expr in cols:
        parts.append(f"""SELECT '{name}' AS term,
               round(abs(sum(({expr}) * (y - t * tot.r))) / (tot.n * sqrt(sum(({expr}) * ({expr})) / tot.n
                     - power(sum({expr}) / tot.n, 2))), 6) AS grad
            FROM cells, rng, tot GROUP BY tot.n, tot.r""")
    return ("WITH experience AS (" + X.EXPERIENCE_SQL + ")," + MD.FIXED_RANGES_SQL + ",\n"
            + f"cells AS ({cells}),\n"
            + "tot AS (SELECT count(*) AS n, sum(y) / sum(t) AS r FROM cells)\n"
            + "\nUNION ALL\n".join(parts))


@register("lasso_lambda_max", _lambda_max_sql())
def q_lasso_lambda_max(spark, sf_dir):
    """MOD-9 scaling: standardised null-model score per design column (max = lambda_max)."""
    from expstudy.operators import lasso as L

    model = MD.fixed_model(spark, sf_dir)
    cells = M.cells(MD.train_rows(spark, sf_dir), MD.X_VARS, "expected", "actual")
    dcells = L.design_cells(cells, MD.X_VARS, "expected", "actual", model.design, is_cells=True)
    rows = L.null_gradients(dcells, model.design)
    return spark.createDataFrame([(n, round(g, 6)) for n, g in rows], "term string, grad double")


GRID = 5


@register("lambda_grid", "WITH RECURSIVE " + _lambda_max_sql().removeprefix("WITH ").replace("tot AS (SELECT", "tot AS (SELECT", 1).replace(
    "\nSELECT 'c_mktsegmentBUILDING'", "\n, grads AS (SELECT 'c_mktsegmentBUILDING'", 1) + f""")
SELECT CAST(k + 1 AS INTEGER) AS lambda_ix, round(lm * power(CASE WHEN n > p THEN 1e-4 ELSE 1e-2 END, k / {GRID - 1}.0), 6) AS lambda, round(nulldev, 3) AS nulldev
FROM (SELECT max(grad) AS lm, count(*) AS p FROM grads), tot,
  (SELECT 2 * sum(CASE WHEN y > 0 THEN y * ln(y / (t * r)) ELSE 0 END - y + t * r) AS nulldev FROM cells, tot), range({GRID}) g(k)
""")
def q_lambda_grid(spark, sf_dir):
    """MOD-9: the penalties of a short path and the null deviance."""
    from expstudy.operators import lasso as L

    model = MD.fixed_model(spark, sf_dir)
    cells = M.cells(MD.train_rows(spark, sf_dir), MD.X_VARS, "expected", "actual")
    path = L.fit_lasso_path(L.design_cells(cells, MD.X_VARS, "expected", "actual", model.design, is_cells=True).persist(),
                            model.design, nlambda=GRID)
    return spark.createDataFrame([(i + 1, round(float(x), 6), round(float(path.nulldev), 3)) for i, x in enumerate(path.lambdas)],
                                 "lambda_ix int, lambda double, nulldev double")


@register("tree_node_stats", _tree_oracle_sql(node_stats=True))
def q_tree_node_stats(spark, sf_dir):
    """MOD-17 numbers of every node of the depth-3 training tree: cells, events, exposure,
    shrunk rate and deviance."""
    nodes = _train_tree(spark, sf_dir).nodes_df(spark)
    return nodes.select("node", "depth", "n", r6("events"), r6("exposure"), r6("rate"), r6("deviance", 4))


@register("tree_leaves", _tree_oracle_sql(rules="leaves"))
def q_tree_leaves(spark, sf_dir):
    """MOD-17: leaves of the training tree with their rule paths."""
    return _ruled(_train_tree(spark, sf_dir).leaves_df(spark))


@register("residual_tree", _tree_oracle_sql(source="predictions", offset="MODEL_PRED", rules="leaves"))
def q_residual_tree(spark, sf_dir):
    """MOD-14, MOD-17: leaves of the tree on scored rows with their rule paths."""
    return _ruled(_residual_tree(spark, sf_dir).leaves_df(spark))


@register("tree_snipped", _tree_oracle_sql(rules="nodes"))
def q_tree_snipped(spark, sf_dir):
    """MOD-18: the training tree cut below its second level, splits in words."""
    nodes = _train_tree(spark, sf_dir).snip(2).nodes_df(spark)
    return nodes.select("node", "depth", "parent", "split_var", "split", "n", r6("events"), r6("exposure"), r6("rate"), r6("deviance", 4),
                        "is_leaf", r6("improve", 4))


MANY_SQL = f"(SELECT *, 'order ' || CAST(l_orderkey AS VARCHAR) AS order_name FROM ({X.EXPERIENCE_SQL.replace('SELECT CAST(year', 'SELECT l_orderkey, CAST(year', 1)}) e)"


@register("tree_many_levels", _tree_oracle_sql(depth=2, source=MANY_SQL, feats=[("order_name", False), ("quantity", True)], route_rows=True))
def q_tree_many_levels(spark, sf_dir):
    """MOD-15 on a string predictor with a level for each order: splits by join, applied to all rows, A/E by leaf."""
    e = X.experience(spark, sf_dir, with_order=True)
    e = e.withColumn("order_name", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")))
    tree = TR.poisson_tree(e.filter(F.col("dataset") == "TRAIN"), ["order_name", "quantity"], "expected", "actual", max_depth=2, cp=0.001)
    a = M.ae(tree.assign_leaves(e), "actual", "expected", by=["dataset", "leaf"])
    return a.select("dataset", "leaf", r6("actual"), r6("expected"), r6("ae"))
