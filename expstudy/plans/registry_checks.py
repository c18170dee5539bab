"""Registered queries of guards, set logic and logs (PRJ-9, JN-6, AGG-12, LIM-6, SET-1, SET-4, LIN-7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from expstudy.functions.ranking import running_sums_within
from expstudy.operators import lineage as LN
from expstudy.operators import limits as LM
from expstudy.operators import measures as M
from expstudy.operators import prepare as P
from expstudy.operators.design import check_factors, validate_model_view
from expstudy.plans import fixtures as X
from expstudy.plans.registry import register, r6


@register("exposure_guard", X.with_views("""
SELECT dirty, CAST(count(*) FILTER (WHERE coalesce(t, 0) <= 0) AS BIGINT) AS n_bad, bool_or(coalesce(t, 0) <= 0) AS refused
FROM (SELECT true AS dirty, c_mktsegment, l_linenumber, sum(expected) AS t FROM experience GROUP BY 2, 3
      UNION ALL SELECT false, c_mktsegment, CAST(l_linenumber AS INTEGER), sum(expected) FROM experience WHERE l_linenumber <> 7 GROUP BY 2, 3) c
GROUP BY 1
""", experience=X.EXPERIENCE_DIRTY_SQL))
def q_exposure_guard(spark, sf_dir):
    """PRJ-9: cells with a missing or non-positive offset, and whether the guard refuses them."""
    rows = []
    for dirty in (True, False):
        e = X.experience(spark, sf_dir, dirty=True)
        cells = M.cells(e if dirty else e.filter("l_linenumber <> 7"), ["c_mktsegment", "l_linenumber"], "expected", "actual")
        n = P.count_non_positive(cells, "expected")
        try:
            P.assert_positive_exposure(cells, "expected")
            refused = False
        except ValueError:
            refused = True
        rows.append((dirty, n, refused))
    return spark.createDataFrame(rows, "dirty boolean, n_bad long, refused boolean")


DECLARED = ["c_mktsegment", "l_returnflag", "o_orderpriority", "quantity", "obs_year"]


@register("declared_factors", X.with_views("\nUNION ALL\n".join(
    f"SELECT '{v}' AS variable, any_value(typeof({v})) = 'VARCHAR' AS accepted, CAST(count(DISTINCT {v}) AS BIGINT) AS n_values FROM experience"
    for v in DECLARED), experience=X.EXPERIENCE_SQL))
def q_declared_factors(spark, sf_dir):
    """JN-6: which predictors may be declared as factors, with their distinct values."""
    e = X.experience(spark, sf_dir)
    counts = e.agg(*[F.countDistinct(v).alias(v) for v in DECLARED]).first()
    rows = []
    for v in DECLARED:
        try:
            check_factors(e, DECLARED, {v: "x"})
            rows.append((v, True, counts[v]))
        except ValueError:
            rows.append((v, False, counts[v]))
    return spark.createDataFrame(rows, "variable string, accepted boolean, n_values long")


@register("predictor_columns", X.with_views("\nUNION ALL\n".join(
    f"SELECT '{v}' AS predictor, CAST(count({v}) AS BIGINT) AS n_values FROM experience"
    for v in ["obs_year", "o_orderpriority", "c_mktsegment", "l_returnflag", "quantity", "discount_pct", "l_linenumber"]),
    experience=X.EXPERIENCE_DIRTY_SQL))
def q_predictor_columns(spark, sf_dir):
    """SET-1: the columns of a model view without offset, target and split, with their known values."""
    e = X.experience(spark, sf_dir, dirty=True)
    names = validate_model_view(e, "ACTUAL", "EXPECTED", "dataset")
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("predictor"), F.col(v).isNotNull().cast("long").alias("known")) for v in names]))
    return e.select(pairs.alias("p")).groupBy("p.predictor").agg(F.sum("p.known").alias("n_values"))


@register("first_seen_values", X.with_views("""
SELECT string_agg(o_orderpriority, ',' ORDER BY first) AS priorities
FROM (SELECT o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1) f
"""))
def q_first_seen_values(spark, sf_dir):
    """SET-4: distinct order priorities in the order of their first order."""
    seen = M.first_seen(X.table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])
    return seen.select(F.array_join("values", ",").alias("priorities"))


#: Where the tail of the rate path begins: at half its length.
TAIL = 25


@register("tail_threshold", X.with_views(f"""
SELECT round(sd, 6) AS sd, round(exp(ln(top) - sd), 6) AS threshold, CAST(max(CASE WHEN ae <= exp(ln(top) - sd) THEN quantity END) AS INTEGER) AS last_index
FROM path, (SELECT stddev_samp(ln(ae)) AS sd, max(ae) AS top FROM path WHERE quantity >= {TAIL}) t GROUP BY sd, top
""", experience=X.EXPERIENCE_SQL, path="""
SELECT quantity, sum(sum(actual)) OVER (ORDER BY quantity) / sum(sum(expected)) OVER (ORDER BY quantity) AS ae
FROM experience WHERE dataset = 'TRAIN' GROUP BY 1 HAVING sum(actual) > 0
"""))
def q_tail_threshold(spark, sf_dir):
    """AGG-12, LIM-6: on the path of A/E up to each quantity, the sample sd of ln A/E over the tail, the largest
    value less one sd, and the last place at or below it."""
    by = X.experience(spark, sf_dir, split="TRAIN").groupBy("quantity").agg(F.sum("actual").alias("a"), F.sum("expected").alias("e"))
    run = running_sums_within(by.filter("a > 0").withColumn("all", F.lit(1)), ["all"], ["quantity"], ["a", "e"])
    path = run.select("quantity", (F.col("cum_a") / F.col("cum_e")).alias("ae"))
    tail = M.tail_log_sd(path, "ae", "quantity", TAIL)
    at = tail.select("sd", F.exp(F.log("top") - F.col("sd")).alias("threshold")).first()
    last = LM.last_index_where(path, "quantity", F.col("ae") <= at["threshold"])
    return spark.createDataFrame([(at["sd"], at["threshold"], last)], "sd double, threshold double, last_index int").select(
        r6("sd"), r6("threshold"), "last_index")


@register("sql_log", """
SELECT CAST(row_number() OVER (ORDER BY turn, conv_id) AS INTEGER) AS position, CAST(conv_id * 100 + turn AS BIGINT) AS node, md5(text) AS sql_md5
FROM conversations WHERE role = 'user' AND turn > 0
""")
def q_sql_log(spark, sf_dir):
    """LIN-7: the queries of the log (here what users wrote) in creation order."""
    log = X.lineage_log(spark, sf_dir).filter(F.col("args").isNotNull())
    user = X.table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("node"))
    asked = log.join(user, "node", "left_semi").select("node", "conv_id", "created", F.get_json_object("args", "$[1]").alias("sql"))
    return LN.in_creation_order(asked, ["created", "conv_id"]).select("position", "node", F.md5("sql").alias("sql_md5"))
