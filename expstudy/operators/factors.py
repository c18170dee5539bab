"""Rating-factor tables of a fitted model (MOD-19 .. MOD-22, JN-1 .. JN-3, STR-6, WIN-4).

For each term group (the design columns over the same ordered variables) the
table lists every combination of the group's values - numeric predictors by 1
over their clip range, factors over all levels - with the other predictors at
typical values (first level; floor of the mid-range).  ``contribution_log`` is
the sum of basis value times coefficient over **this group's columns only**, and
``contribution_multiplier`` its exponential.  Grid columns that do not vary are
dropped.

Spark plan: the grid is a one-row frame expanded by one ``explode`` per
variable (a generator, not a join; its size is fixed by the model spec, not by
data).  The coefficients are literals of one expression over the basis columns, which
stands for the two left joins of an unpivoted table (JN-1: a missing estimate is 0;
JN-2: a missing contribution is 0) and the sum per grid row (AGG-14).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expstudy.functions.ranking import row_number_within
from expstudy.operators.score import GlmModel

# Output-name rules (characters not allowed in a sheet name, length cap).
NAME_MAX = 31
NAME_BAD_CHARS = r"[\[\]\*:\?/\\]"
NAME_EMPTY = "Sheet"


def coefficient_table(model: GlmModel, spark: SparkSession) -> DataFrame:
    """MOD-19: dense (term, estimate) with zeros included, intercept first."""
    return spark.createDataFrame(model.coefficient_rows(), "term string, estimate double")


def term_map_df(model: GlmModel, spark: SparkSession) -> DataFrame:
    """MOD-20: design column -> term group and its variables."""
    return spark.createDataFrame(model.design.term_map(), "term_name string, term_group string, vars_in_group string")


def overview(model: GlmModel, spark: SparkSession, model_path: str = "") -> DataFrame:
    """MOD-22: formula text, intercept, model path."""
    formula = " + ".join(t.label() for t in model.design.terms) + " - 1"
    rows = [("formula", formula), ("intercept", repr(float(model.intercept))), ("model_path", model_path)]
    return spark.createDataFrame(rows, "item string, value string")


def _typical(model: GlmModel, var: str):
    rec = model.design.recipe
    if var in rec.levels:
        return F.lit(rec.levels[var][0] if rec.levels[var] else None).cast("string")
    lo, hi = rec.ranges[var]
    return F.lit(int(math.floor((lo + hi) / 2.0))).cast("double")


def group_grid(model: GlmModel, spark: SparkSession, vars_: list[str]) -> DataFrame:
    """JN-3 + SEQ-1: all combinations of the group's values (levels, or whole steps of the range)."""
    rec = model.design.recipe
    g = spark.range(1).select()
    for v in vars_:
        if v in rec.levels:
            vals = F.array(*[F.lit(x) for x in rec.levels[v]])
        else:
            lo, hi = rec.ranges[v]
            vals = F.transform(F.sequence(F.lit(0), F.lit(int(math.floor(hi - lo)))),
                               lambda k: (F.lit(lo) + k).cast("int"))
        g = g.select("*", F.explode(vals).alias(v))
    return g


def factor_table(model: GlmModel, spark: SparkSession, group: str) -> DataFrame:
    """MOD-21 for one term group: the group's part of the linear predictor as one column
    expression over its grid - no shuffle, the other variables at typical values."""
    mine = [(n, v) for n, g, v in model.design.term_map() if g == group]
    if not mine:
        raise KeyError(f"no term group {group}")
    vars_ = mine[0][1].split("|")
    full = group_grid(model, spark, vars_).withColumns({v: _typical(model, v) for v in model.design.variables if v not in vars_})
    names = {n for n, _ in mine}
    parts = [F.lit(float(b)) * x for n, b, x in zip(model.design.names, model.coefs, model.design.basis(full)) if n in names and b]
    log = reduce(lambda x, y: x + y, parts) if parts else F.lit(0.0)
    return full.select(*[v for v in vars_ if _varies(model, v)], log.cast("double").alias("contribution_log"),
                       F.exp(log.cast("double")).alias("contribution_multiplier"))


def _varies(model: GlmModel, v: str) -> bool:
    rec = model.design.recipe
    if v in rec.levels:
        return len(set(rec.levels[v])) > 1
    lo, hi = rec.ranges[v]
    return math.floor(hi - lo) >= 1


def factor_tables(model: GlmModel, spark: SparkSession) -> dict[str, DataFrame]:
    """MOD-21: one table per term group, in design order."""
    groups = []
    for _, g, _ in model.design.term_map():
        if g not in groups:
            groups.append(g)
    return {g: factor_table(model, spark, g) for g in groups}


def factor_tables_long(model: GlmModel, spark: SparkSession) -> DataFrame:
    """All groups stacked (SET-3): ``term_group, level_key, contribution_log, contribution_multiplier``.

    ``level_key`` is ``var=value`` pairs joined by ``|`` so every group fits one
    schema; writers partition this frame by ``term_group``.
    """
    frames = []
    for g, df in factor_tables(model, spark).items():
        vars_ = [c for c in df.columns if c not in ("contribution_log", "contribution_multiplier")]
        key = F.concat_ws("|", *[F.concat(F.lit(f"{v}="), F.col(v).cast("string")) for v in vars_]) if vars_ else F.lit("")
        frames.append(df.select(F.lit(g).alias("term_group"), key.alias("level_key"),
                                "contribution_log", "contribution_multiplier"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _named(d: DataFrame, out: str) -> DataFrame:
    suffix = F.concat(F.lit("_"), F.col("__dup").cast("string"))
    cut = F.expr(f"substring(__base, 1, greatest(1, {NAME_MAX} - length(concat('_', cast(__dup AS string)))))")
    return d.withColumn(out, F.when(F.col("__dup") == 0, F.col("__base")).otherwise(F.concat(cut, suffix)))


def sheets(model: GlmModel, spark: SparkSession) -> DataFrame:
    """SNK-5: the stacked factor tables with a safe, unique ``sheet`` name per term group."""
    groups = list(dict.fromkeys(g for _, g, _ in model.design.term_map()))
    names = safe_names(spark.createDataFrame(list(enumerate(groups)), "ix long, term_group string"), "term_group", "ix", out="sheet")
    return factor_tables_long(model, spark).join(F.broadcast(names.drop("ix")), "term_group")


#: Suffixes that a row whose name is taken tries in one round.
SUFFIXES_TRIED = 64


def safe_names(df: DataFrame, col: str, order: str, out: str = "safe_name") -> DataFrame:
    """STR-6 + WIN-4: sheet-safe unique names.

    ``[]*:?/\\`` -> ``_``, trim, empty -> ``Sheet``, cut to 31 characters; a
    repeated name gets ``_1``, ``_2``, ... (in ``order``, unique per row) with the
    base re-cut so the result fits 31 characters.  Works on a column of names (one
    row per output); the duplicate index is a skew-safe row number, so a name
    repeated on a third of the rows is still numbered across many tasks.

    A generated name can meet an original one (``A``, ``A``, ``A_1``).  Then the
    earliest row keeps the name, and each other row moves on to its first suffix
    that no earlier row holds, round after round, until all names are unique.  A
    name once held by an earlier row stays held by one, so the result is that of
    naming the rows one by one in ``order``.  A round is aggregates and joins,
    checkpointed; every round moves at least one row on, so the rounds end.
    """
    from expstudy.session import reliable_checkpoint

    clean = F.trim(F.regexp_replace(F.col(col), NAME_BAD_CHARS, "_"))
    clean = F.when((clean == "") | clean.isNull(), F.lit(NAME_EMPTY)).otherwise(clean)
    base = F.substring(clean, 1, NAME_MAX)
    d = row_number_within(df.withColumn("__base", base), ["__base"], [order], out="__rn")
    d = reliable_checkpoint(_named(d.withColumn("__dup", F.col("__rn") - 1).drop("__rn"), out))
    while True:
        held = reliable_checkpoint(d.groupBy(out).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")))
        if held.filter(F.col("__n") > 1).isEmpty():
            return d.drop("__base", "__dup")
        late = (d.select(F.col(order).alias("__row"), "__base", "__dup", out)
                .join(held.filter(F.col("__n") > 1), out).filter(F.col("__row") != F.col("__first")))
        tries = F.explode(F.sequence(F.col("__dup") + 1, F.col("__dup") + F.lit(SUFFIXES_TRIED)))
        tries = _named(late.select("__row", "__base", F.col("__dup").alias("__was"), tries.alias("__dup")), out)
        free = tries.join(held.select(out, "__first"), out, "left").groupBy("__row").agg(
            F.coalesce(F.min(F.when(F.col("__first").isNull() | (F.col("__first") > F.col("__row")), F.col("__dup"))),
                       F.max("__dup") + 1).alias("__next"))
        d = d.join(free, F.col(order) == F.col("__row"), "left").withColumn("__dup", F.coalesce("__next", "__dup"))
        d = reliable_checkpoint(_named(d.drop("__row", "__next", out), out))
