"""Poisson regression tree over exposure cells (MOD-14 .. MOD-18).

Semantics follow recursive partitioning with the Poisson method: each cell has
exposure ``t`` (the offset) and events ``y``; a split maximises

    improve = Y_L ln(Y_L/T_L) + Y_R ln(Y_R/T_R) - Y ln(Y/T)     (0 ln 0 = 0)

(half the deviance drop).  Numeric predictors split at midpoints between
adjacent distinct values; string predictors are unordered factors whose levels
are ordered by rate, which is optimal for a two-way Poisson split.  The child
with the lower rate is the left child (id 2k), the other the right (2k+1).
Node counts ``n`` are cells, not source rows.  A node needs ``min_split`` cells
to be split and each child ``min_bucket`` cells (defaults 20 and 7).  The node
rate is shrunk towards the root rate with a gamma prior of coefficient of
variation 1: ``(1 + Y) / (1/rate_root + T)``; node deviance uses that rate.
After growth the tree is pruned by weakest-link cost complexity at
``cp * root deviance``.

Deviation (stated): a missing predictor value follows the side that received
more cells (no surrogate splits).

Spark plan per level: the persisted cells carry a ``node`` column; the active
cells are unpivoted to ``(node, feature, value)`` with one ``explode`` of a
struct array (numeric and string values share one shuffle), grouped with a
partial hash aggregate, given running sums in split order, and reduced to one
winner per node with ``min(struct(...))``.  Only per-(node, feature) totals
and the winners (at most 2^depth x features rows) reach the driver.  The
running sums are range-partitioned at every size
(``functions.ranking.running_sums_within``), so no task holds all values of
one feature.

The sides of a string split stay a table ``(node, level, left)`` in the checkpoint
folder: cells meet their level by a join, which is a broadcast only where the
table has at most ``MOST_LEVELS`` rows.  The driver holds the names of a left side
of at most ``NAMED`` levels, for rule texts and the CASE of ``leaf_column``; larger
sides are counted, and ``assign_leaves`` applies them by the same join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from expstudy.functions.ranking import running_sums_within
from expstudy.schema import resolve_col, resolve_cols
from expstudy.session import reliable_checkpoint

# Limits of the external tree call and library defaults.
MAX_TREE_VARS = 5
MAX_TREE_DEPTH = 4
MIN_CP = 0.0001
DEFAULT_MIN_SPLIT = 20
PRIOR_CV = 1.0

# rows of a level's side table that are broadcast; levels of a side that are named on the driver
MOST_LEVELS = 1_000_000
NAMED = 1000

_EPS = 1e-12


def check_tree_args(x_vars, max_depth: int, cp: float) -> float:
    """MOD-16: at most 5 predictors and depth 4; cp raised to at least 0.0001."""
    if len(x_vars) > MAX_TREE_VARS:
        raise ValueError(f"at most {MAX_TREE_VARS} x_vars are allowed")
    if max_depth > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth must be <= {MAX_TREE_DEPTH}")
    return max(cp, MIN_CP)


@dataclass
class NodeStats:
    node: int
    n: int
    y: float
    t: float
    s_ylny: float
    s_ylnt: float
    rate: float = float("nan")
    deviance: float = float("nan")


@dataclass
class Split:
    node: int
    feature: str
    kind: str  # "num" or "str"
    cut: float | None = None
    left_lt: bool = True  # numeric: left child is x < cut (else x >= cut)
    left_levels: list | None = field(default_factory=list)  # None: more than NAMED, see PoissonTree.sides
    n_left_levels: int = 0
    null_left: bool = True
    improve: float = 0.0

    def describe(self, left: bool) -> str:
        if self.kind == "num":
            lt = self.left_lt if left else not self.left_lt
            return f"{self.feature} {'<' if lt else '>='} {_fmt(self.cut)}"
        op = "in" if left else "not in"
        names = f"{self.n_left_levels} levels" if self.left_levels is None else ", ".join(str(v) for v in sorted(self.left_levels))
        return f"{self.feature} {op} ({names})"

    def goes_left(self, col):
        """Column condition for the left child (NULL follows the majority side); needs named levels."""
        if self.left_levels is None:
            raise ValueError(f"the split on {self.feature} has {self.n_left_levels} levels on its left; use assign_leaves")
        if self.kind == "num":
            cond = col < F.lit(self.cut) if self.left_lt else col >= F.lit(self.cut)
        else:
            cond = col.isin(list(self.left_levels))
        return F.when(col.isNull(), F.lit(self.null_left)).otherwise(cond)


def _fmt(v: float) -> str:
    return f"{v:.10g}"


def _depth(node: int) -> int:
    return int(math.floor(math.log2(node)))


@dataclass
class PoissonTree:
    x_vars: list
    nodes: dict  # node id -> NodeStats (grown tree)
    splits: dict  # node id -> Split (after pruning)
    root_rate: float
    cp: float
    max_depth: int
    complexity: dict = field(default_factory=dict)
    sides: DataFrame | None = None  # (node, level, left) of the string splits

    # --- structure -------------------------------------------------------
    def is_leaf(self, k: int) -> bool:
        return k not in self.splits

    def kept_nodes(self) -> list[int]:
        out, todo = [], [1]
        while todo:
            k = todo.pop()
            out.append(k)
            if k in self.splits:
                todo += [2 * k, 2 * k + 1]
        return sorted(out)

    def leaves(self) -> list[int]:
        return [k for k in self.kept_nodes() if self.is_leaf(k)]

    def rule(self, k: int) -> str:
        parts = []
        while k > 1:
            p = k // 2
            parts.append(self.splits[p].describe(left=(k == 2 * p)))
            k = p
        return " & ".join(reversed(parts))

    # --- outputs ---------------------------------------------------------
    def nodes_df(self, spark: SparkSession) -> DataFrame:
        """MOD-17: one row per kept node."""
        rows = []
        for k in self.kept_nodes():
            s = self.nodes[k]
            sp = self.splits.get(k)
            rows.append((k, _depth(k), k // 2 if k > 1 else None, sp.feature if sp else None,
                         (sp.describe(True) if sp else None), int(s.n), float(s.y), float(s.t),
                         float(s.rate), float(s.deviance), sp is None,
                         float(sp.improve) if sp else None, float(self.complexity.get(k, 0.0))))
        schema = ("node long, depth int, parent long, split_var string, split string, n long, "
                  "events double, exposure double, rate double, deviance double, is_leaf boolean, "
                  "improve double, complexity double")
        return spark.createDataFrame(rows, schema)

    def leaves_df(self, spark: SparkSession) -> DataFrame:
        """MOD-17: one row per leaf with its rule path."""
        rows = []
        for k in self.leaves():
            s = self.nodes[k]
            rows.append((k, self.rule(k), int(s.n), float(s.y), float(s.t), float(s.rate),
                         float(s.y / s.t) if s.t > 0 else None))
        return spark.createDataFrame(
            rows, "leaf long, rule string, n long, events double, exposure double, rate double, ae double")

    def leaf_column(self, df: DataFrame):
        """A Column giving the leaf id of each row of ``df`` (a nested CASE)."""
        def build(k):
            if k not in self.splits:
                return F.lit(k).cast("long")
            sp = self.splits[k]
            col = F.col(resolve_col(df, sp.feature))
            return F.when(sp.goes_left(col), build(2 * k)).otherwise(build(2 * k + 1))
        return build(1)

    def assign_leaves(self, df: DataFrame, out: str = "leaf") -> DataFrame:
        """``df`` with the leaf id of each row: one join with the level sides for each depth of the tree
        that has a string split.  A level that training had not at a node goes right."""
        names = {k: resolve_col(df, s.feature) for k, s in self.splits.items()}
        df = df.withColumn(out, F.lit(1).cast("long"))
        for depth in range(self.max_depth):
            own = {k: s for k, s in self.splits.items() if _depth(k) == depth}
            if own:
                df = _moved(df, own, names, out, self.sides)
        return df

    def snip(self, depth: int = 3) -> "PoissonTree":
        """MOD-18: a copy with splits at or below ``depth`` removed (for display)."""
        keep = {k: s for k, s in self.splits.items() if _depth(k) < depth}
        return PoissonTree(self.x_vars, self.nodes, keep, self.root_rate, self.cp, self.max_depth,
                           self.complexity, self.sides)

    def to_dict(self) -> dict:
        return {
            "x_vars": self.x_vars, "root_rate": self.root_rate, "cp": self.cp,
            "splits": {str(k): s.__dict__ for k, s in self.splits.items()},
        }


# ---------------------------------------------------------------------------
# growth
# ---------------------------------------------------------------------------

def _ylogy_over_t(y, t):
    return F.when((y > 0) & (t > 0), y * F.log(y / t)).otherwise(F.lit(0.0))


def _cell_terms(t_col, y_col):
    s_ylny = F.when(y_col > 0, y_col * F.log(y_col)).otherwise(F.lit(0.0))
    s_ylnt = F.when((y_col > 0) & (t_col > 0), y_col * F.log(t_col)).otherwise(F.lit(0.0))
    return s_ylny, s_ylnt


def _node_rate_dev(s: NodeStats, root_rate: float) -> None:
    alpha = 1.0 / (PRIOR_CV ** 2)
    beta = alpha / root_rate if root_rate > 0 else 0.0
    lam = (alpha + s.y) / (beta + s.t) if (beta + s.t) > 0 else float("nan")
    dev = s.s_ylny - s.s_ylnt - (s.y * math.log(lam) if s.y > 0 else 0.0) - s.y + lam * s.t
    s.rate, s.deviance = lam, 2.0 * dev


def prepare_tree_cells(df: DataFrame, x_vars, offset: str, y: str) -> DataFrame:
    """Collapse rows to cells over ``x_vars`` with exposure ``t`` and events ``y``."""
    xs = resolve_cols(df, x_vars)
    o, yy = resolve_col(df, offset), resolve_col(df, y)
    return df.groupBy(*xs).agg(F.sum(o).cast("double").alias("__t"), F.sum(yy).cast("double").alias("__y"))


def level_stats(cells: DataFrame, x_vars, numeric: dict, active=None) -> DataFrame:
    """Per (node, feature, value): exposure, events, cell count and deviance terms.

    ``cells`` has ``node, __t, __y, __a, __b`` and the predictors.  Numeric and
    string values share one shuffle through a struct ``explode``.  ``ord`` is
    the split order: the value for numerics, the level's rate for strings.
    """
    src = cells if active is None else cells.filter(F.col("node").isin(list(active)))
    entries = []
    for i, v in enumerate(x_vars):
        c = F.col(v)
        nv = c.cast("double") if numeric[v] else F.lit(None).cast("double")
        sv = F.lit(None).cast("string") if numeric[v] else c.cast("string")
        entries.append(F.struct(F.lit(i).alias("f"), nv.alias("nv"), sv.alias("sv")))
    long = src.select("node", "__t", "__y", "__a", "__b", F.explode(F.array(*entries)).alias("e"))
    long = long.filter(F.col("e.nv").isNotNull() | F.col("e.sv").isNotNull())
    stats = (long.groupBy("node", F.col("e.f").alias("f"), F.col("e.nv").alias("nv"), F.col("e.sv").alias("sv"))
             .agg(F.sum("__t").alias("t"), F.sum("__y").alias("y"), F.count(F.lit(1)).alias("n"),
                  F.sum("__a").alias("a"), F.sum("__b").alias("b")))
    rate = F.when(F.col("t") > 0, F.col("y") / F.col("t")).otherwise(F.lit(float("inf")))
    return stats.withColumn("ord", F.coalesce(F.col("nv"), rate))


def level_split_candidates(stats: DataFrame, min_bucket: int) -> DataFrame:
    """All admissible splits (one row per node, feature and cut position).

    Per-(node, feature) totals come from a small aggregate (at most
    2^depth x features rows, collected and broadcast).  The running sums are
    range-partitioned, so no task holds all values of one feature.
    """
    spark = stats.sparkSession
    tot = (stats.groupBy("node", "f")
           .agg(*[F.sum(m).alias(f"s{m}") for m in ("t", "y", "n", "a", "b")]).collect())
    if not tot:
        return None
    tot_df = spark.createDataFrame(tot, "node long, f int, st double, sy double, sn long, sa double, sb double")
    run = running_sums_within(stats, ["node", "f"], ["ord", "sv"], ["t", "y", "n", "a", "b"], next_of="nv")
    run = run.select("node", "f", "nv", "sv", "ord", "next_nv", "pos",
                     *[F.col(f"cum_{m}").alias(f"l{m}") for m in ("t", "y", "n", "a", "b")])
    run = run.join(F.broadcast(tot_df), ["node", "f"])
    for m in ("t", "y", "n", "a", "b"):
        run = run.withColumn(f"r{m}", F.col(f"s{m}") - F.col(f"l{m}"))
    improve = (_ylogy_over_t(F.col("ly"), F.col("lt")) + _ylogy_over_t(F.col("ry"), F.col("rt"))
               - _ylogy_over_t(F.col("sy"), F.col("st")))
    return (run.withColumn("admissible", (F.col("ln") >= min_bucket) & (F.col("rn") >= min_bucket))
            .withColumn("improve", improve)
            .withColumn("cut", (F.col("nv") + F.col("next_nv")) / 2.0))


def _moved(df: DataFrame, splits: dict, names: dict, node: str, sides: DataFrame | None) -> DataFrame:
    """``df`` with rows at the nodes of ``splits`` moved on to their children; ``names`` are the splits' columns."""
    texts = {k: s for k, s in splits.items() if s.kind == "str"}
    columns, at, left = df.columns, F.col(node), None
    if texts:
        level = None
        for k in texts:
            level = F.when(at == k, F.col(names[k]).cast("string")) if level is None else level.when(at == k, F.col(names[k]).cast("string"))
        own = sides.filter(F.col("node").isin(list(texts))).select(F.col("node").alias("__node"), F.col("level").alias("__level"), "left")
        if own.count() <= MOST_LEVELS:
            own = F.broadcast(own)
        df = (df.withColumn("__of", level).join(own.withColumnRenamed("left", "__left"), (at == F.col("__node")) & (F.col("__of") == F.col("__level")), "left"))
    for k, s in splits.items():
        col = F.col(names[k])
        goes = s.goes_left(col) if s.kind == "num" else F.when(col.isNull(), F.lit(s.null_left)).otherwise(F.coalesce("__left", F.lit(False)))
        to = F.when(goes, F.lit(2 * k)).otherwise(F.lit(2 * k + 1)).cast("long")
        left = F.when(at == k, to) if left is None else left.when(at == k, to)
    return df.withColumn(node, left.otherwise(at)).select(*columns)


def root_split_table(df: DataFrame, x_vars, offset: str, y: str, min_bucket: int = 7) -> DataFrame:
    """Best root split per predictor as a lazy DataFrame (one row per feature).

    ``cut`` for numeric predictors, ``left_levels`` (the lower-rate levels,
    comma-joined in sorted order, or their number beyond ``NAMED``) for string predictors.
    """
    xs = resolve_cols(df, x_vars)
    numeric = {v: isinstance(df.schema[v].dataType, T.NumericType) for v in xs}
    base = prepare_tree_cells(df, xs, offset, y)
    a, b = _cell_terms(F.col("__t"), F.col("__y"))
    cells = base.select(*xs, "__t", "__y", a.alias("__a"), b.alias("__b"), F.lit(1).cast("long").alias("node"))
    stats = level_stats(cells, xs, numeric)
    run = level_split_candidates(stats, min_bucket)
    cand = run.filter(F.col("admissible") & (F.col("improve") > _EPS))
    best = (cand.groupBy("f").agg(F.min(F.struct((-F.col("improve")).alias("neg"), "pos", "improve", "cut",
                                                 "ln", "rn")).alias("w"))
            .select("f", "w.*"))
    # ``best`` has one row per predictor: a bounded broadcast
    prefix = (run.filter(F.col("sv").isNotNull()).join(F.broadcast(best.select("f", F.col("pos").alias("wpos"))), "f")
              .filter(F.col("pos") <= F.col("wpos")))
    named = prefix.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(
        F.when(F.col("wpos") <= NAMED, F.col("sv")))), ",").alias("left_levels"))
    levels = named.select("f", F.when(F.col("n") <= NAMED, F.col("left_levels")).otherwise(
        F.concat(F.col("n").cast("string"), F.lit(" levels"))).alias("left_levels"))
    name = F.element_at(F.array(*[F.lit(v) for v in xs]), F.col("f") + 1)
    return (best.join(levels, "f", "left")
            .select(name.alias("feature"), "cut", "left_levels", "improve",
                    F.col("ln").cast("long").alias("n_left"), F.col("rn").cast("long").alias("n_right")))


def best_splits(run: DataFrame | None) -> list:
    """One winner per node: highest improvement, then feature order, then position."""
    if run is None:
        return []
    cand = run.filter(F.col("admissible"))
    payload = F.struct(
        (-F.col("improve")).alias("neg"), F.col("f"), F.col("pos"), F.col("improve"), F.col("cut"),
        F.col("ord"), *[F.col(f"{s}{m}") for s in ("l", "r") for m in ("t", "y", "n", "a", "b")])
    win = cand.filter(F.col("improve") > _EPS).groupBy("node").agg(F.min(payload).alias("w"))
    return win.select("node", "w.*").collect()


def poisson_tree(df: DataFrame, x_vars, offset: str, y: str, max_depth: int = 3, cp: float = 0.001,
                 min_split: int = DEFAULT_MIN_SPLIT, min_bucket: int | None = None,
                 checkpoint: bool = True) -> PoissonTree:
    """MOD-15: grow and prune a Poisson tree on the cells of ``df``."""
    min_bucket = int(round(min_split / 3)) if min_bucket is None else min_bucket
    xs = resolve_cols(df, x_vars)
    numeric = {v: isinstance(df.schema[v].dataType, T.NumericType) for v in xs}
    base = prepare_tree_cells(df, xs, offset, y)
    a, b = _cell_terms(F.col("__t"), F.col("__y"))
    cells = base.select(*xs, "__t", "__y", a.alias("__a"), b.alias("__b"), F.lit(1).cast("long").alias("node"))
    # checkpointed for recovery (when asked) and kept on the executors: every level reads it
    cells = (reliable_checkpoint(cells) if checkpoint else cells).persist()

    tot = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("y"), F.sum("__t").alias("t"),
                    F.sum("__a").alias("a"), F.sum("__b").alias("b")).first()
    root = NodeStats(1, int(tot["n"]), float(tot["y"] or 0), float(tot["t"] or 0),
                     float(tot["a"] or 0), float(tot["b"] or 0))
    root_rate = root.y / root.t if root.t > 0 else 0.0
    _node_rate_dev(root, root_rate)
    nodes = {1: root}
    grown: dict[int, Split] = {}
    alpha_abs = cp * root.deviance

    frontier = [1]
    current, before, sides = cells, None, None
    for depth in range(max_depth):
        active = [k for k in frontier if nodes[k].n >= min_split and nodes[k].deviance > alpha_abs]
        if not active:
            break
        stats = level_stats(current, xs, numeric, active).persist()
        run = level_split_candidates(stats, min_bucket)
        run = run.persist() if run is not None else None
        winners = best_splits(run)
        if before is not None:  # the statistics have read ``current``, which is whole by now
            before.unpersist()
            before = None
        if not winners:
            stats.unpersist()
            if run is not None:
                run.unpersist()
            break
        new_frontier = []
        str_winners = []
        pending_missing: dict = {}
        children: dict = {}
        for w in winners:
            k = int(w["node"])
            feat = xs[int(w["f"])]
            left = NodeStats(2 * k, int(w["ln"]), w["ly"], w["lt"], w["la"], w["lb"])
            right = NodeStats(2 * k + 1, int(w["rn"]), w["ry"], w["rt"], w["ra"], w["rb"])
            # rows with a NULL predictor follow the side with more cells
            missing = nodes[k].n - left.n - right.n
            lower_first = (left.y / left.t if left.t > 0 else math.inf) <= (right.y / right.t if right.t > 0 else math.inf)
            if numeric[feat]:
                sp = Split(k, feat, "num", cut=float(w["cut"]), left_lt=lower_first, improve=float(w["improve"]))
                lo, hi = (left, right) if lower_first else (right, left)
            else:
                sp = Split(k, feat, "str", improve=float(w["improve"]))
                str_winners.append((k, int(w["f"]), float(w["ord"]), int(w["pos"])))
                lo, hi = (left, right) if lower_first else (right, left)
                sp.left_lt = lower_first
            lo.node, hi.node = 2 * k, 2 * k + 1
            sp.null_left = lo.n >= hi.n
            if missing:
                # the NULL rows' sums go to the majority child (filled below, one job per level)
                pending_missing[k] = (feat, lo if sp.null_left else hi)
            children[k] = (lo, hi)
            grown[k] = sp
            new_frontier += [2 * k, 2 * k + 1]
        if pending_missing:
            _add_missing(current, pending_missing)
        for k, pair in children.items():
            for s_ in pair:
                _node_rate_dev(s_, root_rate)
                nodes[s_.node] = s_
        if str_winners:
            own = _level_sides(run, grown, str_winners)
            sides = own if sides is None else sides.unionByName(own)
        stats.unpersist()
        run.unpersist()
        level = {int(w["node"]): grown[int(w["node"])] for w in winners}
        before, current = current, _moved(current, level, {k: sp.feature for k, sp in level.items()}, "node", sides).persist()
        frontier = new_frontier

    for frame in (before, current, cells):
        if frame is not None:
            frame.unpersist()

    splits, complexity = _prune(nodes, grown, alpha_abs, root.deviance)
    return PoissonTree(xs, nodes, splits, root_rate, cp, max_depth, complexity, sides)


def _add_missing(cells: DataFrame, pending: dict) -> None:
    """Add the sums of cells whose split predictor is NULL to the chosen child.

    One aggregate for all nodes of the level: a CASE picks each node's split
    predictor.
    """
    flag = None
    for k, (feat, _) in pending.items():
        cond = F.col("node") == F.lit(k)
        flag = F.when(cond, F.col(feat).isNull()) if flag is None else flag.when(cond, F.col(feat).isNull())
    rows = (cells.filter(F.coalesce(flag, F.lit(False)))
            .groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("y"), F.sum("__t").alias("t"),
                                 F.sum("__a").alias("a"), F.sum("__b").alias("b")).collect())
    for r in rows:
        child = pending[int(r["node"])][1]
        child.n += int(r["n"])
        child.y += float(r["y"] or 0)
        child.t += float(r["t"] or 0)
        child.s_ylny += float(r["a"] or 0)
        child.s_ylnt += float(r["b"] or 0)


def _level_sides(run: DataFrame, grown, str_winners) -> DataFrame:
    """(node, level, left) of the string splits, written once; small left sides are named in ``grown``."""
    spark = run.sparkSession
    # the winner table has at most 2^depth rows: a bounded broadcast
    win = spark.createDataFrame([(k, f, p, grown[k].left_lt) for k, f, _, p in str_winners], "node long, f int, wpos int, lower boolean")
    sides = reliable_checkpoint(run.filter(F.col("sv").isNotNull()).join(F.broadcast(win), ["node", "f"]).select(
        "node", F.col("sv").alias("level"), ((F.col("pos") <= F.col("wpos")) == F.col("lower")).alias("left")))
    left = sides.filter("left")
    sizes = {r["node"]: r["n"] for r in left.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 2^depth rows
    small = [k for k, n in sizes.items() if n <= NAMED]
    names = left.filter(F.col("node").isin(small)).select("node", "level").collect() if small else []  # at most NAMED each
    for k, *_ in str_winners:
        grown[k].n_left_levels = sizes.get(k, 0)
        grown[k].left_levels = sorted(r["level"] for r in names if r["node"] == k) if grown[k].n_left_levels <= NAMED else None
    return sides


def _prune(nodes: dict, grown: dict, alpha_abs: float, root_dev: float):
    """Weakest-link cost-complexity pruning at ``alpha_abs``; returns kept splits and cp per node."""
    splits = dict(grown)
    complexity = {}

    def subtree(k):
        if k not in splits:
            return nodes[k].deviance, 1
        r1, l1 = subtree(2 * k)
        r2, l2 = subtree(2 * k + 1)
        return r1 + r2, l1 + l2

    while splits:
        best_k, best_g = None, math.inf
        for k in splits:
            r, leaves = subtree(k)
            g = (nodes[k].deviance - r) / (leaves - 1)
            if g < best_g - 1e-12 or (abs(g - best_g) <= 1e-12 and (best_k is None or k > best_k)):
                best_k, best_g = k, g
        complexity[best_k] = best_g / root_dev if root_dev > 0 else 0.0
        if best_g > alpha_abs:
            break
        # collapse the weakest subtree
        todo = [best_k]
        while todo:
            k = todo.pop()
            if k in splits:
                del splits[k]
                todo += [2 * k, 2 * k + 1]
    for k in splits:
        r, leaves = subtree(k)
        complexity[k] = ((nodes[k].deviance - r) / (leaves - 1)) / root_dev if root_dev > 0 else 0.0
    return splits, complexity
