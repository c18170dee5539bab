"""Workspace lineage and audit-log queries (LIN-1 .. LIN-12, WIN-3, JN-4, JN-5).

A study is a tree of immutable workspace nodes ``(node, parent)``; each step
(tool call) creates a child.  The log is a DataFrame, so every traversal is a
Spark job:

* ``root_depth``  - root and depth of every node by pointer doubling: round k
  joins the nodes still on their way with the pointer table, so each jumps 2^k
  levels; a chain of depth d needs ceil(log2 d) rounds instead of d recursive
  steps.  Nodes that have reached their root are set aside and joined no more.
* ``branches``    - the root-to-leaf path of chosen leaves, by the same
  doubling over jump tables (J_{k+1} = J_k o J_k), for as many rounds as the
  chosen leaves need; the output is one row per (leaf, ancestor), i.e. the sum
  of the branch lengths.
* ``with_paths``  - each node with its root and the array of its ancestors, by the
  same rounds as ``root_depth``.  A log that keeps these columns needs no
  traversal: a branch is one row (``path_branches`` explodes it, without a join),
  and what a node sees is a test on one array.  ``StudyLog`` writes them with every
  step from the parent's row, so ``branches`` is for logs of other origin.

Each round is checkpointed to the reliable checkpoint folder, which cuts the
growing plan and makes a lost executor cost one round at most.  Both refuse a
chain of ``MAX_DEPTH`` or more nodes (so also a cycle) and a parent pointer
that names no node.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from expstudy.functions.ranking import row_number_within
from expstudy.session import reliable_checkpoint
from expstudy.tools import TOOL_CREATE_DATASET, TOOL_GLM, TOOL_INFERENCE, TOOL_TREE

# Traversal cap (a chain of this many nodes is refused), the stand-in tool
# name and the pointer text of the reference.
MAX_DEPTH = 1000
UNKNOWN_TOOL = "unknown"
POINTER_PATTERN = r'^"([A-Za-z0-9-]+)"->"([A-Za-z0-9-]+)"$'

PHASE_DATASETS = "datasets"
PHASE_VAR_IMP = "variable_importance"
PHASE_MODEL = "model"
PHASE_INFERENCE = "inference"
PHASE_VALIDATION = "validation"


def parse_pointers(df: DataFrame, col: str = "pointer") -> DataFrame:
    """STR-4: ``root`` or ``"parent"->"child"`` text to ``(node, parent)``; bad text is an error."""
    txt = F.trim(F.col(col))
    parsed = df.select(
        txt.alias("__p"),
        F.regexp_extract(txt, POINTER_PATTERN, 1).alias("__parent"),
        F.regexp_extract(txt, POINTER_PATTERN, 2).alias("__child"))
    bad = parsed.filter((F.col("__p") != "root") & (F.col("__child") == "")).limit(1).collect()
    if bad:
        raise ValueError(f"not a pointer between two nodes: {bad[0]['__p']!r}")
    return parsed.filter(F.col("__p") != "root").select(F.col("__child").alias("node"), F.col("__parent").alias("parent"))


def _too_deep(max_depth: int) -> ValueError:
    return ValueError(f"a lineage chain has {max_depth} or more nodes, or runs in a circle")


def root_depth(nodes: DataFrame, node: str = "node", parent: str = "parent", max_depth: int = MAX_DEPTH) -> DataFrame:
    """Root id and depth (root = 0) of every node, by pointer doubling."""
    top = F.col(parent).isNull()
    done = reliable_checkpoint(nodes.filter(top).select(F.col(node).alias("node"), F.col(node).alias("root"), F.lit(0).alias("depth")))
    pending = reliable_checkpoint(nodes.filter(~top).select(F.col(node).alias("node"), F.col(parent).alias("anc"), F.lit(1).alias("dist")))
    known = done
    while not pending.isEmpty():
        # where the ancestor stands now: at its root, or on its way to its own ancestor
        state = known.select("node", F.col("root").alias("to"), F.col("depth").alias("by"), F.lit(True).alias("at_root")).unionByName(
            pending.select("node", F.col("anc").alias("to"), F.col("dist").alias("by"), F.lit(False).alias("at_root")))
        moved = reliable_checkpoint(
            pending.alias("a").join(state.alias("b"), F.col("a.anc") == F.col("b.node"), "left")
            .select(F.col("a.node").alias("node"), F.col("b.to").alias("anc"), (F.col("a.dist") + F.col("b.by")).alias("dist"), "b.at_root"))
        flags = moved.agg(F.max(F.col("at_root").isNull().cast("int")).alias("lost"), F.max("dist").alias("deepest")).first()
        if flags["lost"]:
            raise ValueError("a parent pointer names a node that is not in the log")
        if flags["deepest"] + 1 >= max_depth:
            raise _too_deep(max_depth)
        known = known.unionByName(moved.filter("at_root").select("node", F.col("anc").alias("root"), F.col("dist").alias("depth")))
        pending = moved.filter(~F.col("at_root")).drop("at_root")
    return known


def with_paths(nodes: DataFrame, node: str = "node", parent: str = "parent", max_depth: int = MAX_DEPTH) -> DataFrame:
    """``(node, root, depth, path)`` of every node; ``path`` holds its ancestors, root first (at most ``max_depth`` - 1).

    Pointer doubling on arrays: a node on its way joins the state of the ancestor it has reached and
    puts that ancestor's piece of path before its own.
    """
    top = F.col(parent).isNull()
    none = F.array().cast(nodes.select(F.array(node).alias("a")).schema["a"].dataType)
    done = reliable_checkpoint(nodes.filter(top).select(F.col(node).alias("node"), F.col(node).alias("anc"), none.alias("path")))
    pending = reliable_checkpoint(nodes.filter(~top).select(F.col(node).alias("node"), F.col(parent).alias("anc"), F.array(parent).alias("path")))
    known = done
    while not pending.isEmpty():
        state = known.select("node", "anc", "path", F.lit(True).alias("whole")).unionByName(pending.withColumn("whole", F.lit(False)))
        moved = reliable_checkpoint(
            pending.alias("a").join(state.alias("b"), F.col("a.anc") == F.col("b.node"), "left")
            .select(F.col("a.node").alias("node"), F.col("b.anc").alias("anc"), F.concat("b.path", "a.path").alias("path"), "b.whole"))
        flags = moved.agg(F.max(F.col("whole").isNull().cast("int")).alias("lost"), F.max(F.size("path")).alias("deepest")).first()
        if flags["lost"]:
            raise ValueError("a parent pointer names a node that is not in the log")
        if flags["deepest"] + 1 >= max_depth:
            raise _too_deep(max_depth)
        known = known.unionByName(moved.filter("whole").drop("whole"))
        pending = moved.filter(~F.col("whole")).drop("whole")
    return known.select("node", F.coalesce(F.get("path", F.lit(0)), F.col("node")).alias("root"), F.size("path").alias("depth"), "path")


def path_branches(paths: DataFrame) -> DataFrame:
    """LIN-4 from materialised paths: ``(leaf, node, pos)`` of each row's ancestors and itself (pos 0), one pass, no join."""
    chain = F.concat(F.array("node"), F.reverse("path"))
    return paths.select(F.col("node").alias("leaf"), F.posexplode(chain).alias("pos", "node")).select("leaf", "node", "pos")


def seen_from(paths: DataFrame, node) -> DataFrame:
    """The rows of ``paths`` that ``node`` sees: itself and its ancestors, by its own row's path."""
    own = paths.filter(F.col("node") == F.lit(node)).select(F.concat("path", F.array("node")).alias("__chain"))
    return paths.join(F.broadcast(own), F.array_contains("__chain", F.col("node"))).drop("__chain")  # ``own`` is one row


def branches(nodes: DataFrame, leaves: DataFrame, node: str = "node", parent: str = "parent",
             max_depth: int = MAX_DEPTH) -> DataFrame:
    """LIN-4: ``(leaf, node, pos)`` for every ancestor of each leaf (pos 0 = the leaf).

    The root-to-leaf order is ``pos`` descending.  Only the chosen leaves' chains are checked.
    """
    jump = nodes.filter(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("anc"))
    have = reliable_checkpoint(leaves.select(F.col(node).alias("leaf"), F.col(node).alias("node"), F.lit(0).alias("pos")))
    step = 1
    while True:
        ext = reliable_checkpoint(have.join(jump, "node").select("leaf", F.col("anc").alias("node"), (F.col("pos") + F.lit(step)).alias("pos")))
        if ext.isEmpty():
            break
        have = have.unionByName(ext)
        if have.agg(F.max("pos")).first()[0] + 1 >= max_depth:
            raise _too_deep(max_depth)
        j1, j2 = jump.alias("j1"), jump.alias("j2")
        jump = reliable_checkpoint(j1.join(j2, F.col("j1.anc") == F.col("j2.node"))
                                   .select(F.col("j1.node").alias("node"), F.col("j2.anc").alias("anc")))
        step *= 2
    tops = have.groupBy("leaf").agg(F.max_by("node", "pos").alias("node"))
    roots = nodes.filter(F.col(parent).isNull()).select(F.col(node).alias("node"))
    if not tops.join(roots, "node", "left_anti").isEmpty():
        raise ValueError("a parent pointer names a node that is not in the log")
    return have


def tree_levels(nodes: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """LIN-5: per root and BFS level, the number of nodes."""
    rd = root_depth(nodes, node, parent)
    return rd.groupBy("root", F.col("depth").alias("level")).agg(F.count(F.lit(1)).alias("n_nodes"))


def tree_of(nodes: DataFrame, root_id, node: str = "node", parent: str = "parent") -> DataFrame:
    """LIN-5: descendants of one root with their level; error if ``root_id`` is not a root."""
    r = nodes.filter(F.col(node) == F.lit(root_id)).select(parent).limit(1).collect()
    if not r or r[0][0] is not None:
        raise ValueError(f"node {root_id} does not start a study")
    rd = root_depth(nodes, node, parent)
    return rd.filter(F.col("root") == F.lit(root_id)).select("node", F.col("depth").alias("level"))


def fill_missing_steps(nodes: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """LIN-8: a node without a log entry gets tool ``unknown`` and empty args."""
    base = nodes if steps is None else nodes.join(steps, "node", "left")
    child = F.col("parent").isNotNull()
    return (base.withColumn("tool_name", F.when(child, F.coalesce(F.col("tool_name"), F.lit(UNKNOWN_TOOL))))
            .withColumn("args", F.when(child, F.coalesce(F.col("args"), F.lit("[]")))))


def steps_by_time(nodes: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """LIN-6: the steps reached from each root (JN-5 semi join) in creation order."""
    rd = root_depth(nodes)
    reached = rd if roots is None else rd.join(roots.select(F.col("node").alias("root")), "root", "left_semi")
    full = fill_missing_steps(nodes).join(reached, "node").select("root", "node", "created", "depth", "tool_name")
    # one study can hold most of the log: number its steps without one task per study
    return row_number_within(full, ["root"], ["created", "node"], out="step_ix")


def in_creation_order(log: DataFrame, order=("created",)) -> DataFrame:
    """LIN-7: log rows with their ``position`` (from 1) in creation order, numbered over range pieces."""
    return row_number_within(log.withColumn("__all", F.lit(1)), ["__all"], list(order), out="position").drop("__all")


def classify_steps(branch_steps: DataFrame) -> DataFrame:
    """LIN-9 + WIN-3: phase of each step along its branch.

    Input: ``leaf, node, pos, tool_name`` (``pos`` 0 = leaf).  Tree steps before
    the first model fit are variable importance, after it validation.  The
    window partition is one branch (bounded by the depth cap).
    """
    w = (Window.partitionBy("leaf").orderBy(F.col("pos").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen_glm = F.max((F.col("tool_name") == TOOL_GLM).cast("int")).over(w)
    phase = (F.when(F.col("tool_name") == TOOL_CREATE_DATASET, F.lit(PHASE_DATASETS))
             .when(F.col("tool_name") == TOOL_GLM, F.lit(PHASE_MODEL))
             .when(F.col("tool_name") == TOOL_INFERENCE, F.lit(PHASE_INFERENCE))
             .when((F.col("tool_name") == TOOL_TREE) & (seen_glm > 0), F.lit(PHASE_VALIDATION))
             .when(F.col("tool_name") == TOOL_TREE, F.lit(PHASE_VAR_IMP)))
    return branch_steps.withColumn("phase", phase)


def visible_datasets(branch_steps: DataFrame, datasets: DataFrame) -> DataFrame:
    """LIN-2: the datasets a node sees - those created at it or any ancestor.

    ``datasets`` has ``node`` (creating step) and ``dataset``.
    """
    return branch_steps.select("leaf", "node", "pos").join(datasets, "node")


def model_outputs(branch_steps: DataFrame) -> DataFrame:
    """LIN-10: scored outputs on each branch (second argument of inference steps), first one flagged."""
    inf = branch_steps.filter(F.col("tool_name") == TOOL_INFERENCE).select(
        "leaf", "node", "pos", F.get_json_object("args", "$[1]").alias("out_dataset"))
    w = Window.partitionBy("leaf").orderBy(F.col("pos").desc())
    return inf.withColumn("is_first", F.row_number().over(w) == 1)


def finished_studies(final_marks: DataFrame, nodes: DataFrame) -> DataFrame:
    """LIN-12: roots that have a finalised branch."""
    rd = root_depth(nodes)
    return rd.join(final_marks.select("node"), "node").select("root").distinct()


# ---------------------------------------------------------------------------
# LIN-1 / LIN-11 / SNK-7 / SNK-8: an append-only study log on Parquet
# ---------------------------------------------------------------------------

class StudyLog:
    """Append-only step, query and final-mark logs under one folder.

    Nodes never change; a step names its parent and carries its root and the path of its
    ancestors, so what a node sees needs its own row and no traversal.  A study with a
    final mark refuses any further step and any further mark; a chain holds one model fit.
    What may exist once is claimed by creating a file that must not exist (``claim``).
    """

    STEP_SCHEMA = ("node string, parent string, created double, tool_name string, args string, "
                   "result string, success boolean, root string, path array<string>")
    QUERY_SCHEMA = "created double, description string, sql string, success boolean"
    FINAL_SCHEMA = "node string, created double"

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _append(self, table: str, rows, schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        """The log table, or an empty frame before its first append (any file system)."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
                return self.spark.createDataFrame([], schema)
            raise

    def steps(self) -> DataFrame:
        return self._read("steps", self.STEP_SCHEMA)

    def queries(self) -> DataFrame:
        """LIN-7: ad-hoc queries in creation order."""
        return self._read("queries", self.QUERY_SCHEMA).orderBy("created")

    def finals(self) -> DataFrame:
        return self._read("final", self.FINAL_SCHEMA)

    # --- what may exist once ------------------------------------------------
    def _claim_file(self, kind: str, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{kind}/{key}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def claimed(self, kind: str, key: str) -> bool:
        path, store = self._claim_file(kind, key)
        return store.exists(path)

    def claim(self, kind: str, key: str) -> None:
        """Create the marker of ``key``; whoever comes second is refused.  The file system creates it
        only if it is not there, in one step where it can (HDFS; local disks nearly so)."""
        path, store = self._claim_file(kind, key)
        try:
            store.create(path, False).close()
        except Exception as exc:  # the gateway wraps what the file system raises
            if store.exists(path):
                raise ValueError(f"{kind} {key} exists already") from exc
            raise

    # --- nodes ---------------------------------------------------------------
    def _place(self, node: str) -> tuple[str, list[str]]:
        """Root of a node and its chain, nearest first with the node itself: one row of one scan."""
        row = self.steps().filter(F.col("node") == node).select("parent", "root", "path").first()
        if row is None:
            raise ValueError(f"no step {node} in the log")
        if row["root"] is not None:
            return row["root"], [node, *reversed(row["path"])]
        nodes = self.steps().select("node", "parent")  # written without paths
        chain = [r["node"] for r in branches(nodes, nodes.filter(F.col("node") == node)).orderBy("pos").collect()]
        return chain[-1], chain

    def start(self) -> str:
        node = uuid.uuid4().hex
        self._append("steps", [(node, None, time.time(), None, None, None, True, node, [])], self.STEP_SCHEMA)
        return node

    def ancestors(self, node: str) -> list[str]:
        """The node and its ancestors, nearest first."""
        return self._place(node)[1]

    def check_not_final(self, parent: str) -> None:
        """Refuse any step of a study with a final mark (before a node is created)."""
        if self.claimed("final", self._place(parent)[0]):
            raise ValueError("the study is final and takes no more steps")

    def check_one_model(self, parent: str, tool_name: str) -> None:
        """Refuse a second model fit on a chain."""
        if tool_name == TOOL_GLM and self.has_model(parent):
            raise ValueError("this branch has its model; go back to a step before that fit")

    def has_model(self, node: str) -> bool:
        """Whether a model fit succeeded on the node's chain (at most the depth cap of names)."""
        chain = self.ancestors(node)
        return not self.steps().filter((F.col("tool_name") == TOOL_GLM) & F.col("success") & F.col("node").isin(chain)).isEmpty()

    def check_can_step(self, parent: str, tool_name: str) -> None:
        """Refuse steps of a final study and a second model fit on a chain."""
        self.check_not_final(parent)
        self.check_one_model(parent, tool_name)

    def record(self, node: str, parent: str, tool_name: str, args: list, result: dict | None = None,
               success: bool = True) -> str:
        """Append the log entry of an already-named step."""
        root, chain = self._place(parent)
        if len(chain) + 1 >= MAX_DEPTH:
            raise _too_deep(MAX_DEPTH)
        self._append("steps", [(node, parent, time.time(), tool_name, json.dumps(args),
                                json.dumps(result or {}, default=str), success, root, chain[::-1])], self.STEP_SCHEMA)
        return node

    def step(self, parent: str, tool_name: str, args: list, result: dict | None = None,
             success: bool = True) -> str:
        """LIN-1 + SNK-8: a new child node with its log entry (also on failure)."""
        self.check_can_step(parent, tool_name)
        return self.record(uuid.uuid4().hex, parent, tool_name, args, result, success)

    def log_query(self, description: str, sql: str, success: bool) -> None:
        """SNK-7: one row per ad-hoc query, also on failure."""
        self._append("queries", [(time.time(), description, sql, success)], self.QUERY_SCHEMA)

    def check_can_finalize(self, node: str) -> str:
        """LIN-11 guards: no mark in the study yet, a fitted model on the branch; returns the root."""
        self.check_not_final(node)
        if not self.has_model(node):
            raise ValueError("finalize needs a fitted model on the branch")
        return self._place(node)[0]

    def finalize(self, node: str) -> None:
        """LIN-11: mark the chosen branch; of two that try, one is refused."""
        self.claim("final", self.check_can_finalize(node))
        self._append("final", [(node, time.time())], self.FINAL_SCHEMA)
