"""A study session: the modelling steps as immutable workspace nodes.

Every call creates a child of the node it starts from and logs it (also on
failure), so a user can backtrack to any earlier node and branch from there
(LIN-1 .. LIN-3).  A node sees the datasets and the model created on its own
chain of ancestors (LIN-2) - never its siblings'.  All data work is the
Spark operators of this package; the session only names and files results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from expstudy.operators import factors as FT
from expstudy.operators import limits as LM
from expstudy.operators import tree as TR
from expstudy.operators.lasso import fit_glm
from expstudy.operators.lineage import StudyLog
from expstudy.operators.score import load_model, save_model
from expstudy.sources import io as IO
from expstudy.tools import TOOL_CREATE_DATASET, TOOL_GLM, TOOL_INFERENCE, TOOL_TREE


class Study:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.log = StudyLog(spark, f"{self.root}/log")

    # --- helpers ----------------------------------------------------------
    def _node_dir(self, node: str) -> str:
        return f"{self.root}/nodes/{node}"

    def _model_path(self, node: str) -> str:
        return f"{self._node_dir(node)}/model"

    def _chain_steps(self, node: str) -> list:
        """Successful log entries on the node's chain with their distance (nearest first).

        Located through the step log, never by listing folders, so any shared
        file system works; the chain is at most the depth cap.
        """
        from pyspark.sql import functions as F

        chain = self.log.ancestors(node)
        order = self.spark.createDataFrame([(n, i) for i, n in enumerate(chain)], "node string, dist int")
        rows = (self.log.steps().filter(F.col("success")).join(F.broadcast(order), "node")
                .select("node", "dist", "tool_name", "args").orderBy("dist").collect())
        return rows

    def visible_datasets(self, node: str) -> list[tuple[str, str]]:
        """LIN-2: (dataset, creating node) for every dataset on the node's chain, nearest first."""
        import json

        out, seen = [], set()
        for r in self._chain_steps(node):
            args = json.loads(r["args"] or "[]")
            name = (args[0] if r["tool_name"] == TOOL_CREATE_DATASET else
                    args[1] if r["tool_name"] == TOOL_INFERENCE else None)
            if name is not None and name not in seen:
                seen.add(name)
                out.append((name, r["node"]))
        return out

    def check_new_dataset(self, node: str, name: str) -> None:
        """SNK-1 / SNK-6: refuse a dataset name that the chain already holds."""
        for ds, creator in self.visible_datasets(node):
            if ds == name:
                raise FileExistsError(f"dataset {name} is on this branch already, from step {creator}")

    def resolve(self, node: str, name: str) -> DataFrame:
        """SRC-3 from a node: the nearest ancestor's dataset, else a catalog table/view."""
        for ds, creator in self.visible_datasets(node):
            if ds == name:
                return IO.read_dataset(self.spark, IO.dataset_path(f"{self._node_dir(creator)}/datasets", name))
        return self.spark.table(name)

    def register_outputs(self, node: str) -> str | None:
        """LIN-10: register every scored dataset on the branch as a view; return the first one."""
        import json

        from expstudy.sources.catalog import register_view

        names = []
        for r in reversed(self._chain_steps(node)):  # root first
            if r["tool_name"] == TOOL_INFERENCE:
                name = json.loads(r["args"])[1]
                register_view(self.spark, name, IO.read_dataset(
                    self.spark, IO.dataset_path(f"{self._node_dir(r['node'])}/datasets", name)))
                names.append(name)
        return names[0] if names else None

    def model_of(self, node: str):
        """MOD-23: the model fitted on this node's chain."""
        for r in self._chain_steps(node):
            if r["tool_name"] == TOOL_GLM:
                return load_model(self._model_path(r["node"]), spark=self.spark)
        raise FileNotFoundError("no fitted model on this branch; fit one first")

    def _run(self, parent: str, tool: str, args: list, fn):
        self.log.check_not_final(parent)
        node = uuid.uuid4().hex
        try:
            # a refused second fit is a failed step of its own, logged like any failure
            self.log.check_one_model(parent, tool)
            result = fn(node)
        except Exception as exc:
            self.log.record(node, parent, tool, args, {"error": str(exc)}, success=False)
            raise
        self.log.record(node, parent, tool, args, result if isinstance(result, dict) else {"result": result})
        return node, result

    # --- ad-hoc SQL ----------------------------------------------------------
    def sql_run(self, description: str, sql: str) -> LM.QueryResult:
        """LIM-1 + SNK-7: a bounded SELECT; the query is logged whether it succeeds or not."""
        res = LM.bounded_query(self.spark, sql)
        self.log.log_query(description, sql, res.success)
        return res

    # --- steps --------------------------------------------------------------
    def start(self) -> str:
        return self.log.start()

    def create_dataset(self, parent: str, name: str, sql: str):
        """SNK-1 as a step: returns (node, row count)."""
        def fn(node):
            self.check_new_dataset(parent, name)
            return {"n_rows": IO.create_dataset(self.spark, f"{self._node_dir(node)}/datasets", name, sql)}
        node, res = self._run(parent, TOOL_CREATE_DATASET, [name, sql], fn)
        return node, res["n_rows"]

    def tree(self, parent: str, dataset: str, x_vars, offset: str, y: str, max_depth: int = 3, cp: float = 0.001):
        """MOD-15 with the external-call limits (MOD-16); returns (node, tree)."""
        cp = TR.check_tree_args(x_vars, max_depth, cp)
        holder = {}

        def fn(node):
            t = TR.poisson_tree(self.resolve(parent, dataset), x_vars, offset, y, max_depth=max_depth, cp=cp)
            holder["tree"] = t
            return {"leaves": len(t.leaves()), "splits": {str(k): s.describe(True) for k, s in t.splits.items()}}
        node, _ = self._run(parent, TOOL_TREE, [dataset, list(x_vars), offset, y, max_depth, cp], fn)
        return node, holder["tree"]

    def glm(self, parent: str, dataset: str, x_vars, terms, offset: str, y: str, factor_defaults=None,
            clip=None, lambda_strat: str = "1se", nlambda: int | None = None):
        """MOD-8 .. MOD-14 as a step; one model per chain; returns (node, fit)."""
        holder = {}

        def fn(node):
            kw = {} if nlambda is None else {"nlambda": nlambda}
            fit = fit_glm(self.resolve(parent, dataset), x_vars, terms, offset, y, factor_defaults=factor_defaults,
                          clip=clip, lambda_strat=lambda_strat, **kw)
            self.log.claim("model", node)  # before the model: of two writers of one node, one goes on
            save_model(fit.model, self._model_path(node), spark=self.spark)
            holder["fit"] = fit
            return {"ae_train": fit.ae_train, "lambda_ix": fit.path.chosen + 1}
        args = [dataset, list(x_vars), [t.label() if hasattr(t, "label") else str(t) for t in terms],
                dict(factor_defaults or {}), dict(clip or {}), offset, y, lambda_strat]
        node, _ = self._run(parent, TOOL_GLM, args, fn)
        return node, holder["fit"]

    def run_inference(self, parent: str, in_dataset: str, out_dataset: str):
        """SNK-6: score a dataset with the chain's model and write it; returns node."""
        def fn(node):
            self.check_new_dataset(parent, out_dataset)
            model = self.model_of(parent)
            scored = model.score(self.resolve(parent, in_dataset))
            IO.write_scored(scored, f"{self._node_dir(node)}/datasets", out_dataset)
            return {"out": out_dataset}
        node, _ = self._run(parent, TOOL_INFERENCE, [in_dataset, out_dataset], fn)
        return node

    def finalize(self, node: str) -> str:
        """LIN-11 + SNK-5: write the factor tables of the branch's model, then mark the branch final.

        The mark comes last: if the tables cannot be written the branch stays open, and the next
        attempt writes to a folder of its own.
        """
        self.log.check_can_finalize(node)
        model = self.model_of(node)
        out = IO.write_factor_tables(FT.sheets(model, self.spark), f"{self._node_dir(node)}/factors-{uuid.uuid4().hex}",
                                     FT.overview(model, self.spark, self._model_path(node)))
        self.log.finalize(node)
        return out
