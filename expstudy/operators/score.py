"""Scoring with a fitted log-link Poisson model (MOD-12, MOD-13, MOD-23).

A model is its design (terms + learned recipe) plus coefficients; scoring is a
generated column expression - no UDF, no shuffle - so it runs the same on a
batch or a streaming DataFrame and stays inside whole-stage codegen.
"""

from __future__ import annotations

import json
import math
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from expstudy.functions.expr import safe_div
from expstudy.operators.design import NS, Design, Recipe, Term, Var, build_design
from expstudy.schema import resolve_col

# Training A/E tolerance of the reference (|ln A/E| < ln 1.03).
AE_GATE = 1.03


#: What a job fails with at a row whose factor level was not in the training data.
UNSEEN = "a row has a factor level unseen in training"


@dataclass
class GlmModel:
    design: Design
    intercept: float
    coefs: list  # one per design column, original scale
    offset: str
    y: str
    x_vars: list
    info: dict = field(default_factory=dict)

    def eta(self, df: DataFrame | None = None) -> Column:
        """Linear predictor without offset, an expression for each term; zero coefficients are left out.

        One of a factor's columns at most is not zero, so a CASE chooses its coefficient, and a spline's
        columns are summed into one cubic per interval.  So the generated code stays small: written column
        by column it passes what the JVM compiles, and every row is interpreted.
        """
        own: dict[Term, list] = {}
        for b, c in zip(self.coefs, self.design.columns):
            if b != 0.0:
                own.setdefault(c.term, []).append((c.parts, float(b)))
        baked = self.design.baked_columns(df)
        expr = F.lit(float(self.intercept))
        for term, columns in own.items():
            expr = expr + _term_sum(term, columns, baked)
        return expr

    def predict(self, df: DataFrame, use_offset: bool = True, type: str = "response",
                on_unseen: str = "null") -> Column:
        """MOD-12 as a Column.

        response with offset: ``offset * exp(eta)`` (never ``exp(eta + ln offset)``,
        which breaks at offset 0); without offset the rate ``exp(eta)``.  link:
        ``eta (+ ln offset)``.  Rows with an unseen factor level give NULL, or fail
        the job with ``on_unseen='error'``.
        """
        eta = self.eta(df)
        if type == "response":
            out = F.exp(eta)
            if use_offset:
                out = F.col(resolve_col(df, self.offset)) * out
        elif type == "link":
            out = eta
            if use_offset:
                o = F.col(resolve_col(df, self.offset))
                out = (F.when(o > 0, eta + F.log(o)).when(o == 0, F.lit(float("-inf")))
                       .when(o < 0, F.lit(float("nan"))))
        else:
            raise ValueError("type must be 'response' or 'link'")
        if on_unseen not in ("null", "error"):
            raise ValueError("on_unseen must be 'null' or 'error'")
        other = F.raise_error(F.lit(UNSEEN)).cast("double") if on_unseen == "error" else F.lit(None).cast("double")
        return F.when(self.design.known(df), out.cast("double")).otherwise(other)

    def score(self, df: DataFrame, use_offset: bool = True, type: str = "response",
              on_unseen: str = "error", name: str = "MODEL_PRED") -> DataFrame:
        """Append the prediction column, in one pass: with ``on_unseen='error'`` the job that
        reads the predictions fails at a row with a factor level unseen in training."""
        return df.withColumn(name, self.predict(df, use_offset, type, on_unseen))

    # --- persistence (MOD-23) --------------------------------------------
    def to_dict(self) -> dict:
        return {
            "terms": [[_comp_to_dict(c) for c in t.components] for t in self.design.terms],
            "recipe": self.design.recipe.to_dict(),
            "intercept": self.intercept, "coefs": list(self.coefs),
            "columns": self.design.names, "offset": self.offset, "y": self.y,
            "x_vars": list(self.x_vars), "info": self.info,
        }

    @staticmethod
    def from_dict(d) -> "GlmModel":
        terms = [Term(tuple(_comp_from_dict(c) for c in t)) for t in d["terms"]]
        design = build_design(terms, Recipe.from_dict(d["recipe"]))
        if design.names != d["columns"]:
            raise ValueError("design columns do not match the saved model")
        return GlmModel(design, d["intercept"], d["coefs"], d["offset"], d["y"], d["x_vars"], d.get("info", {}))

    def coefficient_rows(self) -> list[tuple[str, float]]:
        return [("(Intercept)", float(self.intercept))] + [(n, float(b)) for n, b in zip(self.design.names, self.coefs)]


def _term_sum(term: Term, columns: list, baked: dict) -> Column:
    """The sum of a term's columns, each given as (parts, coefficient); NULL where a number is missing."""
    kinds = [part[0] for part in columns[0][0]]
    at = {kind: [i for i, k in enumerate(kinds) if k == kind] for kind in ("num", "lvl", "ns")}
    expr = _chosen(term, columns, baked, at["lvl"] + at["ns"])
    if at["lvl"]:  # a missing number is missing at every level
        for i in at["ns"]:
            expr = F.when(baked[term.components[i].var].isNotNull(), expr)
    if at["num"]:
        first, *more = (baked[term.components[i].var].cast("double") for i in at["num"])
        for x in more:
            first = first * x
        expr = first * expr
    return expr


def _chosen(term: Term, columns: list, baked: dict, places: list[int]) -> Column:
    """The sum of ``columns`` without their numbers, by the components at ``places``: factors, then splines."""
    if not places:
        return F.lit(columns[0][1])
    i, *rest = places
    comp, by = term.components[i], {}
    for parts, b in columns:
        by.setdefault(parts[i][1], []).append((parts, b))
    x = baked[comp.var]
    if isinstance(comp, NS):
        if not rest:
            return comp.spline.weighted(x, {j: own[0][1] for j, own in by.items()})
        basis, out = comp.spline.columns(x), None
        for j, own in by.items():
            one = basis[j] * _chosen(term, own, baked, rest)
            out = one if out is None else out + one
        return out
    out = None
    for level, own in by.items():
        is_level, value = x == F.lit(level), _chosen(term, own, baked, rest)
        out = F.when(is_level, value) if out is None else out.when(is_level, value)
    return out.otherwise(F.lit(0.0))


def _comp_to_dict(c) -> dict:
    if isinstance(c, NS):
        return {"var": c.name, "ns": {"knots": list(c.knots), "boundary": list(c.boundary)}}
    return {"var": c.name}


def _comp_from_dict(d):
    if "ns" in d:
        return NS(d["var"], d["ns"]["knots"], d["ns"]["boundary"])
    return Var(d["var"])


def save_model(model: GlmModel, path: str, spark=None) -> None:
    """MOD-23: write the model spec once; a second save to the same place is refused.

    With a session the spec is a one-row text dataset written through Spark's
    file system layer (any shared store); without one, a local JSON file.
    """
    text = json.dumps(model.to_dict())
    if spark is not None:
        from expstudy.sources.io import _refuse_existing

        df = spark.createDataFrame([(text,)], "spec string").coalesce(1)
        _refuse_existing(df.write.mode("errorifexists").text, path, "model")
        return
    if os.path.exists(path):
        raise FileExistsError("model already exists; a workspace chain holds one model")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "x") as fh:
        fh.write(text)


def load_model(path: str, spark=None) -> GlmModel:
    if spark is not None:
        from pyspark.errors import AnalysisException

        try:
            rows = spark.read.text(path).collect()
        except AnalysisException as exc:
            raise FileNotFoundError("no fitted model in this workspace chain") from exc
        return GlmModel.from_dict(json.loads("".join(r[0] for r in rows)))
    if not os.path.exists(path):
        raise FileNotFoundError("no fitted model in this workspace chain")
    with open(path) as fh:
        return GlmModel.from_dict(json.load(fh))


def training_ae(scored: DataFrame, y: str, pred: str = "MODEL_PRED") -> float:
    r = scored.agg(safe_div(F.sum(resolve_col(scored, y)), F.sum(pred)).alias("ae")).first()
    return r["ae"]


def training_gate(ae: float | None, tolerance: float = AE_GATE) -> None:
    """MOD-13: accept only ``|ln(A/E)| < ln(1.03)``."""
    if ae is None or not (ae > 0) or abs(math.log(ae)) >= math.log(tolerance):
        raise ValueError("actual to expected of the training data is off 1 by more than the gate allows")
