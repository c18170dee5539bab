"""Model design: term spec, learned recipe and basis columns (MOD-1 .. MOD-8, MOD-20, MOD-25).

Terms are a structured spec rather than formula text::

    spec = [Main("c_mktsegment"), Main("l_returnflag"),
            NS("quantity", knots=[20, 35], boundary=[5, 45]),
            Cross("discount_pct", "l_returnflag")]

Coding follows the usual model-matrix rules for a formula without intercept:
terms are ordered by degree (main effects first, stable otherwise); inside an
interaction the variables follow their first appearance in the spec and the
first one varies fastest; a factor in term T is coded by contrasts (reference
level dropped) when T without that factor is empty or contained in an earlier
term, otherwise by all levels; and, with no intercept, the first factor of the
first term that has one gets all levels.

The recipe (levels of string predictors, clip ranges of numeric predictors)
is learned by aggregate jobs over the training cells.  Every basis column is
a Spark ``Column``; the design row is ``array(col_1, ..., col_p)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from expstudy.functions.expr import clip as clip_col
from expstudy.functions.spline import NaturalSpline
from expstudy.schema import SPLIT_COLUMN, resolve_col

# Factor level cap of the reference.
MAX_LEVELS = 25


@dataclass(frozen=True)
class Var:
    """A predictor used as is: linear if numeric, a factor if string."""

    name: str

    @property
    def var(self) -> str:
        return self.name

    def label(self) -> str:
        return self.name


@dataclass(frozen=True)
class NS:
    """Natural cubic spline of a numeric predictor (both knot lists required)."""

    name: str
    knots: tuple = ()
    boundary: tuple = ()

    def __init__(self, name, knots, boundary):
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "knots", tuple(float(k) for k in knots))
        object.__setattr__(self, "boundary", tuple(float(b) for b in boundary))
        if len(self.boundary) != 2:
            raise ValueError("ns() needs both knots and boundary knots")

    @property
    def var(self) -> str:
        return self.name

    @property
    def spline(self) -> NaturalSpline:
        return NaturalSpline(self.knots, self.boundary)

    def label(self) -> str:
        return f"ns({self.name})"


Component = Var | NS


@dataclass(frozen=True)
class Term:
    components: tuple

    @property
    def degree(self) -> int:
        return len(self.components)

    def label(self) -> str:
        return ":".join(c.label() for c in self.components)


def _comp(c) -> Component:
    return Var(c) if isinstance(c, str) else c


def Main(c) -> Term:
    """A main effect."""
    return Term((_comp(c),))


def Interact(*cs) -> Term:
    """``a:b``: the product term only."""
    return Term(tuple(_comp(c) for c in cs))


def Cross(*cs) -> list[Term]:
    """``a*b``: all main effects and interactions of the components."""
    comps = [_comp(c) for c in cs]
    out = []
    n = len(comps)
    for size in range(1, n + 1):
        from itertools import combinations
        for idx in combinations(range(n), size):
            out.append(Term(tuple(comps[i] for i in idx)))
    return out


def flatten_terms(spec) -> list[Term]:
    out: list[Term] = []
    for t in spec:
        items = t if isinstance(t, list) else [t if isinstance(t, Term) else Main(t)]
        for it in items:
            if it not in out:
                out.append(it)
    return out


@dataclass
class Recipe:
    """Learned preprocessing: factor levels and numeric clip ranges."""

    levels: dict = field(default_factory=dict)  # var -> [levels], reference first
    ranges: dict = field(default_factory=dict)  # var -> (lo, hi)

    def baked(self, df: DataFrame, var: str) -> Column:
        c = F.col(resolve_col(df, var)) if df is not None else F.col(var)
        if var in self.ranges:
            lo, hi = self.ranges[var]
            return clip_col(c.cast("double"), lo, hi)
        if var in self.levels:
            return F.when(c.isin(list(self.levels[var])), c.cast("string"))
        return c

    def to_dict(self) -> dict:
        return {"levels": self.levels, "ranges": {k: list(v) for k, v in self.ranges.items()}}

    @staticmethod
    def from_dict(d) -> "Recipe":
        return Recipe(dict(d["levels"]), {k: tuple(v) for k, v in d["ranges"].items()})


def check_factors(df: DataFrame, x_vars: Sequence[str], declared: Mapping[str, str]) -> None:
    """MOD-1: every declared factor must be a string column among ``x_vars``."""
    strings = {v for v in x_vars if isinstance(df.schema[resolve_col(df, v)].dataType, T.StringType)}
    bad = [k for k in declared if k not in strings]
    if bad:
        raise ValueError(f"defaults were given for what is no factor: {', '.join(bad)}")


def learn_recipe(cells: DataFrame, x_vars: Sequence[str], factor_defaults: Mapping[str, str] | None = None,
                 clip: Mapping[str, tuple] | None = None, max_levels: int = MAX_LEVELS) -> Recipe:
    """MOD-2 + MOD-4 over the cells: a distinct-count sketch guard, then one aggregate job.

    String predictors: more than ``max_levels`` distinct values is an error; the
    level order is the default level first (even if absent from the data), then
    the other values sorted; NULL is not a level.  Numeric predictors: the
    training [min, max] intersected with the user's range.
    """
    factor_defaults = dict(factor_defaults or {})
    clip = dict(clip or {})
    check_factors(cells, x_vars, factor_defaults)
    strings, numerics = [], []
    for v in x_vars:
        dt = cells.schema[resolve_col(cells, v)].dataType
        (strings if isinstance(dt, T.StringType) else numerics).append(v)
    # two passes over the (aggregated, small) cells: keep them for the second
    cells = cells.persist()
    try:
        return _learn(cells, strings, numerics, factor_defaults, clip, max_levels)
    finally:
        cells.unpersist()


def _learn(cells, strings, numerics, factor_defaults, clip, max_levels) -> Recipe:
    if strings:
        # guard first with a fixed-size sketch, so a high-cardinality column fails
        # before any executor builds a large distinct set
        approx = cells.agg(*[F.approx_count_distinct(resolve_col(cells, v), 0.05).alias(f"a{i}")
                             for i, v in enumerate(strings)]).first()
        for i, v in enumerate(strings):
            if approx[f"a{i}"] > 2 * max_levels:
                raise ValueError(f"factor {v} exceeds the limit of {max_levels} levels")
    aggs = []
    for i, v in enumerate(strings):
        s = F.collect_set(resolve_col(cells, v))
        aggs += [F.size(s).alias(f"n{i}"), F.slice(F.array_sort(s), 1, max_levels + 1).alias(f"v{i}"),
                 F.max(F.col(resolve_col(cells, v)).isNull().cast("int")).alias(f"z{i}")]
    for i, v in enumerate(numerics):
        c = F.col(resolve_col(cells, v)).cast("double")
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    if not aggs:
        return Recipe()
    r = cells.agg(*aggs).first()
    rec = Recipe()
    for i, v in enumerate(strings):
        n_vals = int(r[f"n{i}"]) + int(r[f"z{i}"] or 0)
        if n_vals > max_levels:
            raise ValueError(f"factor {v} exceeds the limit of {max_levels} levels")
        vals = list(r[f"v{i}"])
        d = factor_defaults.get(v)
        rec.levels[v] = ([d] + [x for x in vals if x != d]) if d is not None else vals
    for i, v in enumerate(numerics):
        lo, hi = r[f"lo{i}"], r[f"hi{i}"]
        if lo is None:
            raise ValueError(f"predictor {v} has no value in any row")
        if v in clip:
            ulo, uhi = clip[v]
            lo, hi = max(lo, ulo), min(hi, uhi)
        rec.ranges[v] = (float(lo), float(hi))
    return rec


@dataclass
class DesignColumn:
    name: str
    term: Term
    parts: tuple  # per component: ("num",) | ("ns", j) | ("lvl", level)

    def column(self, baked: Mapping[str, Column], splines: Mapping[Component, list]) -> Column:
        expr = None
        for comp, part in zip(self.term.components, self.parts):
            if part[0] == "num":
                v = baked[comp.var]
            elif part[0] == "ns":
                v = splines[comp][part[1]]
            else:
                v = F.when(baked[comp.var] == F.lit(part[1]), F.lit(1.0)).otherwise(F.lit(0.0))
            expr = v if expr is None else expr * v
        return expr.cast("double")


@dataclass
class Design:
    terms: list
    recipe: Recipe
    columns: list  # DesignColumn
    variables: list  # predictor order of first appearance

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def factor_vars(self) -> list[str]:
        return [v for v in self.variables if v in self.recipe.levels]

    def baked_columns(self, df: DataFrame | None) -> dict:
        return {v: self.recipe.baked(df, v) for v in self.variables}

    def basis(self, df: DataFrame | None) -> list[Column]:
        """One Column per design column, computed from the baked predictors."""
        baked = self.baked_columns(df)
        splines = {}
        for t in self.terms:
            for comp in t.components:
                if isinstance(comp, NS) and comp not in splines:
                    splines[comp] = comp.spline.columns(baked[comp.var])
        return [c.column(baked, splines) for c in self.columns]

    def known(self, df: DataFrame | None) -> Column:
        """TRUE when every factor value of the row is a learned level."""
        cond = F.lit(True)
        for v in self.factor_vars():
            col = F.col(resolve_col(df, v)) if df is not None else F.col(v)
            cond = cond & F.coalesce(col.isin(list(self.recipe.levels[v])), F.lit(False))
        return cond

    def terms_by_variable(self) -> dict[str, list[str]]:
        """MOD-26: variable -> labels of the terms that use it."""
        out: dict[str, list[str]] = {v: [] for v in self.variables}
        for t in self.terms:
            for comp in t.components:
                if t.label() not in out[comp.var]:
                    out[comp.var].append(t.label())
        return out

    def term_map(self) -> list[tuple[str, str, str]]:
        """MOD-20: (term_name, term_group, vars_in_group) per design column."""
        out = []
        for c in self.columns:
            vs = []
            for comp in c.term.components:
                if comp.var not in vs:
                    vs.append(comp.var)
            out.append((c.name, "_X_".join(vs), "|".join(vs)))
        return out


def build_design(terms, recipe: Recipe) -> Design:
    """MOD-5, MOD-7, MOD-8: order terms, choose factor coding, list the columns."""
    flat = flatten_terms(terms)
    variables: list[str] = []
    for t in flat:
        for comp in t.components:
            if comp.var not in variables:
                variables.append(comp.var)
    pos = {v: i for i, v in enumerate(variables)}
    normal = [Term(tuple(sorted(t.components, key=lambda c: pos[c.var]))) for t in flat]
    ordered = sorted(range(len(normal)), key=lambda i: (normal[i].degree, i))
    ordered_terms = [normal[i] for i in ordered]

    def is_factor(comp) -> bool:
        return isinstance(comp, Var) and comp.var in recipe.levels

    # coding: True = contrasts (drop reference level), False = all levels
    coding: dict[tuple[int, int], bool] = {}
    for ti, t in enumerate(ordered_terms):
        for ci, comp in enumerate(t.components):
            if not is_factor(comp):
                continue
            rest = {c for k, c in enumerate(t.components) if k != ci}
            if not rest:
                coding[(ti, ci)] = True
                continue
            coding[(ti, ci)] = any(rest <= set(prev.components) for prev in ordered_terms[:ti])
    # no intercept: the first factor (variable order) of the first term having one gets all levels
    for ti, t in enumerate(ordered_terms):
        facs = [(pos[c.var], ci) for ci, c in enumerate(t.components) if is_factor(c)]
        if facs:
            coding[(ti, min(facs)[1])] = False
            break

    columns: list[DesignColumn] = []
    for ti, t in enumerate(ordered_terms):
        lists = []
        for ci, comp in enumerate(t.components):
            if isinstance(comp, NS):
                lists.append([(("ns", j), f"{comp.label()}{j + 1}") for j in range(comp.spline.n_columns)])
            elif is_factor(comp):
                lv = recipe.levels[comp.var]
                use = lv[1:] if coding[(ti, ci)] else lv
                lists.append([(("lvl", x), f"{comp.var}{x}") for x in use])
            else:
                lists.append([(("num",), comp.var)])
        combos = [[]]
        for lst in lists:  # first component varies fastest
            combos = [prev + [item] for item in lst for prev in combos]
        for combo in combos:
            columns.append(DesignColumn(":".join(n for _, n in combo), t, tuple(p for p, _ in combo)))
    return Design(ordered_terms, recipe, columns, variables)


def validate_model_view(df: DataFrame, target: str, offset: str, split_col: str = SPLIT_COLUMN) -> list[str]:
    """MOD-25: needs the split column; target and offset exist and differ.

    Names match case-insensitively; returns the predictors (all other columns).
    """
    upper = {c.upper(): c for c in df.columns}
    if split_col.upper() not in upper:
        raise ValueError(f"model view needs a {split_col} column")
    for n in (target, offset):
        if n.upper() not in upper:
            raise ValueError(f"column {n} not found")
    if target.upper() == offset.upper():
        raise ValueError("target and offset must differ")
    skip = {split_col.upper(), target.upper(), offset.upper()}
    return [c for c in df.columns if c.upper() not in skip]
