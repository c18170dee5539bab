"""Design rows as (column, value) pairs, made per Arrow batch from baked predictors (MOD-5 .. MOD-8).

A design row has few non-zero entries however many columns the design has: a factor gives one, a
spline one for each of its columns, and an interaction the product.  So only the baked
predictors are stored (a level number or a clipped number for each), and a worker expands a batch
into two matrices of the same shape, column numbers and values.  A slot whose factor has
its reference level, or no level, has the value zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from expstudy.operators.design import NS, Design


class SparseRows:
    """Expands baked predictors to design rows; small and picklable."""

    def __init__(self, design: Design):
        recipe, place = design.recipe, {v: i for i, v in enumerate(design.variables)}
        self.p, self.terms, first = len(design.columns), [], 0
        for term in design.terms:
            own = [c for c in design.columns if c.term == term]
            parts = []
            for k, comp in enumerate(term.components):
                at = place[comp.var]
                if isinstance(comp, NS):
                    parts.append(("ns", at, comp.spline))
                elif comp.var in recipe.levels:
                    used = list(dict.fromkeys(c.parts[k][1] for c in own))
                    options = {x: i for i, x in enumerate(used)}
                    # by level number, the last entry is for none
                    parts.append(("lvl", at, np.array([options.get(x, -1) for x in recipe.levels[comp.var]] + [-1]), len(used)))
                else:
                    parts.append(("num", at))
            self.terms.append((first, parts))
            first += len(own)

    def __call__(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Column numbers and values, rows x slots."""
        n, index, value, bases = len(columns[0]) if columns else 0, [], [], {}
        for first, parts in self.terms:
            at, v, stride = np.full((n, 1), first, np.int64), np.ones((n, 1)), 1
            for part in parts:  # the first component varies fastest
                x = columns[part[1]]
                if part[0] == "num":
                    v = v * x[:, None]
                elif part[0] == "lvl":
                    option = part[2][x.astype(np.int64)]
                    v, at, stride = v * (option >= 0)[:, None], at + np.maximum(option, 0)[:, None] * stride, stride * part[3]
                else:
                    key = (part[1], part[2])
                    if key not in bases:  # ages and the like take few values
                        seen, where = np.unique(x, return_inverse=True)
                        bases[key] = part[2].evaluate(seen)[where]
                    b = bases[key]
                    shape = (n, at.shape[1] * b.shape[1])
                    at = (at[:, :, None] + stride * np.arange(b.shape[1])).reshape(shape)
                    v, stride = (v[:, :, None] * b[:, None, :]).reshape(shape), stride * b.shape[1]
            index.append(at)
            value.append(v)
        if not index:
            return np.zeros((n, 0), np.int64), np.zeros((n, 0))
        return np.concatenate(index, axis=1), np.concatenate(value, axis=1)

    def batch(self, b: pa.RecordBatch, variables: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a record batch whose first columns are the baked predictors."""
        return self([b.column(i).to_numpy(zero_copy_only=False) for i in range(variables)])


def dense(index: np.ndarray, value: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """The chosen columns of sparse rows, with a leading column of ones: ``place`` gives each
    column's position among the chosen, or -1."""
    out = np.zeros((len(index), width + 1))
    out[:, 0] = 1.0
    at = place[index]
    rows, slots = np.nonzero((at >= 0) & (value != 0))
    out[rows, at[rows, slots] + 1] = value[rows, slots]
    return out
