"""expstudy: actuarial experience studies as Spark DataFrame jobs.

Sub-packages
------------
sources    readers, catalog helpers and writers (SRC-*, SNK-*)
functions  column-expression builders (clip, Poisson density, splines, names)
operators  the study operators: preparation, measures, design, tree, lasso,
           scoring, factor tables, lineage, bounded queries
plans      surrogate study views over the test tables and the query registry
streaming  stateless model scoring on a streaming DataFrame
"""

from expstudy.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
