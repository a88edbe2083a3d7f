"""A value that an expression uses several times, computed once for each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``. Spark puts a column's expression in each place that names it, in lambdas for each element; a lambda's
    own argument is computed before it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
