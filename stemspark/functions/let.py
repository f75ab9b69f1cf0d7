"""A name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once a row however often the body uses it.

    Without it, projections that are merged put a copy of the whole expression at each place, and a lambda computes
    each copy for every element."""
    return F.get(F.transform(F.array(F.col(value) if isinstance(value, str) else value), body), 0)
