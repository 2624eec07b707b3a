"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` applied to a value that is computed once per row, however often `use` names it.

    Inside higher-order functions common expressions aren't shared; a variable
    of a one-element transform is.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
