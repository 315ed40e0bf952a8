"""A value that an expression names more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` names it.

    Expressions that repeat their argument grow as a power of their depth if they are nested; bound, they add up.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))
