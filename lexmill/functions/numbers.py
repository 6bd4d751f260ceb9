"""Numbers that come out alike wherever they are summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millionths(x: Column | str) -> Column:
    """A double in millionths, rounded half up, as a long: free of the last digits that depend on the order of a sum."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e6 + 0.5).cast("long")


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or null."""
    a, b = (F.col(v) if isinstance(v, str) else v for v in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))
