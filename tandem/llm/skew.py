"""A join for keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent from so many rows on, or from this share of all rows where that is more: so the frequent
#: keys, which are broadcast, are 1 / FREQUENT_SHARE at most.
FREQUENT_ROWS = 500
FREQUENT_SHARE = 1 / 2000


def join_counted(rows: DataFrame, table: DataFrame, by: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each key and in ``count`` the number of rows of
    the key; ``total`` is the number of rows. Frequent keys are few and are broadcast, the others are shuffled."""
    often = F.col(count) >= max(FREQUENT_ROWS, total * FREQUENT_SHARE)
    few = F.broadcast(table.filter(often))  # 2,000 rows at most
    hot = rows.join(few, by)
    rest = rows.join(few.select(*by), by, "left_anti").join(table.filter(~often), by)
    return hot.unionByName(rest)
