"""Dense numbers along an order, in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import small, written

#: monotonically_increasing_id() counts a task's rows in its lowest bits.
ROW_BITS = 33


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n", total: str | None = None, start: int = 0) -> DataFrame:
    """Adds `name`: `start`, `start` + 1, ... along `order` within each value of `by` (all rows, if empty; nulls are a
    value), and `total`, the number of rows with that value, if asked for.

    Rows are dealt by ranges of (by, order), sorted and counted in their tasks; what is gathered is one row per value
    and task, whose counts say by how much a task's numbers move. So a value that most rows have is spread over many
    tasks, and no window sees the rows. Rows that are equal in (by, order) lie in one task, in any order.
    """
    sort = [*by, *order]
    cut = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())
    cut = written(cut, "numbered").withColumn("__task", F.shiftright("__at", ROW_BITS))
    each = cut.groupBy(*by, "__task").agg(F.min("__at").alias("__from"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(
        *(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), F.col("__task").alias("__t"),
        (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__from") + start).alias("__move"), F.sum("__rows").over(Window.partitionBy(*by)).alias("__all"),
    )
    same = F.col("__t") == F.col("__task")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
    out = cut.join(small(written(each, "tasks")), same).withColumn(name, F.col("__at") + F.col("__move"))
    return out.select(*rows.columns, name, *([F.col("__all").alias(total)] if total else []))
