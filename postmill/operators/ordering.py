"""Places in a returned order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import stage

_PLACE = (1 << 33) - 1
#: The sizes of so many partitions are written into the plan; those of more are a broadcast table.
IN_PLAN = 1_000


def numbered(ordered: DataFrame, name: str = "position") -> DataFrame:
    """``ordered`` with each row's place in its order, from 1 and without gaps.

    The rows are stored with their partition and their place in it; the rows of earlier partitions are added, one short number a partition, so no task
    sees all rows and a later use doesn't sort again.
    """
    rows = stage(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33).cast("int"))
    sizes = {r[0]: r[1] for r in rows.groupBy("_part").count().collect()}
    before = list(accumulate((sizes.get(k, 0) for k in range(max(sizes, default=0))), initial=0))
    if len(before) <= IN_PLAN:
        placed = rows.withColumn("_before", F.element_at(F.lit(before).cast("array<bigint>"), F.col("_part") + 1))
    else:
        placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(before)), "_part int, _before long")), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_PLACE) + 1).select(*ordered.columns, name)
