"""Row numbers over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoweave.plans.tables import keep


def global_rank(df: DataFrame, *order: str, name: str = "nth") -> DataFrame:
    """``df`` with ``name``: its place from 0 in the order of the given columns.

    Rows are range-partitioned and numbered inside their partition; the sizes of the partitions before give the rest.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at, _ = keep(at.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"), "ranked")
    before, total = [], 0
    for r in at.groupBy("_part").agg(F.count("*").alias("k")).orderBy("_part").collect():  # one row per partition
        before.append((r["_part"], total))
        total += r["k"]
    offsets = df.sparkSession.createDataFrame(before, "_part bigint, _before bigint")
    return at.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")
