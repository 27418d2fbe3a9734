"""Row numbers that no single task has to give: over a whole table, or within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from giurispark.session import cut


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """Row numbers from 1 within each group, in the order given (it must leave no ties).

    The rows are range-partitioned by group and order, numbered within each part, and moved up by what the
    earlier parts hold of the same group; only those counts, one for each part and group, are gathered.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    placed = cut(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_of_{g}") for g in group], F.col("_part").alias("_of_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("_part") == F.col("_of_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    within = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    return placed.withColumn("_row", within).join(offsets, on).select(*df.columns, (F.col("_row") + F.col("_before")).cast("int").alias(name))
