"""Tables laid out by call, for joins and aggregates by call that need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 200


def save_by_call(df: DataFrame, name: str, path: str, buckets: int = BUCKETS, order: tuple[str, ...] = ()) -> None:
    """df as table `name` under path, dealt into buckets by call_id and sorted by call_id (and `order`) in each.

    One shuffle here replaces those of all later reads. Tables that are to be joined need
    equal `buckets`, about a task's worth of rows each. Rows of one call, null included,
    share a bucket and a file. path is a folder that driver and executors share. Extra
    columns stay; an empty table gives an empty table.
    """
    by = df.repartition(buckets, "call_id")
    by.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, "call_id").sortBy("call_id", *order).saveAsTable(name)


def by_call(spark: SparkSession, name: str) -> DataFrame:
    """A table of save_by_call; Spark knows its layout."""
    return spark.table(name)
