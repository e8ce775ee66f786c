"""Order-dependent values over groups too large for one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 20_000


def running_total(rows: DataFrame, group: str, order: str, value: str, key: str, out: str) -> DataFrame:
    """rows with the sum of ``value`` up to and with each row of its group, by the uniform 64-bit ``order``, then key.

    The leading bits of ``order`` cut a group into buckets of about BUCKET_ROWS rows; totals of the buckets give the
    offsets, so no group is sorted in one task. ``rows`` is read twice and should be cheap to read.
    """
    largest = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    bits = min(40, max(0, math.ceil(math.log2(max(1, largest / BUCKET_ROWS)))))
    bucket = F.shiftrightunsigned(F.col(order), 64 - bits) if bits else F.lit(0).cast("bigint")
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy(group, "_bucket").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(group, "_bucket", before.alias("_before"))
    inside = Window.partitionBy(group, "_bucket").orderBy(order, key).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn(out, F.sum(value).over(inside)).join(offsets, [group, "_bucket"])
    return summed.withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_before")
