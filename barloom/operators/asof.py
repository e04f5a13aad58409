"""As-of joins: the newest row of one side at or before each row of the other.

Rows meet in time buckets of a key, so that a key with a long history is spread over
many tasks. What a bucket inherits from earlier ones is computed on one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_before(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, take: list[str], bucket: str = "day", tolerance: str | None = None) -> DataFrame:
    """left with the columns `take` of the newest right row of equal keys whose right_ts <= left_ts; null if there is none.

    tolerance, an interval such as '1 HOUR', also demands right_ts > left_ts - tolerance. Times of right are unique within a key.
    """
    value = F.struct(F.col(right_ts).alias("_at"), *take).alias("_v")
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_ts"), value, F.date_trunc(bucket, right_ts).cast("timestamp_ntz").alias("_bucket"))
    ll = left.select(*keys, F.col(left_ts).alias("_ts"), F.date_trunc(bucket, left_ts).cast("timestamp_ntz").alias("_bucket"), F.struct(*left.columns).alias("_row"))
    newest = r.groupBy(*keys, "_bucket").agg(F.max_by("_v", "_ts").alias("_v"))
    nothing = F.lit(None).cast(r.schema["_v"].dataType)
    buckets = newest.unionByName(ll.select(*keys, "_bucket").distinct().withColumn("_v", nothing)).groupBy(*keys, "_bucket").agg(F.max_by("_v", F.col("_v").isNotNull()).alias("_v"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.select(*keys, "_bucket", F.last("_v", ignorenulls=True).over(earlier).alias("_carry"))
    both = r.withColumn("_row", F.lit(None).cast(ll.schema["_row"].dataType)).unionByName(ll.withColumn("_v", nothing))
    within = Window.partitionBy(*keys, "_bucket").orderBy("_ts", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_v", F.last("_v", ignorenulls=True).over(within)).where(F.col("_row").isNotNull())
    met = met.join(carry, [*keys, "_bucket"], "left").withColumn("_v", F.coalesce("_v", "_carry"))
    if tolerance:
        met = met.withColumn("_v", F.when(F.col("_v._at") > F.col("_ts") - F.expr(f"INTERVAL {tolerance}"), F.col("_v")))
    return met.select("_row.*", *(F.col(f"_v.{c}").alias(c) for c in take))
