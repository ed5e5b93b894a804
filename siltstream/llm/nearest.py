"""Pairing records with the nearest record in time, by expanding rings.

The first ring has narrow time buckets. A left row meets the right rows of its own bucket and
the nearest right row of each adjacent one; a match no farther than the covered stretch reaches
on both sides is provably the nearest and is settled. Rows that are not settled go on to a ring
of buckets twice as wide, until a bucket is as wide as the tolerance, where everything within
the tolerance has been seen.

No pairs are formed. Inside a bucket a merge in time order finds the neighbours; of any other
bucket only its first and last right row can matter, so each ring works with the right side
aggregated to two rows a bucket (combined before the shuffle, fewer in each wider ring). Keys
are (entity, bucket): an entity that holds a third of all rows is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import stage


def _closer(a: Column, b: Column, t: Column) -> Column:
    """The nearer of two candidates struct(t, id) to t; the earlier one if they tie."""
    da, db = F.abs(a["t"] - t), F.abs(b["t"] - t)
    return F.when(a.isNull(), b).when(b.isNull(), a).when(da < db, a).when(db < da, b).otherwise(F.least(a, b))


def _ends(buckets: DataFrame) -> DataFrame:
    """The first and last right row of each bucket that has one. Of two rows at one time the one with the smaller id is both."""
    return buckets.groupBy("entity", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _sides(ends: DataFrame) -> DataFrame:
    """For each bucket the nearest right row of the bucket before it and of the bucket after it."""
    none = F.lit(None).cast("struct<t:bigint,id:bigint>")
    last = F.struct(F.col("last.t").alias("t"), F.negative("last.id").alias("id"))
    return ends.select("entity", F.explode(F.array(
        F.struct((F.col("bucket") + 1).alias("bucket"), last.alias("before"), none.alias("after")),
        F.struct((F.col("bucket") - 1).alias("bucket"), none.alias("before"), F.col("first").alias("after")),
    )).alias("s")).select("entity", "s.*")


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_us: int, first_width_us: int | None = None) -> DataFrame:
    """For each left row the right row of the same entity nearest in time: entity, left_id, right_id, distance_us.

    left and right: entity, id (long), t (microseconds); other columns are not read. Rows with
    a null in one of the three pair with nothing. A left row without a right row within the
    tolerance (included) gives no row; one right row may serve many left rows. Of two right rows
    equally near the earlier one counts, of several at one time the one with the smallest id. Repeated
    left rows (equal entity, id and t) count once. Empty tables give an empty result.
    """
    if tolerance_us < 0:
        raise ValueError("the tolerance is 0 or more")
    width = max(1, first_width_us or -(-tolerance_us // 4))
    cols = ["entity", "id", "t"]
    left = left.select(F.col("entity"), F.col("id").cast("long"), F.col("t").cast("long")).dropna()
    right = right.select(F.col("entity"), F.col("id").cast("long"), F.col("t").cast("long")).dropna()
    bucket = F.floor(F.col("t") / width)
    reach = lambda w: F.least(F.col("t") - (F.floor(F.col("t") / w) - 1) * w, (F.floor(F.col("t") / w) + 2) * w - 1 - F.col("t"))

    # ring 1: merge of both sides in each bucket; right rows of adjacent buckets come as their nearest ends
    mine = left.select(*cols, bucket.alias("bucket"), F.lit(1).cast("byte").alias("side"))
    own = right.select(*cols, bucket.alias("bucket"), F.lit(0).cast("byte").alias("side"))
    ends = _ends(own.select("entity", "bucket", F.struct("t", "id").alias("first"), F.struct("t", F.negative("id").alias("id")).alias("last")))
    ends = stage(ends, "ends")  # each ring makes its own of the ring before it
    near = _sides(ends).select("entity", F.coalesce(F.col("before"), F.col("after")).alias("r"), "bucket")
    near = near.select("entity", F.col("r.id").alias("id"), F.col("r.t").alias("t"), "bucket", F.lit(0).cast("byte").alias("side"))
    # what a row says is not said twice in the shuffle
    both = mine.union(own).union(near).repartition("entity", "bucket").withColumn("r", F.when(F.col("side") == 0, F.struct("t", "id")))
    # a right row at the same time sorts before the left row; of equal times the smallest id is the last before and the first after
    past = Window.partitionBy("entity", "bucket").orderBy(F.col("t"), F.col("side"), F.col("id").desc())
    ahead = Window.partitionBy("entity", "bucket").orderBy(F.col("t").desc(), F.col("side"), F.col("id").desc())
    copy = (F.lag("id").over(past) == F.col("id")) & (F.lag("side").over(past) == F.col("side")) & (F.lag("t").over(past) == F.col("t"))
    seen = both.withColumn("before", F.last("r", True).over(past.rowsBetween(Window.unboundedPreceding, -1))).withColumn("copy", copy)
    seen = seen.withColumn("after", F.last("r", True).over(ahead.rowsBetween(Window.unboundedPreceding, -1))).filter("side = 1 and copy is not true")
    seen = seen.withColumn("best", _closer(F.col("before"), F.col("after"), F.col("t"))).select(*cols, "best")

    done = []
    while True:
        gap = F.abs(F.col("best.t") - F.col("t"))
        settled = F.coalesce(gap <= reach(width), F.lit(False)) | F.lit(width >= tolerance_us)
        table = stage(seen.select("entity", "id", "t", F.col("best.t").alias("rt"), F.col("best.id").alias("rid"), (~settled).alias("open")), "ring", ["open"])
        done.append(table.filter("not open"))
        if width >= tolerance_us:
            break
        width *= 2  # exactly twice, so that old buckets nest in new ones
        rest = table.filter("open").withColumn("bucket", F.floor(F.col("t") / width))
        ends = _ends(ends.withColumn("bucket", F.floor(F.col("bucket") / 2)))
        sides = _sides(ends).groupBy("entity", "bucket").agg(F.max("before").alias("before"), F.min("after").alias("after"))
        best = F.when(F.col("rt").isNotNull(), F.struct(F.col("rt").alias("t"), F.col("rid").alias("id")))
        seen = rest.join(sides, ["entity", "bucket"], "left").select(*cols, _closer(best, _closer(F.col("before"), F.col("after"), F.col("t")), F.col("t")).alias("best"))
    out = reduce(DataFrame.union, done).withColumn("distance_us", F.abs(F.col("rt") - F.col("t"))).filter(F.col("distance_us") <= tolerance_us)
    return out.select("entity", F.col("id").alias("left_id"), F.col("t").alias("left_t"), F.col("rid").alias("right_id"), "distance_us")
