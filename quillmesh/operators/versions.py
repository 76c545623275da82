"""History of changing entity attributes: versions with their validity, by gaps and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import HEAVY_ROWS, Heavy, cut


def versions(rows: DataFrame, key: str, at: str, attributes: Sequence[str], order: str, ends: Column | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """A row per longest run of equal attributes of a key: key, attributes, valid_from, valid_to.

    Of rows with equal (key, at) only the one with the largest order counts. Attributes compare with null equal to
    null. valid_to is the start of the next run, null if none follows. Runs for which ends is true close the run
    before them and are none themselves. Rows with a null key or at are no observations and are left out. Other
    columns are ignored.

    Rows of keys with more than heavy_rows rows are sorted into ranges of key and time over all tasks, whatever the key;
    what the stretches of a key need of each other (their last attributes and the first start after them) is a row per
    stretch.
    """
    attributes = list(attributes)
    known = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    one = known.groupBy(F.col(key).alias("k"), F.col(at).alias("t"))
    obs = one.agg(F.max_by(F.struct(*attributes), F.coalesce(F.col(order), F.lit(-(2**63)))).alias("v"))
    obs = obs.withColumn("h", F.xxhash64(*[F.struct(F.col(f"v.{a}").isNull(), F.col(f"v.{a}")) for a in attributes]))
    heavy = Heavy(known.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")), "k", "n", heavy_rows)
    if heavy.n:
        told = heavy.told(obs, "k", F.col("t"))
        hot = told.filter("_salts > 1").drop("_salts").repartitionByRange("k", "t").withColumn("part", F.spark_partition_id())
        obs = told.filter("_salts = 1").drop("_salts").withColumn("part", F.lit(-1)).unionByName(cut(hot))
    else:
        obs = obs.withColumn("part", F.lit(-1))
    w = Window.partitionBy("k", "part").orderBy("t")
    before, first = F.lag(F.struct("h", "v")).over(w), F.row_number().over(w) == 1
    if heavy.n:
        # Attributes at the end of the stretch before, a row per stretch of a heavy key.
        tails = obs.filter("part >= 0").groupBy("k", "part").agg(F.max_by(F.struct("h", "v"), "t").alias("tail"))
        tails = tails.select("k", "part", F.lag("tail").over(Window.partitionBy("k").orderBy("part")).alias("carried"))
        obs = obs.join(tails, ["k", "part"], "left")
        before = F.coalesce(before, F.when(first, F.col("carried")))
    obs = obs.withColumn("before", before)
    changed = F.col("before").isNull() | (F.col("before.h") != F.col("h")) | ~F.col("before.v").eqNullSafe(F.col("v"))
    obs = obs.withColumn("starts", changed).withColumn("island", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # Island 0 of a stretch goes on from the stretch before it and has no start of its own.
    runs = obs.filter(F.col("island") > 0).groupBy("k", "part", "island").agg(F.min("t").alias("valid_from"), F.min_by("v", "t").alias("v"))
    runs = runs.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("k", "part").orderBy("island")))
    if heavy.n:
        heads = runs.filter("part >= 0").groupBy("k", "part").agg(F.min("valid_from").alias("head"))
        parts = obs.filter("part >= 0").select("k", "part").distinct().join(heads, ["k", "part"], "left")
        later = Window.partitionBy("k").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
        parts = parts.select("k", "part", F.min("head").over(later).alias("next_head"))
        runs = runs.join(parts, ["k", "part"], "left").withColumn("valid_to", F.coalesce("valid_to", "next_head"))
    out = runs.select(F.col("k").alias(key), *[F.col(f"v.{a}").alias(a) for a in attributes], "valid_from", "valid_to")
    return out.filter(~F.coalesce(ends, F.lit(False))) if ends is not None else out
