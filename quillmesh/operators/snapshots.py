"""What changed between full snapshots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: On average one row in CHUNK_ROWS ends a chunk.
CHUNK_ROWS = 12
#: Up to so many deliveries, the list of deliveries is broadcast.
MANY_SNAPSHOTS = 100_000


def plain(c: str) -> Column:
    """Text without regard to case and outer blanks; blank is null."""
    x = F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    return F.when(x != "", x)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the chunks of one range of keys: a chunk begins with each key whose hash is a boundary.

    The rows come sorted by key; what carries over from batch to batch is one number.
    """
    n = 0
    last = None
    for b in batches:
        key = b.column("edge").to_numpy(zero_copy_only=False)
        ident = b.column("kh").to_numpy(zero_copy_only=False)
        new = np.empty(len(ident), bool)
        if len(ident):
            new[0] = last is None or ident[0] != last
            new[1:] = ident[1:] != ident[:-1]
            last = ident[-1]
        count = n + np.cumsum(new & (key == 0))
        if len(count):
            n = int(count[-1])
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("snapshot_no", "key", "digest", "range_no")], pa.array(count, pa.int64())], names=["snapshot_no", "key", "digest", "range_no", "chunk_no"])


def snapshot_changes(rows: DataFrame, snapshot: str, key: str, latest: str, attributes: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys added, removed and changed in each snapshot against the one delivered before it: snapshot_no, id, change_kind.

    Of several rows of a key in one snapshot the one with the greatest `latest` counts (null is the least; at equal
    times the greatest attributes). Attributes compare without regard to case and outer blanks, blank being null and
    null equal to null; all other columns are ignored. The first snapshot changes nothing. Rows with a null snapshot
    or key are left out.

    The keys of all snapshots are sorted into common ranges and cut into chunks where the hash of a key says so, so
    that the same keys give the same chunks in every snapshot. Per snapshot a chunk is summed into a digest; only
    rows of chunks whose digest differs from that of the snapshot before are joined.
    """
    norm = [plain(a).alias(f"a{i}") for i, a in enumerate(attributes)]
    base = rows.filter(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(F.col(snapshot).cast("int").alias("snapshot_no"), F.col(key).cast("string").alias("key"), F.col(latest).alias("at"), *norm)
    values = F.struct(*[f"a{i}" for i in range(len(norm))])
    one = base.groupBy("snapshot_no", "key").agg(F.max(F.struct("at", values.alias("v"))).alias("m"))
    text = F.concat(*[F.coalesce(F.concat(F.lit("="), F.length(f"m.v.a{i}").cast("string"), F.lit(":"), F.col(f"m.v.a{i}")), F.lit("-")) for i in range(len(norm))])
    one = one.select("snapshot_no", "key", F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest"))
    ranged = one.repartitionByRange("key").withColumn("range_no", F.spark_partition_id()).withColumn("kh", F.xxhash64("key")).withColumn("edge", F.pmod("kh", F.lit(chunk_rows)))
    ranged = ranged.sortWithinPartitions("key", "snapshot_no")
    # Written, as the ranges must be the same for the digests and for the rows.
    chunked = cut(ranged.mapInArrow(_chunks, "snapshot_no int, key string, digest binary, range_no int, chunk_no long"))

    order = Window.orderBy("snapshot_no")
    numbers = chunked.select("snapshot_no").distinct()
    follow = numbers.select("snapshot_no", F.lag("snapshot_no").over(order).alias("prev")).filter("prev is not null")
    turns = follow.select("snapshot_no", F.col("snapshot_no").alias("turn"), F.lit(True).alias("now")).unionByName(follow.select(F.col("prev").alias("snapshot_no"), F.col("snapshot_no").alias("turn"), F.lit(False).alias("now")))
    if numbers.limit(MANY_SNAPSHOTS + 1).count() <= MANY_SNAPSHOTS:
        turns = F.broadcast(turns)

    def sides(df: DataFrame) -> DataFrame:
        """Each row once as the present state of its snapshot and once as the past state of the following one."""
        return df.join(turns, "snapshot_no").drop("snapshot_no").withColumnRenamed("turn", "snapshot_no")

    sums = chunked.groupBy("snapshot_no", "range_no", "chunk_no").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key", "digest")).alias("x"), F.sum(F.hash("digest", "key").cast("long")).alias("s"))
    side = lambda flag: F.max(F.when(F.col("now") == F.lit(flag), F.struct("n", "x", "s")))
    unlike = sides(sums).groupBy("snapshot_no", "range_no", "chunk_no").agg(side(True).alias("p"), side(False).alias("q")).filter(~F.col("p").eqNullSafe(F.col("q"))).select("snapshot_no", "range_no", "chunk_no")

    left = sides(chunked).join(unlike, ["snapshot_no", "range_no", "chunk_no"], "left_semi")
    pair = left.groupBy("snapshot_no", "key").agg(F.max(F.when(F.col("now"), F.col("digest"))).alias("cur"), F.max(F.when(~F.col("now"), F.col("digest"))).alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("cur").isNull(), "removed").when(F.col("old") != F.col("cur"), "changed")
    return pair.withColumn("change_kind", kind).filter("change_kind is not null").select("snapshot_no", F.col("key").alias("id"), "change_kind")
