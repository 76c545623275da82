"""Session, lineage and skew helpers shared by all operators."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is salted if it has more rows than this; each salt then serves about as many.
HEAVY_ROWS = 20_000
#: Up to so many heavy keys are broadcast; more are told to the rows by a salted join.
MOST_BROADCAST = 100_000
#: Tasks that a row without a known key is dealt over when heavy keys are told by a join.
SALTS = 32
#: Links of a graph that one task holds in memory; a graph of no more is solved in one piece.
FRAGMENT_ROWS = 250_000

_written: list[tuple[SparkSession, str]] = []


def session(app: str = "quillmesh", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    master = f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]"
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLMESH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir of the session. Only a session on this machine alone, started without
    one, gets a folder of its own, for as long as the process lives."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="quillmesh-")
    return f"file://{own}"


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that later stages survive the loss of executors without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmesh/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def extend(table: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a table made by cut() with the rows of df beside its own, those rows): df is written once, and rounds that add to a table
    keep plans of one shape, however many they are. Readers of the table before see what it had when they were planned."""
    spark, path = df.sparkSession, table._quill_path
    part = f"{path}/{uuid.uuid4().hex}"
    df.select(*table.columns).write.option("compression", "zstd").parquet(part)
    whole = spark.read.schema(table.schema).option("recursiveFileLookup", "true").parquet(path)
    whole._quill_path = path
    return whole, spark.read.schema(table.schema).parquet(part)


def release(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing lazy refers to any more."""
    for df in tables:
        path = getattr(df, "_quill_path", None)
        if path:
            _delete(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):
            _delete(spark, path)
    own = getattr(shared_dir, "own", None)
    if own:
        import shutil

        shutil.rmtree(own, ignore_errors=True)


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 2)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """For steps that are costly per row: an input of fewer splits than tasks wanted is dealt evenly over those; a larger one
    is read in its own splits, without a shuffle."""
    spark = df.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    splits = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // split
    want = parallelism(spark) * factor
    return df.repartition(want) if splits < want else df


class Heavy:
    """The keys with more than HEAVY_ROWS rows and the number of salts for each, written once and counted.

    However many there are, each is salted: up to MOST_BROADCAST the list is broadcast, beyond that the rows learn of it
    by a join in which both sides are dealt over SALTS.
    """

    def __init__(self, counts: DataFrame, key: str, n: str, rows: int = HEAVY_ROWS):
        hot = counts.filter(F.col(n) > rows).select(F.col(key).alias("_key"), F.ceil(F.col(n) / rows).cast("int").alias("_salts"))
        self.table = cut(hot)
        self.n = self.table.count()

    def told(self, df: DataFrame, key: str, by: Column | None = None) -> DataFrame:
        """df with the column _salts: the number of salts of a heavy key, 1 for all others."""
        if not self.n:
            return df.withColumn("_salts", F.lit(1))
        hot = self.table.withColumnRenamed("_key", key)
        if self.n <= MOST_BROADCAST or by is None:
            got = df.join(F.broadcast(hot) if self.n <= MOST_BROADCAST else hot, key, "left")
        else:
            many = hot.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            got = df.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(many, [key, "_deal"], "left").drop("_deal")
        return got.withColumn("_salts", F.coalesce("_salts", F.lit(1)))


def salted_join(left: DataFrame, right: DataFrame, key: str, heavy: Heavy, by: Column, how: str = "inner") -> DataFrame:
    """left ⋈ right on key, where right has one row per key and the heavy keys hold many rows of left.

    Rows of a heavy key are dealt over its salts by the hash of by; the one matching row of right is repeated per salt.
    """
    if not heavy.n:
        return left.join(right, key, how)
    a = heavy.told(left, key, by).withColumn("_salt", F.pmod(F.xxhash64(by), F.col("_salts")).cast("int")).drop("_salts")
    b = heavy.told(right, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def blank(c: Column | str) -> Column:
    """True for null and for text of white space alone."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ~c.rlike(r"(?U)\S")
