"""Session, staging and skew helpers shared by all operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one key from which a key counts as hot, and the most keys that are salted. A key
#: below the cut holds at most 1/MAX_HOT_KEYS of all rows, so no cap on results follows from it.
HOT_ROWS, MAX_HOT_KEYS, SALTS = 200_000, 1024, 64
#: Rows up to which a counted key table is broadcast; beyond it the join is a salted shuffle join.
BROADCAST_ROWS = 100_000


def session(app: str = "sdlweave", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SDLWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers that see this file system import the package, wherever they were started.

    On a cluster without it the package comes by ``--py-files`` or is installed.
    """
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *known])


_own_folder: list[str] = []
_staged: list[tuple[str, object]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one that ``setCheckpointDir`` has set.

    Where neither is set a local master (tests) gets a folder of our own; on a cluster that is an error, since the
    folder of one machine is not there on another.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if not _own_folder:
        path = tempfile.mkdtemp(prefix="sdlweave-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_folder.append(path)
    return _own_folder[0]


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the input once, stores it by column and compressed, and
    survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_drop_at_exit)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    _staged.append((path, p.getFileSystem(spark._jsc.hadoopConfiguration())))
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Delete what this process staged; call it when no result that reads it is needed any more. Done at its end in any case."""
    while _staged:
        path, files = _staged.pop()
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def unstage(df: DataFrame) -> None:
    """Delete the staged table that ``df`` is; no result that reads it may be needed any more."""
    files = df.inputFiles()
    for path, system in [x for x in _staged if files and f"{x[0]}/" in files[0]]:
        system.delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)
        _staged.remove((path, system))


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of results that were staged and are referred to no more."""
    gc.collect()
    spark._jvm.System.gc()


def _drop_at_exit() -> None:
    jvm = SparkContext._jvm
    while _staged and jvm is not None:
        path, files = _staged.pop()
        try:
            files.delete(jvm.org.apache.hadoop.fs.Path(path), True)
        except Exception:  # noqa: BLE001 - the JVM may be gone by now
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than there are, as a small single file has; else as it is.

    For CPU-bound Python stages: a large input is never moved by this, nor one that is shuffled anyway.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # counting its partitions would run its stages
        return df
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least ``hot_rows`` rows, at most MAX_HOT_KEYS of them (the largest).

    Counting combines on the map side, so a hot key costs one row per task.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= hot_rows).orderBy(F.desc("_n"), *keys).limit(MAX_HOT_KEYS).drop("_n")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, salts: int = SALTS) -> DataFrame:
    """Equi-join in which every hot key of ``big`` is spread over ``salts`` tasks.

    ``small`` repeats only the rows of hot keys. ``how`` is inner, left or left_semi. Null keys never match.
    """
    if hot is None:
        hot = hot_keys(big, keys)
    marked = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # at most MAX_HOT_KEYS rows
    # a salt from the row itself stays the same when a lost task runs again
    spread = [f.name for f in big.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    b = big.join(marked, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    s = small.join(marked, keys, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return b.join(s, [*keys, "_salt"], how).drop("_salt")


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` if it was counted to hold at most ``limit`` rows, else join by salted shuffle."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how)
