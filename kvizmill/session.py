"""Table access and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows is broadcast.
SMALL_ROWS = 100_000

#: Where the package lies on the driver, and on executors that share its disk or image.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the path of the Python workers; where it isn't there, they need it in another way."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory, lazily."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    It is the one that ``spark.checkpoint.dir`` names, or one that the session
    was given before. Where neither is set, a session whose executors are
    threads of this machine gets a folder of its own; on a cluster that is an
    error, as other machines couldn't read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kvizmill-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and drop its lineage.

    A reliable checkpoint: it survives the loss of executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table into the shared folder and read it from there.

    For what several steps read: a table is smaller than a checkpoint and its
    columns can be read one by one. It stays as long as the folder does.
    """
    path = f"{shared_folder(df.sparkSession)}/kvizmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_kept(spark: SparkSession) -> None:
    """Delete the tables of ``keep``; no DataFrame that reads one may be used after it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "kvizmill-*")) or []:
        files.delete(status.getPath(), True)


def if_small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``most`` rows; else as it is, and Spark joins by shuffling.

    The rows are counted, no further than that: ``df`` should be a stored table
    or cheap.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over more tasks where its input has fewer splits than there are cores, up to eight for each split.

    Only inputs of few files or row groups are shuffled for it; one with as
    many splits as there are cores is left as it is.
    """
    splits, cores = df._jdf.queryExecution().toRdd().getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 8 * splits)) if 0 < splits < cores else df
