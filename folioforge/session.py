"""Session construction and the few settings that operators read from it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "folioforge", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive execution, no UI."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, from ``spark.checkpoint.dir`` or setCheckpointDir.

    A local session without one gets a folder of its own, removed at exit. On a cluster
    that is an error: a folder of one machine would lose what other executors write."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="folioforge-ckpt-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


def shared_folder(spark: SparkSession) -> str:
    """A new path for files within the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/folioforge-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The table survives the loss of any executor. Unlike a checkpoint it doesn't carry the
    estimated size of the plan behind it, which in a loop of joins grows beyond bounds.
    ``replaces`` is an earlier result that nothing reads any more; its files are deleted.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folioforge_path = path  # type: ignore[attr-defined]
    if replaces is not None:
        drop_table(replaces)
    return back


def drop_table(df: DataFrame) -> None:
    """Delete the files of a result of ``cut_lineage`` that nothing reads any more."""
    if path := getattr(df, "_folioforge_path", None):
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
