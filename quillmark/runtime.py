"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillmark", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is written for; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only the columns a query uses are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the session's checkpoint directory. On a cluster one must be named; only a
    local session without one gets a folder of its own.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
        conf = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), f"quillmark-{os.getpid()}")
    sc.setCheckpointDir(conf)
    return sc._jsc.sc().getCheckpointDir().get()


_written: dict[str, SparkSession] = {}


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM: the same calls whatever store the path lies in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def discard(*tables: DataFrame) -> None:
    """Delete written tables that are no longer read; without arguments all of them. A long session calls this when the
    result of a query has been taken."""
    for path in [getattr(t, "_written_at", None) for t in tables] if tables else list(_written):
        if path is not None and (spark := _written.pop(path, None)) is not None:
            try:
                fs, p = file_system(spark, path)
                fs.delete(p, True)
            except Exception:  # the session may have ended first
                pass


atexit.register(discard)


def scratch(spark: SparkSession, what: str = "t") -> str:
    """A path of its own in the shared folder, deleted with the written tables."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, what: str = "t") -> DataFrame:
    """Write a table in the shared folder and read it back: cuts the lineage, survives lost executors,
    and lets later steps read only the columns they need."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back
