"""Session and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tarnfold", cpus: int | str = 8, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, pass your own session to the operators."""
    parts = shuffle or (cpus if isinstance(cpus, int) else 8)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return with_package(spark)


def with_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package from where the driver has it, whatever their working
    folder. On a cluster the package is installed or shipped with --py-files; a path that is absent there does no harm."""
    root, known = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own only where none is set and the master is
    local, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not found and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="tarnfold-checkpoint-"))
    return found or str(jsc.getCheckpointDir().get())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours that nothing reads any more, in whatever store it is; an absent one is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder: lineage ends there and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
