"""Session factory, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "vellumspark") -> SparkSession:
    """A session for tests and single-node runs; on a cluster pass your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``; only where the
    setting is absent (tests, single node) a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        else:  # a single node without the setting: a temporary folder, removed when the process ends
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
            folder = tempfile.mkdtemp(prefix="vellum-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = f"file://{folder}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vellum-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the shared scratch folder and read it again.

    Unlike a cached or local checkpoint the copy survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    # Removed when the application ends: results are read from it until then.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all slots where its input has fewer splits than half of them (small single files).

    Inputs with enough splits, such as any large table, are left as they are: no shuffle is added there.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < max(2, slots // 2) else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, once a Spark application, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    from pathlib import Path

    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="vellum-ship-")  # read by the driver's file server only
    archive = shutil.make_archive(os.path.join(folder, "vellumspark"), "zip", here.parent, here.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
