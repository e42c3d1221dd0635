"""Session helpers: defaults for local runs, and shipping of the package to Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_written: dict[str, list[str]] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("siltstone")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; on a single machine one of our own, elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siltstone-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder of this application in the shared folder; it goes when the application ends, or earlier by ``discard``."""
    path = f"{shared_folder(spark)}/siltstone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts the lineage: what follows rereads the files if an executor is lost, and costly
    Python stages run once however often the result is used.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: its plan begins anew."""
    return stage(df, "cut")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt out evenly, or by keys, before each of them costs much: a small file is a single task else."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def spread_far(df: DataFrame, *keys: str, share: int = 8) -> DataFrame:
    """Rows dealt out by keys over ``share`` times as many tasks as read them, so that what a task holds does not grow with the table."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, share * df.rdd.getNumPartitions()), *keys)


def spread_few(scan: DataFrame) -> DataFrame:
    """A table as it is read, dealt out evenly if it has fewer parts than there are cores."""
    return spread(scan) if scan.rdd.getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism else scan


def discard(spark: SparkSession) -> None:
    """Delete this application's intermediate folders; call it when no result that reads them is pending."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _at_end() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            discard(spark)
    except Exception:  # the gateway may be gone already; the folder is the cluster's to clean then
        pass


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless the job's own set-up already does.

    A job that is submitted with ``--py-files`` or with the folder on PYTHONPATH needs nothing;
    otherwise the package goes out once per session as a zip file.
    """
    known = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in known or os.getcwd() == str(ROOT) or getattr(spark, "_siltstone_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="siltstone-")) / "siltstone.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "siltstone").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(target))
    spark._siltstone_shipped = True
