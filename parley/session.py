"""Sessions, work folders and input spreading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(name: str = "parley", cpus: int | str = "*") -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    width = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is run from a source tree that executors do not have on their
    path; a cluster with the package installed can leave it out.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="parley-"), "parley"),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=os.path.basename(package),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder the cluster names.

    Only a local session without that setting gets a temporary folder: on a
    cluster a machine-local folder would be lost with its executor.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/parley/{purpose}-{uuid.uuid4().hex}"


def computed_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column so that filters never compute it again.

    The optimizer pushes a filter on such a column below its projection and then runs
    the column twice.  It cannot do so through a generator, while filters on all other
    columns still reach the scan.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Spread a small input over the cluster before CPU-heavy columns.

    A file with one row group is read by one task however many cores there are.
    Inputs large enough to fill the cluster by themselves are left alone, so at
    scale this adds no shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= cores * split:
        return df
    return df.repartition(partitions or cores * 2)
