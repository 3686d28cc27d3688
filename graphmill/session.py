"""Sessions, tables and the shared folder for intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "graphmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine counts on; those of the caller win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, compiled.

    Workers on other machines then need no copy of the repository.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="graphmill-")  # on the driver, which serves the file
    path = os.path.join(folder, "graphmill.zip")
    with zipfile.PyZipFile(path, "w") as z:
        z.writepy(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table <folder>/<name>.parquet, a file or a directory of files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that all executors reach: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder serves on one machine; a cluster
    without it is an error, as its executors share no local folder.
    """
    sc = spark.sparkContext
    mine = os.path.join(tempfile.gettempdir(), "graphmill-checkpoint")
    set_ = sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (set_ if set_ and mine not in set_ else None)
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return mine


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; partitions and their order stay."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: later scans read only the columns and rows they need.

    Unlike a checkpoint it keeps no partitions and no order.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession) -> str:
    """Where this application writes its tables in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/graphmill-{spark.sparkContext.applicationId}"


def sweep(spark: SparkSession) -> None:
    """Deletes the tables that this application wrote to the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
