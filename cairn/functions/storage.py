"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a new temporary one, but on one machine only: executors
    of a cluster don't see each other's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = own.get()
    return folder


#: Has Spark delete a query's shuffle files as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and outlives lost executors. It goes when Spark ends.

    The shuffle files of the query that writes it go when it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._cairn_path = path
    return table


def drop(table: DataFrame) -> None:
    """Deletes a table that written() made. Everything that reads it must be written itself by then."""
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(table._cairn_path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless their Python finds it anyway (by PYTHONPATH or as the working folder)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == os.path.realpath(root) for p in found) or spark.sparkContext.applicationId in _shipped:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cairn-"), "cairn"), "zip", root, "cairn")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)


_shipped: set[str] = set()
