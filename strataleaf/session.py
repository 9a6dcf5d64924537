"""Session settings and the one way in which this library cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "strataleaf", cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for; on a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``. Only a local session, as in tests, gets a temporary
    one where that is unset; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="strataleaf-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared folder and read again from there, which survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a table below the shared folder and read again: lineage is cut, and it is read by column as often
    as needed. The tables of an application are removed when it ends (:func:`remove_written`)."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if base not in _written:
        _written.add(base)
        atexit.register(remove_written, spark)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: set[str] = set()


def remove_written(spark: SparkSession) -> None:
    """Remove the tables that :func:`written` made in this application; results that are still to be computed from them
    must have been stored before."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    for base in [b for b in _written if b.endswith(context.applicationId)]:
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _written.discard(base)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(ship, "sent", None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strataleaf-")) / "strataleaf-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    ship.sent = context.applicationId
