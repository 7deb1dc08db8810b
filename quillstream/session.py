"""Session settings, the shared folder, and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator broadcasts after it has counted its rows.
BROADCAST_BYTES = 24 << 20
_KEPT: list[str] = []


def local_session(cpus: str | int = "*", shuffle: int = 8, app: str = "quillstream") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSTREAM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on
    a cluster it is an error, as executors share no local folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("quillstream.shared.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="quillstream-")
            spark.conf.set("quillstream.shared.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder; its lineage ends there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES, else df as it is (Spark then shuffles)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package's code to the Python workers, once per context: they need not find it on their own path."""
    context = spark.sparkContext
    if getattr(context, "_quillstream_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="quillstream-code-")) / "quillstream-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._quillstream_shipped = True


def keep(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, computed once; for intermediate tables that several branches read. Unlike
    what cut() leaves, which Spark cleans up, the table stays until release() or the end of the session's process."""
    path = fresh_path(df.sparkSession, "kept")
    _KEPT.append(path)
    if len(_KEPT) == 1:
        atexit.register(release, df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes the tables that keep() has written so far; results that read them must have been used before."""
    if spark.sparkContext._jsc is None:
        return
    while _KEPT:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
