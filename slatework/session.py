"""Session, table access and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "slatework", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass the cluster's own session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.checkpoint.compress", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SLATEWORK_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the executors once per context, where they don't find it by PYTHONPATH."""
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(root) in paths or getattr(sc, "_slatework_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="slatework-")) / "slatework.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((root / "slatework").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(out))
    sc._slatework_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as a lazily read Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    jsc = spark.sparkContext._jsc.sc()
    at = jsc.getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="slatework-checkpoint-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that later jobs neither recompute nor depend on executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_stored: dict[str, SparkSession] = {}


def store(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read from there: columns are pruned and compressed.

    It survives the loss of executors. ``discard`` deletes it; what is left goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._slatework_path = path
    _stored[path] = spark
    return out


def discard(*stored: DataFrame) -> None:
    """Deletes tables of ``store`` that no later job reads; other frames are left alone."""
    for df in stored:
        _delete(getattr(df, "_slatework_path", ""))


def _delete(path: str) -> None:
    spark = _stored.pop(path, None)
    if spark is not None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_stored):
        with contextlib.suppress(Exception):
            _delete(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints of frames no longer in use, which it does as the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blocks(df: DataFrame, size: int) -> int:
    """How many driver-sized blocks of at most ``size`` rows ``df`` needs; at least one."""
    return max(1, -(-df.count() // size))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a few large files over all tasks, ahead of work that costs more than a shuffle of them; equal ``keys`` meet in one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, 2 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def hash01(*cols, seed: int = 0):
    """A uniform number in [0, 1) that depends on nothing but the columns and ``seed``."""
    return (F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / F.lit(float(1 << 53))
