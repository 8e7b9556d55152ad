"""Session helpers: building a local session for tests/bench and making sure a
reliable checkpoint directory exists before any operator cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CKPT: dict[int, str] = {}


def build_session(master: str | None = None, app: str = "kestrel",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local session with the settings the tests and the bench use."""
    master = master or os.environ.get("KESTREL_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("KESTREL_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """In local mode, send this package's modules to the session's Python workers
    once, so that they import it whatever their working folder and PYTHONPATH are.
    On a cluster the package is deployed with the job (``--py-files`` or installed)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or not (sc.master == "local" or sc.master.startswith("local[")):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kestrel-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, f"{package.name}-src.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting one only where unset, and
    see that workers have the package: what every operator needs of a session.

    On a cluster the directory must be a shared folder named by
    ``spark.checkpoint.dir``; only a local-mode session (tests, bench) gets a
    private folder under the system temp directory.
    """
    ship_package(spark)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so ranked operators can cut lineage reliably")
    key = id(sc)
    if key not in _LOCAL_CKPT:
        _LOCAL_CKPT[key] = tempfile.mkdtemp(prefix="kestrel-ckpt-")
        # this folder is the session's own: it goes when the JVM ends
        own = spark._jvm.org.apache.hadoop.fs.Path(_LOCAL_CKPT[key])
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    sc.setCheckpointDir(_LOCAL_CKPT[key])
    return _LOCAL_CKPT[key]


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint (never ``localCheckpoint``): the result survives
    executor loss and fixes partition contents and order for later jobs."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        return spark.sparkContext.defaultParallelism
