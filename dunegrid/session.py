"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "dunegrid",
              shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes.

    AQE stays on so shuffle partition counts are sized at run time; the UI is
    off; the session time zone is UTC so timestamps compare the same way in
    every engine.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    used as is.  Only a local session without the setting (tests) gets a
    private temporary folder.  A cluster session without it is an error: a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dunegrid-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


#: Folders of this process's written intermediate tables.
_SCRATCH: list[str] = []


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written intermediate table, under the checkpoint dir."""
    base = checkpoint_dir(spark).rstrip("/")
    _SCRATCH.append(f"{base}/dunegrid-tables/{name}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def release_tables(spark: SparkSession) -> int:
    """Remove the intermediate tables this process has written so far; returns
    how many.  Call it when the results that read them are stored (DataFrames
    made from them cannot be computed again afterwards)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (for local helpers that need os paths)."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        while path.startswith("//"):
            path = path[1:]
    return os.path.abspath(path)


def materialize(df, name: str = "table"):
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, and the read-back plan carries
    statistics from the real file sizes (a checkpoint keeps the estimates of
    the plan it replaced, which compound across iterations of a loop).
    """
    spark = df.sparkSession
    path = scratch_table_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ensure_on_executors(spark) -> None:
    """Make ``dunegrid`` importable by the Python workers of this session.

    Arrow/pandas steps refer to functions of this package; when the package is
    not installed on the executors it is zipped once per SparkContext and
    shipped with ``addPyFile`` (Spark distributes it to every executor).
    """
    import zipfile

    if spark is None:
        return
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="dunegrid-pyfiles-")
    zpath = os.path.join(out_dir, "dunegrid.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
