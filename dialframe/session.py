"""Session helpers: a local session for tests and the bench, checkpoint dir resolution."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small shuffles still feed CPU-heavy stages (regex, windows): keep them spread over the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # ANSI is the Spark 4 default; keep it explicit because the operators rely on it.
    "spark.sql.ansi.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "dialframe",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench.  Cluster jobs build their own session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(_DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("DIALFRAME_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's ``spark.checkpoint.dir``; set a scratch one only when it is unset.

    On a cluster the setting names a shared folder and is respected as is.  Only a
    local session without the setting (tests, bench) gets a fresh scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: the server owns the checkpoint dir
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        # A machine-local folder would lose checkpoints with the executor that wrote them.
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS, object store) "
                           "for the checkpointed stages")
    path = tempfile.mkdtemp(prefix="dialframe-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def num_partitions(df, default: int = 1) -> int:
    """Planned partition count of ``df`` (no job); ``default`` where it cannot be asked."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:
        return default


def default_parallelism(spark: SparkSession, default: int = 8) -> int:
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:
        return default


def materialize(df, name: str):
    """Write ``df`` once as Parquet under the checkpoint dir and return a reader of it.

    Cuts the lineage like ``checkpoint()`` but in one job (a reliable RDD
    checkpoint computes its input twice), and later readers prune columns.  The
    folder is deleted when the application ends (:func:`release_materialized`
    deletes earlier); a result read after that must have been written elsewhere.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if not base:  # no SparkContext (Spark Connect): let the server checkpoint
        return df.checkpoint(eager=True)
    path = f"{base.rstrip('/')}/dialframe-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, deleted when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/dialframe-{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path) of ``path`` through Hadoop, which qualifies relative names."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hp


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Hadoop deletes the folder when the driver's JVM ends (stopped, failed or killed by a signal)."""
    fs, hp = file_system(spark, path)
    fs.deleteOnExit(hp)


def release_materialized(df) -> None:
    """Delete the folders of :func:`materialize` that ``df`` reads, once its result is no longer needed."""
    spark = df.sparkSession
    for folder in sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}):
        if "/dialframe-" in folder:
            fs, hp = file_system(spark, folder)
            fs.delete(hp, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``dialframe`` importable by the Python workers (once per application).

    Python UDFs and ``mapInPandas`` functions are pickled by reference to their
    module; the package is zipped and added with ``addPyFile`` (Spark's own file
    distribution, as ``--py-files`` does), unless the workers can import it already.
    """
    import zipfile

    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # Spark Connect: ship as an artifact
        sc, app = None, "connect"
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="dialframe-pkg-", suffix=".zip", dir="/tmp")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
