"""Session construction and shared cluster settings.

Everything that runs on a cluster reads its settings from the session it is
given; the defaults here only apply when a test or a local run builds its own
session.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings a local run gets when it builds its own session.  On a cluster the
# session is built by the platform and none of these are forced.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast only sides the planner has measured below this bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "critica", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    A driver that found the package through its own ``sys.path`` (or from a
    working folder that executors do not share) has workers that cannot
    import it.  Spark's own file distribution carries a zip of the sources.
    """
    app = spark.conf.get("spark.app.id", None) or str(id(spark))
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="critica-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("critica", os.path.relpath(full, root)))
    spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as given.  Only a ``local`` master with nothing set (a test) gets a fresh
    scratch folder; anywhere else a machine-local folder would be lost with
    its machine, so a missing setting is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no driver-side context (e.g. Spark Connect): the conf names the folder
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="critica-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_FOLDERS: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """The application's own folder below the checkpoint folder; it goes when the driver ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    app = spark.conf.get("spark.app.id", None) or uuid.uuid4().hex
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{base}/critica-{app}"
        jvm = getattr(spark, "_jvm", None)
        if jvm is not None:  # a driver of its own, not a remote client
            path = jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return _FOLDERS[app]


def cut_lineage(df):
    """``df``, written once as Parquet to the shared checkpoint folder and reread.

    Iterative loops call this every round so that a lost executor never
    forces a recomputation of all earlier rounds.  A Dataset checkpoint
    would carry the size estimate of its plan along: where a round joins a
    table with itself the estimates multiply, and after a few rounds the
    planner does arithmetic on numbers of millions of digits.  Files have
    their real size, so small tables of late rounds are broadcast as well.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/step-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "lz4").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pieces(df, bytes_per_piece: int) -> int:
    """Number of partitions (2 at least) for the files that ``cut_lineage`` reads, by their size."""
    try:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # no planner access (e.g. Spark Connect): the session's number
        return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(2, -(-size // bytes_per_piece))
