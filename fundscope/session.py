"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "fundscope") -> SparkSession:
    """Local session used by tests and ``bench.py``; on a cluster use the cluster's session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parallelism(spark: SparkSession) -> int:
    """The cluster's default parallelism (task slots)."""
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext
        v = str(spark.conf.get("spark.default.parallelism", "") or "")
        return int(v) if v.isdigit() else 8


def session_key(spark: SparkSession) -> tuple:
    """Identifies one live session (application + session object)."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001
        app = spark.conf.get("spark.app.id", None)
    return (app, id(spark))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Only when the setting is absent AND the master is
    local (tests) a fresh scratch folder is created and registered; on a
    cluster a missing setting is an error.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        pass
    if not path and sc is not None:
        path = sc.getCheckpointDir()
    if not path:
        master = sc.master if sc is not None else str(spark.conf.get("spark.master", ""))
        if not master.startswith("local"):
            # a machine-local folder is not visible to other executors: refuse
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        path = tempfile.mkdtemp(prefix="fundscope-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")
