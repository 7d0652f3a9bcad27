"""Session, table loading and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, SparkSession] = {}


def build_session(app: str = "shelfspark", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library relies on (UTC, AQE)."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, besides their own path."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, home])


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local master may fall back to a temporary folder."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        return os.path.join(tempfile.gettempdir(), "shelfspark-checkpoints")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, name: str = "table") -> str:
    """A new path below the shared folder; all of an application go when its driver ends."""
    root = f"{shared_folder(spark)}/shelfspark-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    local = path.removeprefix("file://").removeprefix("file:")
    if local.startswith("/"):
        shutil.rmtree(local, ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for root, spark in _ROOTS.items():
        try:
            _remove(spark, root)
        except Exception:  # the connection to the cluster may be gone at exit
            continue


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in reliable shared storage and return a frame that reads it.

    Cuts the lineage of iterative operators. A lost executor costs nothing that was written before. Being columnar, the table is read by column,
    and a join with it is one that AQE can split where a key is hot.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`materialize` that nothing refers to any more."""
    for table in tables:
        if path := getattr(table, "_scratch", None):
            _remove(table.sparkSession, path)
