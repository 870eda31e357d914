"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Paths of the intermediate tables made so far, in order.
_MADE: list[str] = []

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Runtime settings that every job of this package relies on. Partition counts
# are left to the cluster: AQE coalesces small shuffles and splits skewed ones.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "lexcorpus", cores: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # no Python stack trace per column call: the expressions here are large
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine; on a
    cluster an unset folder is an error, since lost executors could not be
    replaced from machine-local files.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running this job")
    folder = tempfile.mkdtemp(prefix="lexcorpus-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """Folder of this application below the shared one; everything it writes on the way lies there."""
    return f"{scratch_dir(spark)}/lexcorpus/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """New, unused path in the folder of this application."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application, after its results are written."""
    _delete(spark, run_folder(spark))


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; write results before it."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            _delete(spark, path)
        del _MADE[before:]


def materialize(df: DataFrame, name: str = "table", folders: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with ``folders`` one per value of that column, and read it back.

    This cuts the lineage (nothing upstream is computed twice, and a lost
    executor costs no recomputation) and gives Catalyst the true size of the
    table, so a join against it is broadcast only when it really is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _MADE.append(path)
    writer = df.write if folders is None else df.write.partitionBy(folders)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
