"""Session settings, checkpoints and table loading shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; all can be changed at run time, so a session handed in by a caller gets them too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts can be long: small Arrow batches keep a Python worker's memory flat
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    # in the folder that the cluster shares, if the driver can write there; else the driver serves its own copy
    shared = (context.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://").removeprefix("file:")
    try:
        if not shared.startswith("/"):
            raise OSError("no file system")
        folder = Path(shared) / f"code-{uuid.uuid4().hex}"
        folder.mkdir(parents=True)
    except OSError:
        folder = Path(tempfile.mkdtemp(prefix="gleanery-code-"))
    archive = folder / "gleanery.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))  # Spark serves the file to every executor
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_CONF to a session that somebody else built and give its workers this package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanery")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GLEANERY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, shared by all executors; where the cluster names none, only a local session gets one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gleanery-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint.

    The folder is the one named in ``spark.checkpoint.dir`` (shared by all executors, so the job survives the
    loss of any of them). Only where that is unset in a local session, as in tests, a temporary folder is used.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors can reach, beside the checkpoints."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
