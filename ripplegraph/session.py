"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ripplegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC timestamps and the web page off.

    The shuffle partition count is left to the cluster: adaptive execution merges small ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _shipped(application: str) -> None:
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{__package__}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((root / __package__).rglob("*.py")):
            archive.write(path, path.relative_to(root))
    SparkSession.active().sparkContext.addPyFile(str(target))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, where it need not be installed; once per application."""
    _shipped(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"ripplegraph-{application}-")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for stored stages and scratch tables.

    It is the one named by ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own, since a machine-local folder is of no use to other executors.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is not None:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_folder(context.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table below the shared scratch folder and go on from the stored rows.

    Later steps neither repeat the work before nor lose it with an executor, and read only the columns they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
