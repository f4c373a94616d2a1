"""Session settings used by tests, the benchmark and the entry point."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "changelens", cores: int | str = "*") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("CHANGELENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        spark = spark.config(key, value)
    session = spark.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once for each context, so that their Python can import it from any folder."""
    context = spark.sparkContext
    if getattr(context, "changelens_zip", None) is None:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        root = os.path.dirname(package)
        context.changelens_zip = os.path.join(tempfile.mkdtemp(prefix="changelens-"), "changelens.zip")
        with zipfile.ZipFile(context.changelens_zip, "w") as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
        context.addPyFile(context.changelens_zip)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one, kept for the context, only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "changelens_folder", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = context.changelens_folder = "file://" + tempfile.mkdtemp(prefix="changelens-")
    context.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write a reduced result to the checkpoint folder when several steps read it.

    The scan behind it then runs once, and a lost executor costs no recomputation.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
