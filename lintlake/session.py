"""A session with the settings that reviews rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: The JVM never compiles a method of more than 8,000 bytes: a stage whose code is longer runs expression by expression instead, in short methods.
WIDE = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def session(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("lintlake")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.variable.substitute": "false",  # sources are full of ${...}
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.maxPlanStringLength": "100000",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir (a local one only where none is set, on a local master)."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="lintlake-"))
    return context.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder: plans built on it stay small, and what it costs is paid once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
