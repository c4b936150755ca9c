"""Session settings and the shipping of this package to Python workers."""

from __future__ import annotations

import importlib.util
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent

#: Runtime settings the engine is developed with. Nothing relies on them for right results.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.files.ignoreCorruptFiles": "false",
}


def session(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the engine's settings; master and resources come from the caller or spark-submit."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers through Spark's file server, once in each application.

    Workers that have the package on their path already keep using that one.
    """
    done = f"tessera.shipped.{spark.sparkContext.applicationId}"
    if spark.conf.get(done, None) or importlib.util.find_spec("tessera") is None:
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(_ROOT.rglob("*.py")):
            out.write(file, f"tessera/{file.relative_to(_ROOT)}")
    spark.sparkContext.addPyFile(str(path))
    spark.conf.set(done, "yes")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a temporary folder serves a local master; on a cluster each executor would
    write to its own disk and later reads would miss rows, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tessera.scratch", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.scratch", path)
    return path.rstrip("/")
