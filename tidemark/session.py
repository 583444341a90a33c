"""Session settings that all queries share."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(master: str = "local[8]", *, shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; Python workers find this package."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *os.environ.get("PYTHONPATH", "").split(os.pathsep)]))
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf,
    }
    spark = SparkSession.builder.master(master).appName("tidemark").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to executors that do not have it, as a zip file; call it once on a cluster."""
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark"), "zip", ROOT, "tidemark")
    spark.sparkContext.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; in local mode a new one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
