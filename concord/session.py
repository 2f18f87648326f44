"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the package to Python workers that have no other way to import it, once per application."""
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(ROOT.parent) not in paths and context.applicationId not in SHIPPED:
        target = Path(tempfile.mkdtemp(prefix="concord-")) / "concord_package.zip"
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(ROOT.rglob("*.py")):
                z.write(path, path.relative_to(ROOT.parent))
        context.addPyFile(str(target))
        SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or for local runs a fresh temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="concord-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that lost executors cost nothing that was done before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame, key: str, each: int = 5000) -> DataFrame:
    """rows dealt to tasks by key, about `each` to a task: a small file is one split, and its rows may become large pages."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each)), key)


def local_session(cores: int | str = "*", name: str = "concord", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.maxMetadataStringLength": "2000",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())
