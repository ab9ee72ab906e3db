"""Session settings shared by tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "talkweave") -> SparkSession:
    """A local session with the settings that the queries are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir. A local session that names none gets a local one; a cluster must name one."""
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not own and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(own or tempfile.mkdtemp(prefix='talkweave-')).rstrip('/')}/talkweave/{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for a context, unless their path has it already."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_talkweave_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="talkweave-")) / "talkweave.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "talkweave").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._talkweave_shipped = True
