"""Sessions: a local one for tests and benches, and shipping this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, once per application.

    Skipped where workers find it anyway: the repository is on PYTHONPATH.
    """
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or str(ROOT) in on_path:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="weftline-"), "weftline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "weftline").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


@lru_cache(1)
def _own_shared() -> str:
    path = tempfile.mkdtemp(prefix="weftline-shared-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where a session on a single machine names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (path or _own_shared()).rstrip("/")


def local(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("weftline")
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
