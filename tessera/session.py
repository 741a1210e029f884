"""Sessions: one for local work, and the library shipped to the executors of any other."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once an application, so that they can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark
