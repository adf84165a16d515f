"""Sessions: one with sensible defaults for tests and benches, and code shipping for any other."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def get_spark(master: str = "local[8]", partitions: int = 8, memory: str = "8g", app: str = "millrace", **more) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each context.

    Needed where they don't share the driver's PYTHONPATH; the archive travels through
    Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_millrace_shipped", False):
        return
    where = Path(tempfile.mkdtemp(prefix="millrace-code-")) / "millrace_code.zip"
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT.parent)))
    sc.addPyFile(str(where))
    sc._millrace_shipped = True
