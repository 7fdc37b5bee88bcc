"""Session construction and the two settings every job here relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Only for local runs and tests; a cluster keeps its own values.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "12g", app: str = "tidemark") -> SparkSession:
    """A local[cores] session with small shuffle partitions, in UTC."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per context, wherever they run and start.

    The driver packs it into an archive and Spark serves that to the executors, so they need neither a
    shared path nor a PYTHONPATH. A package that was itself shipped as an archive is left as it is.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_tidemark_shipped", False) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    context._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests, local runs) a folder under the temporary directory is set, which is
    only right because driver and executors are then one machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context_dir = spark.sparkContext.getCheckpointDir()
        found = context_dir or tempfile.mkdtemp(prefix="tidemark-")
        if not spark.sparkContext.master.startswith("local") and not context_dir:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut_lineage(df):
    """Materialise ``df`` once in the shared folder; survives the loss of executors.

    Used where a derived table feeds several later stages and computing it twice would cost more.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bench_cores() -> int:
    return int(os.environ.get("BENCH_CPUS", "8"))
