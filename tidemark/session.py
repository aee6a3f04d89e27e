"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "tidemark", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_ready(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says (``spark.checkpoint.dir``). A session on one machine, as in tests, gets a
    temporary folder where that isn't set; on a cluster executors don't share such a folder, so it is an error there."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder; it survives lost executors."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """As ``cut``, but as a compressed table of which readers take only their columns; for what has many rows or columns.
    It stays in the checkpoint folder of the application."""
    path = shared_folder(df.sparkSession, name, fresh=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, so that queries run
    where only the driver has it on its path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    # Executors may ask the driver for the file at any time, so it stays until the driver ends.
    tmp = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, tmp, ignore_errors=True)
    path = Path(tmp, "tidemark_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession, name: str, fresh: bool = False) -> str:
    """A path below the checkpoint folder that all executors share; with ``fresh`` one that nothing has used."""
    checkpoint_ready(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}" if fresh else f"{root}/{name}"
