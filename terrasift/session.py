"""What operators need of a session: the package on the executors, and a shared folder for what is reused."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="terrasift-")) / "terrasift.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, file.relative_to(home.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="terrasift-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/terrasift-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
