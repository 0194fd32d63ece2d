"""Session defaults, code shipping, table loading and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("marginalia")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package's code to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="marginalia-code-")) / "marginalia.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f"{_PACKAGE.name}/{f.relative_to(_PACKAGE)}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a scan has fewer splits than half the cores (small files only; large inputs keep their splits and are not shuffled).

    For scans, projections and filters: asking a plan with a shuffle for its partitions would run that shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session (tests) gets a folder of its own where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="marginalia-checkpoint-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
