"""Scan settings and session helpers."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ScanConfig:
    """Weights and thresholds of a scan. The defaults are fixed values of the scoring model."""

    # injection score = 100 * weighted sum of the four signals
    pattern_weight: float = 0.45
    model_weight: float = 0.35
    embedding_weight: float = 0.10
    anomaly_weight: float = 0.10

    # safety score = weighted sum of the four component scores
    extraction_weight: float = 0.15
    detection_weight: float = 0.45
    drift_weight: float = 0.20
    metadata_weight: float = 0.20

    # injection-score bands and the guard threshold
    critical_from: float = 80.0
    high_from: float = 60.0
    medium_from: float = 40.0
    guard_from: float = 30.0

    # safety-score bands
    pass_from: float = 80.0
    warn_from: float = 50.0

    # presentation
    raw_text_limit: int = 1000
    ocr_text_limit: int = 500
    audit_text_limit: int = 200
    service_name: str = "the content guard"

    # also score the alt texts and comments of HTML pages, which do not count otherwise
    score_hidden: bool = False


DEFAULT = ScanConfig()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("thornwall")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local does this fall back to a temporary folder of the machine.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="thornwall-")
    return f"{base.rstrip('/')}/thornwall-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table in a new shared folder: what is below is computed once, lost executors or not."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
