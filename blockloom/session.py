"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "blockloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator assumes: UTC clocks and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediates that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master, as in tests, may go without the setting and gets a scratch folder, which the session then keeps.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        folder = tempfile.mkdtemp(prefix="blockloom-work-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as compressed columns to the shared folder and read it back, for tables that several steps read parts of."""
    path = f"{work_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session's shuffles have, for steps that hold much of each row in memory.

    Adaptive execution makes tasks of plain shuffles larger as tables grow, up to its advised size of compressed bytes; it leaves the number given here.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
