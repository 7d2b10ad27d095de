"""Shared folder, staged tables and small column helpers of the document operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of the contracts: runs without the six ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a session without the setting on a local master, as in tests, gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a shared folder, as seen from any task."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def few_rows(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded by rows that suit long texts rather than numbers.

    A batch of Spark's 10,000 rows may hold a gigabyte of text; a smaller value that the session has is kept.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def text_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; a null is the empty text."""
    return [value or "" for value in batch.column(column).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task builds for one batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def words(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column; a null text has none."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+")
    return F.filter(parts, lambda word: word != "")
