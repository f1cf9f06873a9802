"""What the corpus operators share: the documents table, shared scratch tables, text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words and the characters stripped from line keys.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_scratch: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one of its own only where that is unset in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
    return _own_scratch[app]


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there and any executor can read it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidewheel/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # noqa: SLF001  remembered for discard()
    return out


def discard_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing lazy refers to any more."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            discard_path(t.sparkSession, path)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII texts take the fast built-in, which does the same there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def body(text: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
