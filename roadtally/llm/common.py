"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, by every contract here: a run of characters other than space and the five ASCII controls.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on one machine, where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="roadtally-"))
            folder = spark.sparkContext.getCheckpointDir()
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read again: later jobs neither recompute it nor depend on a live executor."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SPACE = re.compile(r"[ \t-\r]")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8: bytes.split() parts at exactly the six characters of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join("/opt/tokenizers", name)
