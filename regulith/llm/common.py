"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the size contract counts it: blank, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str | Column = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; where that is unset, a
    temporary folder is used in local mode, and elsewhere it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="regulith-"))
    return df.checkpoint()


def crc_fold(c: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(3))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's ``spark.checkpoint.dir`` (a temporary one in local mode where that is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return f"{(base or tempfile.mkdtemp(prefix='regulith-')).rstrip('/')}/llm-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
