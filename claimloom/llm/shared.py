"""Folders, written tables and files that the driver and all executors see.

Intermediate results are cut from their lineage by writing them below the folder in
``spark.checkpoint.dir``; nothing is kept on a machine's own disk. Without that setting only a local master works.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space everywhere in this package (fixed values).
WHITE = " \t\n\x0b\x0c\r"
#: The same as a regular expression class.
WHITE_CLASS = r"[\x20\x09-\x0D]"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's full URI below the cluster's shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own(spark)
    if "://" not in root:  # a plain path means Spark's default file system, for the files that tasks write, too
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        root = found if "://" in found else "file://" + found.removeprefix("file:")
    return f"{root.rstrip('/')}/claimloom/{name}-{uuid.uuid4().hex}"


_own_root: list[str] = []


def _own(spark: SparkSession) -> str:
    """A folder of this process, only for a local master: executors elsewhere wouldn't see it."""
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="claimloom-"))
    return _own_root[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a restart point that survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a plain local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def text_column(name: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with underscores added until no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, column: str = "text", most: int = 8 << 20):
    """Cut Arrow batches so that the text of each slice stays near ``most`` bytes; one long text is a slice of its own."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if len(sizes) > start:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
