"""What the operators of this subpackage share: the cluster's shared folder, tables in it, files in it.

Everything that must outlive a stage goes to the folder named by ``spark.checkpoint.dir``. It may be on any
store that Spark and ``pyarrow.fs`` both reach (a shared mount, HDFS, an object store).
"""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset a local one is made and set, but only for a local master: on a cluster
    other machines wouldn't see it, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()  # a path without a scheme is on the default store
    return re.sub("^file:/(?!//)", "file:///", full).rstrip("/")


def new_dir(spark: SparkSession, tag: str) -> str:
    """A name for a new folder in the shared one."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: What open scratch scopes have stored, the innermost last.
_SCOPES: list[list[DataFrame]] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage, and is computed once. It stays there until it is
    discarded, or the scratch scope that it was stored in ends."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote; nothing that still reads it may run afterwards."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What is stored inside is deleted at the end; what is to stay is taken out of the list."""
    mine: list[DataFrame] = []
    _SCOPES.append(mine)
    try:
        yield mine
    finally:
        _SCOPES.pop()  # scopes nest
        discard(*mine)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that holds ``uri`` and the path in it; for use inside tasks."""
    return pafs.FileSystem.from_uri(uri)


def write_bytes(uri: str, chunks) -> int:
    """Writes ``chunks`` to a file beside ``uri`` and then renames it, so that a lost task leaves no torn file; returns the bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(tmp) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(tmp, path)
    return size


#: Rows of texts that a task exchanges with Python at once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` itself; from now on its session hands texts to Python in batches of ``BATCH_ROWS`` rows at most, as they may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` in one struct: what is carried so can't clash with an operator's own columns."""
    return F.struct(*["`" + c.replace("`", "``") + "`" for c in df.columns]).alias(name)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with more fields."""
    return T.StructType(df.schema.fields + [T.StructField(k, T.StructType.fromDDL(f"{k} {v}")[k].dataType) for k, v in kinds.items()])
