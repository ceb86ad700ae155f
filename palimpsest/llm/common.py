"""Shared helpers: where intermediate tables go, and access to files in that folder from the executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Bytes of Arrow data handed to Python at a time, whatever the number of rows.
ARROW_BATCH_BYTES = 4 << 20
ARROW_BATCH_ROWS = 2000

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary one, in local mode only: there the driver is the executor."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="palimpsest-")
            spark.sparkContext.setCheckpointDir(root)
        _roots[app] = root.rstrip("/")
        atexit.register(sweep, f"{_roots[app]}/palimpsest/{app}")
    return _roots[app]


def sweep(folder: str) -> None:
    """Delete what an application has written for its own use, when it ends. Results that are to stay are written elsewhere by the caller."""
    with contextlib.suppress(Exception):  # the file system may be gone by then
        fs, at = filesystem(folder)
        fs.delete_dir(at)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for one table or set of files."""
    return f"{shared_root(spark)}/palimpsest/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more: what was made of them has been written itself."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t._scratch_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts cannot add up to more than a worker's memory. Holds for the rest of the session: plans that are run later read the settings then."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH_BYTES)


def tidy(run):
    """run, a function of batches, after which its worker process returns the memory that it no longer uses: it lives on, beside other tasks."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system and the path in it, for any scheme that pyarrow knows."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:/", "file:///", 1))


def put_file(path: str, chunks) -> int:
    """Write chunks of bytes to path through a name of its own, so that a task that is run twice leaves whole files only."""
    fs, at = filesystem(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.{uuid.uuid4().hex}.tmp"
    size = 0
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(part, at)
    return size


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, columns[f.name]) for f in schema)], schema=schema)
