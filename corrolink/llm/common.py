"""Pieces that the corpus operators share: tables, scratch tables, hashing, heavy keys."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Rows of an Arrow batch; documents may be long, so a batch stays small.
BATCH_ROWS = 512
#: Bytes of a batch that an operator works on at once.
TEXT_BYTES = 1 << 20
#: Tables of up to so many bytes may be broadcast.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table of that name, through Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of no more rows than BATCH_ROWS, so that long texts do not fill a Python worker; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine (tests)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        else:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="corrolink-")
            atexit.register(shutil.rmtree, found, True)
            sc.setCheckpointDir(found)
    return found.rstrip("/")


_made: list[str] = []  # the scratch paths of this process, in their order


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    _made.append(f"{shared_dir(spark)}/corrolink/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its counted bytes are few enough; else joins shuffle it."""
    text = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    size = df.agg(F.sum(sum(text, F.lit(32)))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def deleted(spark: SparkSession, path: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(sc._jsc.hadoopConfiguration()).delete(found, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this engine in the shared folder (call once results are stored)."""
    deleted(spark, f"{shared_dir(spark)}/corrolink")


def stored(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """The table that `make` gives, written; the scratch tables that it needed are deleted."""
    before = len(_made)
    out = written(make(), what)
    for path in _made[before:-1]:
        deleted(spark, path)
    _made[before:] = _made[-1:]
    return out


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL text; on the driver only."""
    return to_arrow_schema(_parse_datatype_string(schema))


def by_bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes: small batches are joined, large ones cut; a longer row stands alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        if rows < batch.num_rows and batch.nbytes > size:
            sizes = _row_bytes(batch)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // size, prepend=0)).tolist()
            parts = [batch.slice(a, b - a) for a, b in itertools.pairwise([0, *cuts, batch.num_rows]) if b > a]
        else:
            parts = [batch]
        for part in parts:
            held.append(part)
            if sum(p.nbytes for p in held) >= size:
                yield _joined(held)
                held = []
    if held:
        yield _joined(held)


def _row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    out = np.full(batch.num_rows, 8, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            out += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            out += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return out


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def give_back(collect: bool = True) -> None:
    """Return freed memory to the system, so that a worker that waits for its next task holds little."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mapped(df: DataFrame, fn, schema: str, size: int = TEXT_BYTES, per_task: bool = False) -> DataFrame:
    """mapInArrow over batches of about `size` bytes: fn gets a RecordBatch and gives a dict of columns or None.

    With per_task, fn is called once in each task and gives the function of its batches, which may keep state.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fn() if per_task else fn
        try:
            for k, batch in enumerate(by_bytes(batches, size)):
                out = own(batch)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)
                del batch, out
                if k % 8 == 7:
                    give_back(collect=False)
        finally:
            del own
            give_back()

    return df.mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array a row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def id_text(col: str | Column) -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))
