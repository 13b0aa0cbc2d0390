"""Reading tables, the shared folder, and whole texts in Arrow batches."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; where it is unset, as in tests, a temporary one,
    which only a local master shares."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="sheaf-"))
        at = _fallback[0]
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/sheaf-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session has ended before
        pass


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again: later jobs neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


#: Rows of a few longs in a file of a narrow table.
FILE_ROWS = 1 << 20


def files_for(spark: SparkSession, rows: int) -> int:
    """Files for up to so many rows of a few longs: one a core at least. With the local file system Hadoop starts three
    processes (chmod) for each file that an executor writes, and each first is a copy of the executor."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / FILE_ROWS))


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once no plan that may still run reads it."""
    _delete(df.sparkSession, df._written_at)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id and text, a null text as the empty one. No other column of docs is read, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; that of the empty text for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


_held: dict[str, Callable[[], None]] = {}


def holding(operator: str, release: Callable[[], None] | None = None) -> None:
    """Says whose turn it is in this worker process, which lives on from task to task: what another operator keeps goes, and
    `release` lets go what this one will keep."""
    for other in [k for k in _held if k != operator]:
        _held.pop(other)()
    if release:
        _held[operator] = release


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `limit` bytes of text (or one row that is longer): bounds what is held beside a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()  # workers live on; what they keep counts against their executor


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Per document the number of runs between white space, all runs as codes, and the runs that the codes stand for."""
    trimmed = pc.utf8_trim_whitespace(column.cast(pa.large_string()))
    runs = pc.utf8_split_whitespace(trimmed)
    offsets = np.asarray(runs.offsets, dtype=np.int64)
    found = runs.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    counts, codes = np.diff(offsets), np.asarray(found.indices, dtype=np.int64)
    blank = np.asarray(pc.equal(pc.binary_length(trimmed), 0))
    if blank.any():  # a blank text is split into one empty run
        codes, counts = codes[~np.repeat(blank, counts)], np.where(blank, 0, counts)
    return counts, codes, found.dictionary.to_pylist()
