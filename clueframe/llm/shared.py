"""Where operators keep what outlives a job: the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where unset and the master is local, as in tests, a folder of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clueframe-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/clueframe/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_batches(spark: SparkSession, size: int = 8 << 20, rows: int | None = None):
    """Within, jobs give Python batches of about ``size`` bytes, and of ``rows`` rows at most."""
    want = {"spark.sql.execution.arrow.maxBytesPerBatch": size} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": rows} if rows else {})
    old = {k: spark.conf.get(k) for k in want}
    for k, x in want.items():
        spark.conf.set(k, str(x))
    try:
        yield
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


_scopes = threading.local()


@contextmanager
def passing(spark: SparkSession):
    """Within, stored tables are for the time being: they are deleted at the end, but for those stored with ``keep``.

    What is kept belongs to the scope around this one, if there is any.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for path in stack.pop():
            drop(spark, path)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read from there: lineage ends here.

    ``keep``: the result of an operator reads it after the operator has returned.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    stack = _scopes.__dict__.get("stack", [])
    if keep:
        stack = stack[:-1]
    if stack:
        stack[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove what no later read needs."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Bytes that a side may hold to be broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, width: int = 16) -> DataFrame:
    """``df``, marked for broadcast if its rows, of about ``width`` bytes, are few enough."""
    rows = BROADCAST_BYTES // width
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Most keys that ``spread`` broadcasts.
HOT_KEYS = 100_000


def hot_rows(total: int) -> int:
    """Rows beyond which a key is hot: of ``total`` rows at most ``HOT_KEYS`` keys can have more."""
    return max(512, -(-total // HOT_KEYS))


def spread(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table``, a row for each key, by a key that many rows may share.

    ``count`` is the table's column of the number of rows with that key, and ``total`` is no less than their sum.  Hot
    keys, whose number has a bound, are broadcast, so that their rows stay where they are; all others are shuffled.
    """
    hot = hot_rows(total)
    heavy = F.broadcast(table.where(F.col(count) > hot))
    rest = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col(count) <= hot), key)
    return rows.join(heavy, key).unionByName(rest)


def local(path: str) -> str | None:
    """The path in the file system, where the shared folder is one that open() reaches."""
    parts = urlparse(path)
    return parts.path if parts.scheme in ("", "file") else None


def put(path: str, data) -> None:
    """Write a file whole or not at all; a task tried again writes the same one."""
    at = local(path)
    if at is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        half = f"{at}.{uuid.uuid4().hex}"
        with open(half, "wb") as out:
            for x in data:
                out.write(x)
        os.replace(half, at)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    half = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(half) as out:
        for x in data:
            out.write(memoryview(x).cast("B"))
    store.move(half, at)


_held: dict[str, np.ndarray] = {}
_HELD_BYTES = 256 << 20


def array(path: str, kind, keep: bool = True) -> np.ndarray:
    """A file's numbers: mapped where open() reaches the shared folder, else read, with a bound on what is kept."""
    if not keep:
        at = local(path)
        if at is not None:
            return np.fromfile(at, kind)
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(path)
        with store.open_input_file(there) as source:
            return np.frombuffer(source.read(), kind)
    if path in _held:
        return _held[path]
    at = local(path)
    if at is not None:
        if len(_held) > 4096:
            _held.clear()
        _held[path] = np.memmap(at, dtype=kind, mode="r")
        return _held[path]
    from pyarrow import fs

    store, there = fs.FileSystem.from_uri(path)
    with store.open_input_file(there) as source:
        data = np.frombuffer(source.read(), kind)
    if sum(x.nbytes for x in _held.values()) + data.nbytes > _HELD_BYTES:
        _held.clear()
    _held[path] = data
    return data


def give_back() -> None:
    """Return free memory of this process to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def lean(run):
    """A mapInArrow function that gives its memory back at the end of a task: workers are used again by later stages."""

    def lean_run(batches):
        yield from run(batches)
        give_back()

    return lean_run
