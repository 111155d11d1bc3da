"""Shared plumbing of the training-data operators: the shared work folder, tables, Arrow group streams."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO_ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Only where the session names none and all runs on one machine (tests) is a temporary folder set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this application writes to."""
    return f"{shared_dir(spark)}/tessera-work/{spark.sparkContext.applicationId}"


#: Folders below work_dir() that are deleted when their step is over, the innermost last.
_scratch: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return "/".join([work_dir(spark), *_scratch, f"{name}-{uuid.uuid4().hex}"])


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_work(spark: SparkSession) -> None:
    """Deletes what this application has written between steps; call it once results are saved, as they read from there."""
    _delete(spark, work_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written in its block goes at its end; results must be written outside of it by then (see saved())."""
    _scratch.append(f"scratch-{uuid.uuid4().hex}")
    path = "/".join([work_dir(spark), *_scratch])
    try:
        yield
    finally:
        _scratch.pop()
        _delete(spark, path)


def saved(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What `make` gives, written to the shared folder, without the tables that it has left on its way."""
    path = work_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut in lineage that outlives any executor."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of ids (with a digest, some 50 bytes each) up to which a list is sent to all tasks.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, dropped: DataFrame, *keys: tuple[Column, str]) -> DataFrame:
    """The rows of docs that are not in `dropped`; keys pair a column of docs with the name of one of dropped.

    Nulls are equal. A short list is broadcast, so that texts stay where they are; a longer one is
    joined by shuffle.
    """
    dropped = materialize(dropped.select(*(name for _, name in keys)).toDF(*(f"_key{i}" for i in range(len(keys)))).distinct(), "dropped")
    few = dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.struct("*").alias("_row"), *(c.alias(f"_own{i}") for i, (c, _) in enumerate(keys)))
    same = [F.col(f"_own{i}").eqNullSafe(F.col(f"_key{i}")) for i in range(len(keys))]
    return rows.join(F.broadcast(dropped) if few else dropped, same, "left_anti").select("_row.*")


#: Rows of (key, few numbers) up to which a list of keys is broadcast, some 3 MB.
BROADCAST_KEYS = 100_000
#: A key that has more than this part of all rows is heavy, so that there are fewer heavy keys than that.
HEAVY = 1000


def to_keys(rows: DataFrame, info: DataFrame, key: str, weight: str) -> DataFrame:
    """rows joined with info by key; info is a written table with a row for each key, its `weight` the number of rows that have the key.

    Up to BROADCAST_KEYS keys are broadcast. Of more, the heavy ones, fewer than HEAVY whatever the
    size, are broadcast, and the others joined by shuffle, where no key has more than a HEAVY-th of
    all rows.
    """
    n, total = info.agg(F.count(F.lit(1)), F.sum(weight)).first()
    if n <= BROADCAST_KEYS:
        return rows.join(F.broadcast(info), key)
    heavy = F.col(weight) > total / HEAVY
    few = info.where(heavy)  # < HEAVY rows, as their weights add up to the total at most
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(info.where(~heavy), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


#: Rows of an Arrow batch: texts may be long, and a worker holds some copies of a batch.
BATCH_ROWS = 1000


def importable(spark: SparkSession) -> None:
    """Readies the session for Python workers: this package is importable where the driver runs from a
    source checkout, and Arrow batches have at most BATCH_ROWS rows."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *paths])


#: What empties the tables that a worker keeps between tasks, by the module that keeps them.
_TABLES: dict[str, list[Callable[[], None]]] = {}
_last_module = [""]


def kept_table(make: Callable) -> Callable:
    """Caches what `make` gives in the worker, until the worker runs a task of another module."""
    cached = lru_cache(make)
    _TABLES.setdefault(make.__module__, []).append(cached.cache_clear)
    return cached


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """`run` for mapInArrow, such that the worker, which outlives its tasks, keeps no memory that they have
    freed, and no tables of another module than that of its last task."""
    module = run.__module__

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        if _last_module[0] != module:
            for clear in _TABLES.get(_last_module[0], []):
                clear()
            _last_module[0] = module
            hand_back()
        yield from run(batches)
        hand_back()

    return task


def hand_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Contiguous runs of equal `key` in a sorted stream, across batch borders.

    Only the rows of the run at hand are held.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        if held and keys[0] != last:
            yield last, pa.Table.from_batches(held)
            held = []
        for i in range(1, len(keys)):
            if keys[i] != keys[i - 1]:
                yield keys[i - 1], pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, start = [], i
        held.append(batch.slice(start))
        last = keys[-1]
    if held:
        yield last, pa.Table.from_batches(held)
