"""What the operators share: columns, Python workers that give memory back, one kept state per worker, broadcast bounds."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointsmith.session import ship

#: Upper bound on what an operator broadcasts, in bytes; beyond it another way is taken.
MAX_BROADCAST_BYTES = 64 << 20
#: Rows of a batch to and from Python workers, where the session sets none.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names, whatever else docs has."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def release() -> None:
    """Give what a task has freed back to the machine; else a worker stays as large as its largest stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: memory stays with the worker
        pass


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows, unless the session says otherwise: whole texts make the default of 10,000 large."""
    if spark.conf.get(_BATCH, None) in (None, "10000"):
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f, giving memory back every few batches and at the end of the task."""

    def run(batches):
        for i, out in enumerate(f(batches)):
            yield out
            if i % 16 == 15:
                del out
                release()
        release()

    return run


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(tidy(f), schema)


def worker_state(key: object, build: Callable[[], object]) -> object:
    """A value built once in a Python worker and kept between its tasks, until a value of another key takes its place."""
    store = sys.modules.setdefault("_pointsmith_worker", types.ModuleType("_pointsmith_worker")).__dict__
    if store.get("key") != key:
        store.pop("value", None)
        release()
        store["value"], store["key"] = build(), key
    return store["value"]


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer file of this name is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
