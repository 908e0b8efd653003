"""What the corpus operators share: table access, row keys, shared folders, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal column names; an input column of the same name is never read by accident.
ID, TEXT, KEY = "__id", "__text", "__key"
SYMBOLS = "#*$%&|<>"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: a cluster needs a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "confluo")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root


#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit of a batch that goes to Python, of which the executor holds some copies; rows of texts and packed rows are large.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def settings(spark: SparkSession, own: dict[str, str]) -> Iterator[None]:
    """The session's settings are these inside, and what they were before afterwards."""
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; survives lost executors. What was shuffled for it goes at once."""
    spark = df.sparkSession
    checkpoint_root(spark)
    with settings(spark, {CLEANUP: "true", BATCH: str(BATCH_BYTES)}):
        return df.select("*").checkpoint(eager=True)


def shared_table(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that is written and read back."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """Only the id, the text and the named extra columns, under internal names for the first two."""
    return docs.select(docs[id_col].alias(ID), docs[text_col].alias(TEXT), *[docs[c] for c in extra])


def row_key(id_col: Column, text_col: Column) -> Column:
    """64 bits over id and text: tells rows with one id but different texts apart; equal rows share it."""
    return F.xxhash64(id_col, F.lit("\x00"), text_col)


def text_bytes(df: DataFrame, text: str = TEXT) -> int:
    """Bytes of text in the whole table (one narrow scan)."""
    return int(df.select(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0])


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def cyclic_parts(spark: SparkSession, total_bytes: int, per_part: int) -> int:
    """Partitions for so many bytes, not below the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // per_part), 1)


#: What a worker process keeps between tasks of one stage, until another stage's function releases it.
KEPT: dict = {}


def release() -> None:
    """Give memory back to the system: a worker process lives on between stages, and so would its largest size."""
    KEPT.clear()
    gc.collect()  # a memo and what it asks hold each other
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what Python makes of a batch is never made of a whole one."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class Memo(dict):
    """A bounded memo: asks ``make`` for what it lacks. When full, it keeps its content as the older half, from which
    what is asked for again comes back, so it never holds more than twice ``bound``."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.older = make, bound, {}

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
