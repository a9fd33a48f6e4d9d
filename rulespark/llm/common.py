"""What the operators of this subpackage share: inputs, checkpoints, held-out rows."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which the cluster names in ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in one process (tests), a temporary folder
    is used; a cluster without the setting is an error, as its machines share
    no temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


#: The tables made since ``scratch_tables`` was entered.
_SCRATCH: ContextVar[list[DataFrame] | None] = ContextVar("scratch", default=None)


def shared_checkpoint(df: DataFrame, scratch: bool = True) -> DataFrame:
    """Cut the lineage: written once as a table in the shared folder, and read back from there.

    Unlike ``df.checkpoint()`` this computes the rows once, keeps them in columns
    and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if scratch and (made := _SCRATCH.get()) is not None:
        made.append(out)
    return out


@contextmanager
def scratch_tables() -> Iterator[None]:
    """At the end, delete the tables that were made within (but for those made with ``scratch=False``)."""
    made: list[DataFrame] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for out in made:
            drop_shared(out)


def drop_shared(df: DataFrame) -> None:
    """Delete the files of a table that ``shared_checkpoint`` made and nothing reads any more."""
    spark = df.sparkSession
    paths = {name.rpartition("/")[0] for name in df.inputFiles()}
    for folder in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that go to a Python worker at a time: long texts then need no large buffers on either side.
BATCH_BYTES = 1 << 20


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release_memory() -> None:
    """Give freed memory back to the system; a worker keeps it otherwise, and a machine has many idle workers."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES (set for the session), after which a worker holds no freed memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def id_remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % F.lit(modulus)).cast("int")


#: Rows of a narrow table (an id and a few numbers) that may be broadcast.
BROADCAST_ROWS = 1_000_000


def join_narrow(left: DataFrame, right: DataFrame, on: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow table: broadcast if it has ``most`` rows or fewer, else shuffled on the key."""
    few = right.select(F.lit(1)).limit(most + 1).count() <= most
    return left.join(F.broadcast(right) if few else right, on, how)


def labelled(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) for the ids that have a label; of several labels of an id the largest counts."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))


def hash_rank(id_col: str, seed: int) -> Column:
    """A number below HASHES that a hash of the id gives."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(HASHES))


#: Values of ``hash_rank``.
HASHES = 1 << 40


def first_by_hash(df: DataFrame, most: int, id_col: str = "id") -> DataFrame:
    """At most ``most`` rows, chosen by a hash of the id: the same ones on any cluster.

    Of a large table only the rows whose hash is low enough to count are
    sorted: about four times as many as are kept, however many tasks there are.
    """
    rank = hash_rank(id_col, 17)
    rows = df.count()
    if rows > 4 * most:
        df = df.where(rank < F.lit(HASHES * 4 * most // rows))
    return df.orderBy(rank, id_col).limit(most)
