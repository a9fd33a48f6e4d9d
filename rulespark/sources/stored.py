"""Tables that several plans read again: written once, in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast; longer ones are merged by key.
SHORT_TABLE = 20_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where it is unset and Spark runs in one process, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table: computed once, read back by column, safe from the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is merged by key, never sent to the driver.

    The files of a stored table are far smaller than its rows, so the planner
    takes tables of sheets and cells for short ones and would broadcast them.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by key over as many tasks as a shuffle has: rows that pack well lie in few files, which would be few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def judged_once(rows: DataFrame, keys: Sequence[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``judge`` makes of their distinct ``keys``, each judged once however many rows have it.

    ``judge`` returns the keys and further columns; rows whose keys it leaves out drop out.
    """
    found = stored(judge(spread(rows.select(*keys).distinct(), *keys)))
    side = found.select(*(F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in found.columns))
    side = F.broadcast(side) if found.count() <= SHORT_TABLE else by_key(side)
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(side[f"_of_{k}"])
    return rows.join(side, same).drop(*(f"_of_{k}" for k in keys))
