"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that ``materialise`` has written and ``release`` has not removed, in order.
_written: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees.

    Where it is not set, a session in one process gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="candela-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and the columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/candela/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of materialised tables, for ``release``."""
    return len(_written)


def release(spark: SparkSession, start: int = 0, end: int | None = None) -> None:
    """Remove the tables materialised between two marks; what was computed from them must have been written."""
    end = len(_written) if end is None else end
    for path in _written[start:end]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    del _written[start:end]


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small table in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Texts that a worker holds as Python strings at once; a batch of Arrow may be all that a task reads.
TEXTS_AT_ONCE = 256


def by_parts(run: Callable[[list], pa.Array], texts: pa.Array) -> pa.Array:
    """``run`` over a few of the texts at a time, joined; its results must not depend on the texts beside."""
    return pa.concat_arrays([run(texts.slice(at, TEXTS_AT_ONCE).to_pylist()) for at in range(0, max(1, len(texts)), TEXTS_AT_ONCE)])


def utf8(column: str) -> Column:
    """The text column with null as empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def free_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores after those that a table has already, whatever their case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def drawn(share: Column | float, *keys: Column) -> Column:
    """Whether a row is in a sample of about this share of the keys' values, by their hash: no sort, no shuffle."""
    part = F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))
    return part < share
