"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Tells the tables of this driver from those of others that share the folder.
OWN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in
    ``spark.checkpoint.dir``. Where that is unset a local master (tests, a laptop) gets a
    temporary folder of this machine; on a cluster it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "rotagraph-checkpoints")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this driver's tables."""
    return f"{shared_dir(spark)}/rotagraph/{spark.sparkContext.applicationId}-{OWN}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{own_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: For tables of large packed rows: a page ends when it is full, not after a hundred rows,
#: and rows that are compressed already are not compressed again.
PACKED = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(32 << 20), "compression": "none"}


def _delete(spark: SparkSession, path: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df, what: str, **options: str):
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage
    is cut and a lost executor costs no recomputation. ``options``: of the writer. What a
    failed job has written is deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    try:
        df.write.options(**options).parquet(path)
    except Exception:
        _delete(spark, path)
        raise
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df) -> None:
    """Deletes a table that ``written`` gave, when nothing reads it any more."""
    _delete(df.sparkSession, df._written_to)


def forget(spark: SparkSession) -> bool:
    """Deletes the tables that this driver has left in the shared folder; frames that were
    built on them can't be read any more. Tables of other drivers stay."""
    return _delete(spark, own_dir(spark))


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings for the jobs within; what was set before is restored."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
