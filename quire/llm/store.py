"""Reading tables and writing intermediate ones where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session may do without it."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/checkpoints"
    return base.rstrip("/")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, Python functions get at most that many rows at a time; a lower setting holds."""
    was = spark.conf.get(_BATCH)
    if not 0 < int(was) <= rows:
        spark.conf.set(_BATCH, rows)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, was)


def materialize(df: DataFrame, label: str, by: str | None = None, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor loses nothing of it. With by, there is a folder for each value of that column. With rows, Python
    functions in df get at most that many at a time, so that long ones aren't held by the ten thousand. The files go
    when the Python process of the driver ends or release() is called."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{label}"
    with batches_of(spark, rows) if rows else nullcontext():
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    _made[path] = spark
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def _delete(path: str) -> None:
    spark = _made.pop(path)
    try:
        jvm = spark.sparkContext._jvm
        parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
    except Exception:  # noqa: BLE001  the session may be gone already; nothing else depends on it
        pass


def discard(*written: DataFrame) -> None:
    """Delete the files of DataFrames that materialize() returned, once nothing reads them any more."""
    for df in written:
        if df._written in _made:
            _delete(df._written)


def release() -> None:
    """Delete what materialize() wrote. DataFrames built on it can't be read afterwards."""
    for path in list(_made):
        _delete(path)


def scratch(df: DataFrame, name: str) -> str:
    """The name, or a longer one if df has a column of that name."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, names: list[str], found: Column) -> DataFrame:
    """df with the fields of a struct as columns of these names, which replace df's own."""
    kept = df.drop(*names).columns
    name = scratch(df, "found")
    return df.withColumn(name, found).select(*(F.col(f"`{c}`") for c in kept), *(F.col(name)[x].alias(x) for x in names))


atexit.register(release)
