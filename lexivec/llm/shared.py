"""What the operators share: the folder for intermediate tables, and small helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one is set if all runs in this
    process; on a cluster that folder would not be shared, so there it is an error."""
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexivec-")
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexivec/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd", options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, and no executor holds the only copy."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote. Whatever was made from them has to be written by now."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """Tables of one job, deleted together when its result is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str, codec: str = "lz4", options: dict[str, str] | None = None) -> DataFrame:
        return self.add(materialize(df, name, codec, options))

    def add(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def clear(self) -> None:
        discard(*self.tables)
        self.tables.clear()


def small_batches(spark: SparkSession) -> None:
    """Batches for Python hold at most BATCH_BYTES from now on, so that a few long texts don't fill a worker's memory."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(ARROW_BYTES)) > BATCH_BYTES:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Batches of at most `rows` rows for Python while the block runs; long rows make batches of the usual size heavy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeded_key(*parts) -> F.Column:
    """60 bits of md5 over the parts joined by ':', as long. The same number comes out of any SQL engine with md5."""
    text = F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


#: Copies of a row that one task writes, about.
COPIES = 1 << 16


def with_copies(counted: DataFrame, times: str = "times", name: str = "copy") -> DataFrame:
    """Each row of `counted` as often as its column `times` says, numbered from 0 in `name`. Rows with very many copies are
    dealt to many tasks first."""
    at, most = F.col(times), F.lit(COPIES).cast("long")
    few = counted.filter(at <= most).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), at - 1)))
    many = counted.filter(at > most)
    if many.isEmpty():
        return few.drop(times)
    part = free_name(counted, "_part")
    many = many.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((at - 1) / most)))).repartition(*counted.columns, part)
    many = many.withColumn(name, F.explode(F.sequence(F.col(part) * most, F.least(at, (F.col(part) + 1) * most) - 1))).drop(part)
    return few.unionByName(many).drop(times)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem
