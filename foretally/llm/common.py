"""What the operators share: tables, shared folders, and checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table below this many bytes may be sent to every task.
BROADCAST_BYTES = 8 << 20
#: Rows of a broadcast of large groups at most, and the rows that a group must have to be one.
HOT_ROWS, HOT_LEAST = 2000, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which must be set."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return top.rstrip("/")


#: Folders (and tables) written inside the innermost scratch of this thread or task.
_WRITTEN: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession, what: str, name: str | None = None) -> str:
    """A new folder of its own; `name` is the table that lies in it."""
    path = f"{shared_dir(spark)}/foretally/{what}-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append((path, name))
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it again: the lineage is cut, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, key: str, what: str, placed: bool = False) -> DataFrame:
    """df, written once in buckets of `key`: later joins on it move only the other side.  `placed`: df is already repartitioned by it."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    name = f"foretally_{what}_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(n, key)
    rows.write.format("parquet").option("compression", "zstd").bucketBy(n, key).option("path", shared_folder(spark, what, name)).saveAsTable(name)
    return spark.table(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list]:
    """Deletes at its end what the operators wrote to the shared folder inside it; results must have been written elsewhere by then."""
    written: list[tuple[str, str | None]] = []
    token = _WRITTEN.set(written)
    try:
        yield written
    finally:
        _WRITTEN.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path, name in written:
            if name:
                spark.sql(f"drop table if exists {name}")
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def settled(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written once; all that it wrote on the way is deleted.  Where it wrote nothing, its result stays lazy."""
    with scratch(spark) as written:
        df = make()
        if not written:
            return df
        outer = _WRITTEN.set(None)
        path = shared_folder(spark, what)
        _WRITTEN.reset(outer)
        df.write.option("compression", "zstd").parquet(path)
    if (above := _WRITTEN.get()) is not None:
        above.append((path, None))
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def sized(spark: SparkSession, rows: int, each: int = 20_000) -> Iterator[None]:
    """Jobs run inside it shuffle into no more partitions than `rows` fill with `each`: a small table isn't dealt over a cluster."""
    before = partitions(spark)
    spark.conf.set("spark.sql.shuffle.partitions", str(max(1, min(before, -(-rows // each)))))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows, inner-joined with groups (a row a key, with the number of its rows in column `size`).

    There can't be more than HOT_ROWS groups with more than 1 / HOT_ROWS of all rows: these are
    broadcast, so that the rows of a large group stay where they are; the others are
    joined by a shuffle.  Both tables should be written ones.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > max(HOT_LEAST, total / HOT_ROWS)
    hot = groups.where(large)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(~large), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def within(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The rows whose keys are among those of groups, which go through the same two ways as in beside."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) > max(HOT_LEAST, total / HOT_ROWS)
    hot = F.broadcast(groups.where(large).select(*keys))
    rest = rows.join(hot, keys, "left_anti").join(groups.where(~large).select(*keys), keys, "left_semi")
    return rows.join(hot, keys, "left_semi").unionByName(rest)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns; rows without an id have no result and go."""
    return docs.select(*columns).where(F.col("doc_id").isNotNull())
