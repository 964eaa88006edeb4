"""What the operators of this subpackage share: shared storage, size-checked joins, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it holds no more bytes than this, by its own measured size.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where none is set, a local session gets one of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="vektorium-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder, which keeps column pruning. codec: the table's compression, the session's if None."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vektorium-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote for df, once nothing that is still to run reads it."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """docs with ``__v_doc``, the id as a number, and ``__v_sub``, which tells apart the texts that share an id.

    ``__v_sub`` is 0 where a single row has the id, which the id column alone tells, else a hash of
    the text: rows of one id and equal text are the same document. A null id stays null.
    """
    own = docs.withColumn("__v_doc", F.col(id_col).cast("long"))
    shared = cut(own.where("__v_doc IS NOT NULL").groupBy("__v_doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__v_doc", F.lit(True).alias("__v_shared")))
    if shared.isEmpty():
        return own.withColumn("__v_sub", F.lit(0).cast("long"))
    side = F.broadcast(shared) if is_small(shared, 24) else shared
    return own.join(side, "__v_doc", "left").withColumn("__v_sub", F.when(F.col("__v_shared"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("__v_shared")


def is_small(df: DataFrame, row_bytes: Column | int, bound: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of df, an already materialised table, hold bound bytes at most. row_bytes: of one row."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("b")).first()["b"]
    return (size or 0) <= bound


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def worker_cache(kind: str, key: str, make):
    """The value of a kind that the Python worker process keeps from task to task; another key's value replaces it."""
    held = sys.modules.setdefault("_vektorium_worker", types.ModuleType("_vektorium_worker")).__dict__
    if held.get(kind, ("",))[0] != key:
        held.pop(kind, None)
        held[kind] = (key, make())
    return held[kind][1]
