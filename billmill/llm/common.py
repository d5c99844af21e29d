"""What the operators share: checkpoints, Arrow batch sizes, row identity and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: whole texts travel in them, so a batch has to stay small in bytes too.
ARROW_ROWS, ARROW_BYTES = 2048, 16 << 20


#: Parts that a node's edges are dealt into.
SALTS = 8


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, and gives a session without spark.checkpoint.dir a folder of its own (tests only)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc.getConf().get("spark.checkpoint.dir") is None and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a shared folder")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="billmill-checkpoints-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver can all write: spark.checkpoint.dir, or what stands in for it in tests."""
    sc = prepared(spark).sparkContext
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df, written as Parquet to the shared folder and read from there: like cut(), but compressed, for what has texts."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def whole(batches: Iterator[pd.DataFrame], keys: list[str], most: int, size: str | None = None) -> Iterator[pd.DataFrame]:
    """Rows sorted by keys, gathered to about `most` of their `size` (a column; rows, if none), no key in two frames."""
    held: list[pd.DataFrame] = []
    total, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cum = np.concatenate([[0], np.cumsum(batch[size].to_numpy())]) if size else np.arange(len(batch) + 1)
        bounds = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and total >= most and (k[0] != last).any():
            yield pd.concat(held, ignore_index=True)
            held, total = [], 0
        end = 0
        for b in bounds:
            if total + cum[b] - cum[end] >= most:
                yield pd.concat([*held, batch.iloc[end:b]], ignore_index=True)
                held, total, end = [], 0, b
        held.append(batch.iloc[end:])
        total, last = total + cum[-1] - cum[end], k[-1]
    if held:
        yield pd.concat(held, ignore_index=True)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there: lost executors cost no recomputation."""
    prepared(df.sparkSession)
    return df.checkpoint(eager=True)


def free(df: DataFrame, name: str) -> str:
    """A column name like name that df hasn't got."""
    while name in df.columns:
        name += "_"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (u, v) that isn't the least of its component; nodes: any ordered type.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step joins edges with one minimum a
    node, by node and salt, so that a hub's edges are split over tasks; what goes to the driver is a count and a sum.
    Self-loops and repeated edges are allowed; no edges, no rows.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = cut(e), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        # A node's larger neighbours go to the least of its smaller ones (itself, if it has none) ...
        large = with_least(e, e, "v", "u").select("u", F.coalesce("m", "v").alias("v")).distinct()
        # ... and then its smaller ones, and itself, to the least of those.
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = with_least(large, large, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least).distinct())


def with_least(edges: DataFrame, of: DataFrame, on: str, other: str) -> DataFrame:
    """edges with m, the least v that `of` has where its u is the edge's node `on`; the edge's other end is the salt."""
    least = of.groupBy(F.col("u").alias(on)).agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(least, [on, "salt"], "left")
