"""Work that arrives: streaming ingestion with duplicates dropped, stuck jobs, retries, and what a re-reading replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

STUCK_MINUTES, ATTEMPTS = 30, 3


def requeued(jobs: DataFrame, now: str) -> DataFrame:
    """jobs; those that have been running for longer than STUCK_MINUTES are queued again."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {STUCK_MINUTES} MINUTES"))
    return jobs.withColumn("status", F.when(stuck, "queued").otherwise(F.col("status")))


def outcomes(jobs: DataFrame) -> DataFrame:
    """jobs after a try: done, queued for another, or failed; error is null for success, retryable says what it was."""
    again = F.col("retryable") & (F.col("attempts") + 1 < ATTEMPTS)
    return jobs.withColumn("status", F.when(F.col("error").isNull(), "done").when(again, "queued").otherwise("failed")).withColumn("attempts", F.col("attempts") + 1)


def latest(old: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """Bills after a re-reading: the new reading replaces an old one of the same document unless that is confirmed."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.desc(F.when((F.col("_new") == 0) & (F.col("status") == "confirmed"), 2).otherwise(F.col("_new"))))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def ingest(arrivals: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Files as they arrive (filename, content, arrived), each content once, written as Parquet; what is there, then end.

    Contents are known by hash; state for one is dropped when its watermark has passed.
    """
    hashed = arrivals.withColumn("sha256", F.sha2("content", 256)).withWatermark("arrived", delay)
    once = hashed.dropDuplicatesWithinWatermark(["sha256"]).withColumn("path", F.concat_ws("/", F.lit("files"), F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), F.col("sha256")))
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checked(arrivals: DataFrame, history: DataFrame) -> DataFrame:
    """Bills that arrive (id, seller_id, invoice_number, financial_year) with duplicate_of, the first bill of the same
    seller, number and year (nulls are one year) among those before them, and first_of_seller.

    Earlier bills meet the arrivals as one row a key, so history is aggregated before it is joined; arrivals of one
    batch are known to each other by rising id.
    """
    key = ["seller_id", "invoice_number", F.coalesce("financial_year", F.lit("")).alias("fy")]
    known = history.where(F.col("seller_id").isNotNull() & (F.col("invoice_number") != ""))
    olds = known.groupBy(*key).agg(F.min("id").alias("old_id"))
    sellers = history.where("seller_id is not null").groupBy("seller_id").agg(F.lit(True).alias("seen")).distinct()
    rows = arrivals.withColumn("fy", F.coalesce("financial_year", F.lit(""))).join(olds, ["seller_id", "invoice_number", "fy"], "left").join(sellers, "seller_id", "left")
    whole = F.col("seller_id").isNotNull() & (F.col("invoice_number") != "")
    first = F.min("id").over(Window.partitionBy("seller_id", "invoice_number", "fy"))
    of_seller = F.min("id").over(Window.partitionBy("seller_id"))
    dup = F.when(whole, F.coalesce("old_id", F.when(first < F.col("id"), first)))
    return rows.select("id", dup.alias("duplicate_of"), (F.col("seller_id").isNotNull() & F.col("seen").isNull() & (of_seller == F.col("id"))).alias("first_of_seller"))


def check_stream(bills: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """checked() on a stream: each batch against all before it, which are read from, and then added to, the table at
    path (bills) beside what was found (checks). A batch that is tried again replaces its own files."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fields = rows.select("id", "seller_id", "invoice_number", "financial_year")
        old = spark.read.schema(fields.schema.add("batch", "long")).parquet(f"{path}/bills").where(F.col("batch") < number).drop("batch") if number else fields.limit(0)
        checked(fields, old).write.mode("overwrite").parquet(f"{path}/checks/batch={number}")
        fields.write.mode("overwrite").parquet(f"{path}/bills/batch={number}")

    return bills.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of a table and of a newer form of it: columns are only added, and are null where they weren't."""
    return old.unionByName(new, allowMissingColumns=True)


def persisted(old: dict[str, DataFrame], new: dict[str, DataFrame], parent: str = "invoices", key: str = "id", child_key: str = "invoice_id") -> dict[str, DataFrame]:
    """Bills and their rows after bills were read anew: a bill that is read again loses all its old rows."""
    again = new[parent].select(key).distinct()
    out = {parent: widened(old[parent].join(again, key, "left_anti"), new[parent])}
    for name in new:
        if name != parent:
            stays = old[name].join(again.withColumnRenamed(key, child_key), child_key, "left_anti")
            out[name] = widened(stays, new[name])
    return out
