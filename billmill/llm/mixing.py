"""Mixing sources to target weights by Poisson replication, in DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SEED, POWER = 42, 0.5
#: Up to so many sources are sent to every task; more meet their documents by a shuffled join.
FEW = 2000


def uniform(*parts: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the MD5 of the parts: 52 bits, exact in a double, the same in any engine."""
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("~")) for p in parts), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: DataFrame | None, source_col: str, size: Column, power: float = POWER) -> DataFrame:
    """(source, size, rate, cdf) of each source: rate is how often a document is to occur on average.

    targets: (source, weight); without it a source weighs its size to the power, which lifts small sources. Weights
    are scaled so that the expected total size stays what it is. Sources with no target get rate 0. cdf has the
    Poisson distribution's values from 0 on, up to where a double has no more to tell.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(power)))
    else:
        given = targets.select(F.col("source").alias("s"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("w")).groupBy("s").agg(F.max("w").alias("w"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "size", F.coalesce("w", F.lit(0.0)).alias("weight"))
    total = sizes.agg(F.sum("size").cast("double").alias("all"), F.sum(F.when(F.col("size") > 0, F.col("weight").cast("decimal(38,12)"))).cast("double").alias("weights"))
    rate = F.when((F.col("size") > 0) & (F.col("weights") > 0), F.col("weight") / F.col("weights") * F.col("all") / F.col("size")).otherwise(F.lit(0.0))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-F.col("rate")).alias("ln"), F.array(F.exp(-F.col("rate"))).alias("cdf")),
        lambda a, k: F.struct((a["ln"] + F.log(F.col("rate") / k)).alias("ln"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(a["ln"] + F.log(F.col("rate") / k)))).alias("cdf")),
    )["cdf"]
    named = sizes.join(F.broadcast(total)).withColumn("rate", rate)  # total is one row
    return named.select("source", "size", "rate", F.when(F.col("rate") > 0, steps).otherwise(F.array(F.lit(1.0))).alias("cdf"))


def mix(docs: DataFrame, targets: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs, each as often as a Poisson number with its source's rate says, in a random order over all partitions.

    The number is the inverse of the distribution at a hash of id and seed: copies of a row (same id) get the same
    number, and runs agree whatever the partitioning. A document's size is its text's length, 1 at least, also for
    null and empty texts. A null source is a source of its own. Three columns come first: mix_copy (from 0), mix_rate
    and mix_key, by which rows are dealt and sorted; docs' columns of these names are replaced, all others stay. An
    empty table gives no rows. One row a source meets the
    documents: broadcast if the sources are FEW (counted), or else by a join that Spark splits where a source is hot.
    """
    names = [c for c in docs.columns if c not in ("mix_copy", "mix_rate", "mix_key")]
    size = F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long")
    table = rates(docs, targets, source_col, size).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"), F.col("cdf").alias("mix_cdf"))
    table = cut(table)
    table = F.broadcast(table) if table.count() <= FEW else table
    doc = F.col("doc").getField  # all of docs' columns, so that their names can't meet those made here
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc")).join(table, doc(source_col).eqNullSafe(F.col("mix_source")))
    drawn = rows.withColumn("mix_u", uniform(doc(id_col).cast("string"), seed=seed)).withColumn("mix_n", F.size(F.filter("mix_cdf", lambda c: c <= F.col("mix_u"))))
    copies = drawn.where("mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.coalesce(doc(id_col).cast("string"), F.lit("~")), F.col("mix_copy").cast("string"), F.lit(str(seed)), F.lit("order"))))
    out = keyed.select("mix_copy", "mix_rate", "mix_key", *(doc(c).alias(c) for c in names))
    return out.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
