"""Lineage cuts in the folder that a cluster shares, and row numbers without a window over all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Spark's setting that checkpoints are deleted with the frames that read them.
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where neither is set, a local master gets a folder of its own; on a cluster that is an error, as executors don't share the driver's folders.
    """
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    set_to = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if set_to:
        if not have.isDefined():
            context.setCheckpointDir(set_to)
        return set_to
    if not have.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sastra-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage, so that a lost executor costs a reread only.

    The files go when the driver drops the last frame that reads them, unless the session has its own say in that.
    """
    shared_dir(df.sparkSession)
    conf = df.sparkSession.sparkContext._jsc.sc().conf()
    if not conf.contains(CLEAN):
        conf.set(CLEAN, "true")
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """``df`` with its place from 1 by the columns ``order``, which should tell rows apart.

    Rows are range-partitioned and counted range by range; ranges get their offsets from one row each, so no task holds all rows.
    ``df`` is computed once: finding the ranges reads all rows before they are dealt out.
    """
    ranged = cut(df).repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = cut(ranged.withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__c"))
    offsets = counts.select("__range", (F.sum("__c").over(W.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__c")).alias("__before"))  # one row a range
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return ranged.join(F.broadcast(offsets), "__range").withColumn(name, (F.col("__before") + place).cast("long")).drop("__range", "__before")
