"""What the training-data operators share: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only local mode, as in tests, gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='swatchline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: With this, Spark removes a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


#: A join's large side is filtered by a Bloom filter of the other side's keys, also where it is under 10 GB.
BLOOM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


#: Without this, a join whose sides have moved already sends one of them to the driver, if it is small, and from there to all.
LATE_BROADCAST = "spark.sql.adaptive.autoBroadcastJoinThreshold"


@contextmanager
def held(spark: SparkSession, conf: dict[str, str]):
    """Settings of the session for a while; those before come back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, batch: int | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: later steps don't depend on its executors.

    Its shuffle files go when it is written, since nothing reads them any more. batch: rows of an Arrow batch in it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/swatchline-{uuid.uuid4().hex}"
    own = {CLEAN_UP: "true", BLOOM: "1MB"} | ({BATCH: str(batch)} if batch else {})
    with held(spark, own):
        df.write.parquet(path)
    gc.collect()  # lets the driver's JVM drop the plans of steps that Python no longer refers to
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames that cut() returned, once what was made of them is itself written."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/swatchline-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of whole documents stay small, whatever the number of rows of a partition.

    A smaller setting of the session stays; it is never raised.
    """
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (src, dst) links as (node, component), component the smallest node.

    Alternating large-star and small-star rounds; each is a few joins and aggregates by node, written to the
    shared folder. No node's neighbours are gathered in one place: minima combine before the shuffle, and the
    joins that follow split a hot node by AQE. Rows with null ends are ignored, nodes without links are absent.
    """
    e = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        # done when every node but the roots has one link, to a root
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").head(1):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
