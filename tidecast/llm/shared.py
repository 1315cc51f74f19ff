"""What the operators of this subpackage share: the checkpoint folder, cutting lineage, and connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, and only where that is unset and all runs on
    one machine (tests) one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            made = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, made, True)
            _own.append(f"file://{made}")
        named = _own[0]
    return named


#: Rows of one Arrow batch between Spark and Python, where the session does not ask for fewer; texts may be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(min(BATCH_ROWS, int(spark.conf.get(key)))))


def texts_of(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text) of the rows that have an id; a row without one can neither be named in a result nor come before another."""
    docs = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return docs.where("doc_id is not null")


_written: list[DataFrame] = []


def tables_left() -> list[DataFrame]:
    """The durable tables that are not discarded yet, in the order of their making."""
    return list(_written)


def durable(df: DataFrame) -> DataFrame:
    """The rows written as a table to the shared folder and read back, without the lineage that made them.

    Reading needs no executor that took part in writing; discard() removes a table that is no longer read.
    """
    path = f"{folder(df.sparkSession)}/tidecast-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    _written.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a durable table."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written[:] = [t for t in _written if t.written != df.written]


#: Rows of ids (some 30 bytes each in memory) up to which they are broadcast to the rows that they select.
IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it is counted to have IDS rows at most: then texts are not shuffled to meet it."""
    return F.broadcast(ids) if ids.count() <= IDS else ids


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished jobs now and not when the driver next runs short of memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shards(rows: int, size: int, least: int = 1) -> int:
    """How many shards of about size rows."""
    return max(least, -(-rows // size))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected links (a, b): component is the smallest node that links reach.

    Alternating star contraction: each round sends every node's neighbours above it to its smallest neighbour, then every
    node's neighbours below it to the smallest of those, until the links form stars.  Both steps aggregate on the node
    before they join, rounds grow with the logarithm of the longest path, and each round is checkpointed.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = durable(small)
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        discard(edges)
        edges, settled, seen = after, now == seen, now
        if settled:
            stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
            return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"the components did not settle in {most_rounds} rounds")
