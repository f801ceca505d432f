"""Sharding: contiguous shards of near equal size, cut from a global prefix sum of bytes.

Rows are put in order by range partitions. Each partition sums its own sizes while it streams through its sorted rows; only
one total a partition goes to the driver. A row's global position is its partition's offset plus its place inside, and a row
goes to the shard in which the middle of its bytes lies, so a shard is off the equal target by one row at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, whole_text, written

LAW = "bytes"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the row's place and the bytes before it, both inside its partition."""
    rows = total = 0
    for b in batches:
        size = b.column("_size")
        after = pc.add(pc.cumulative_sum(size), total) if len(b) else size
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(range(rows, rows + len(b)), pa.int64()), pc.subtract(after, size)],
            names=[*b.schema.names, "_row", "_before"],
        )
        rows, total = rows + len(b), after[-1].as_py() if len(b) else total


def shard_by_bytes(spark: SparkSession, rows: DataFrame, size: str, order: list[str], shards: int = 8) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 within a shard) to ``rows``.

    ``size``: a column of positive longs. ``order``: columns that define the global order; shards are contiguous in it, and
    rows that tie in all of them may stand in either order. Nulls come first. Equal rows are separate rows. Groups (such as
    equal texts) are not held together: the law is equal bytes. An empty table gives an empty result. The columns of
    ``rows`` travel with the order, so give only what is needed; ``write_shards`` carries whole documents.
    """
    clash = {"_size", "_part", "_row", "_before", "shard", "slot"} & set(rows.columns)
    if clash:
        raise ValueError(f"reserved column names: {sorted(clash)}")
    ranged = rows.withColumn("_size", F.col(size).cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_before", T.LongType())])
    placed = written(spark, ranged.mapInArrow(_running, schema), "shard-order")

    # One row a range partition, so bounded by spark.sql.shuffle.partitions, not by the data.
    totals = placed.groupBy("_part").agg(F.sum("_size").alias("bytes"), F.count("*").alias("n")).orderBy("_part").collect()
    offsets, total, count = [], 0, 0
    for t in totals:
        offsets.append((t["_part"], total, count))
        total, count = total + t["bytes"], count + t["n"]
    starts = spark.createDataFrame(offsets, "_part int, _bytes0 long, _row0 long")
    cut = placed.join(F.broadcast(starts), "_part").withColumns({
        "shard": F.least(F.lit(shards - 1), F.expr(f"({shards} * (2 * (_bytes0 + _before) + _size)) div {max(1, 2 * total)}")).cast("int"),
        "_rank": F.col("_row0") + F.col("_row"),
    })
    first = {r["shard"]: r["first"] for r in cut.groupBy("shard").agg(F.min("_rank").alias("first")).collect()}  # at most `shards` rows
    begins = F.element_at(F.create_map(*[F.lit(x) for s, n in sorted(first.items()) for x in (s, n)]), F.col("shard")) if first else F.lit(0)
    return cut.withColumn("slot", (F.col("_rank") - begins).cast("long")).drop("_size", "_part", "_row", "_before", "_bytes0", "_row0", "_rank")


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes whole documents, one folder a shard, in order of doc_id."""
    sized = docs.withColumn("size_bytes", F.octet_length(whole_text()).cast("long") + 1)
    shard_by_bytes(spark, sized, "size_bytes", ["doc_id"], shards).write.partitionBy("shard").parquet(path)


def op9_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole_text()
    sized = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    done = shard_by_bytes(spark, sized, "size", ["doc_id", "size", "text_crc32"])
    return done.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_prefix_shards": op9_prefix_shards}
ORACLES: dict[str, str] = {}  # DuckDB has no crc32; tests hold the query against plain Python
