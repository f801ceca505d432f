"""Saved searches: small snapshots rewritten on each change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SAVED, conform, digest_id

MOST = 100


def create(saved: DataFrame, name: str, seed: str, params: dict, description: str | None = None, positions: dict | None = None) -> DataFrame:
    """The table with one more search."""
    from pyspark.sql.types import StructType

    spark, kind = saved.sparkSession, StructType.fromDDL(SAVED)
    row = spark.createDataFrame([(name, description, seed, {f.name: params.get(f.name) for f in kind["params"].dataType}, positions)], StructType([kind[c] for c in ("name", "description", "seed_entity_id", "params", "node_positions")]))
    now = F.current_timestamp()
    row = row.withColumns({"created_at": now, "updated_at": now}).withColumn("id", digest_id(F.col("name"), F.col("seed_entity_id"), F.col("created_at")))
    return saved.unionByName(conform(row, SAVED))


def listing(saved: DataFrame, entities: DataFrame) -> DataFrame:
    """Latest first, with the seed's name if it is still there."""
    names = entities.select(F.col("id").alias("seed_entity_id"), F.col("name").alias("seed_name"))
    return saved.join(names, "seed_entity_id", "left").orderBy(F.desc("updated_at"), "id").limit(MOST)


def update(saved: DataFrame, search: str, **values) -> DataFrame:
    """Given text columns change, and updated_at with them."""
    here = F.col("id") == search
    out = saved.withColumns({k: F.when(here, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})
    return out.withColumn("updated_at", F.when(here, F.current_timestamp()).otherwise(F.col("updated_at")))


def delete(saved: DataFrame, search: str) -> DataFrame:
    """Raises KeyError where there is no such search."""
    if saved.filter(F.col("id") == search).isEmpty():
        raise KeyError(search)
    return saved.filter(F.col("id") != search)


def without_entities(saved: DataFrame, gone: DataFrame) -> DataFrame:
    """Searches go with their seed."""
    return saved.join(gone.select(F.col("id").alias("seed_entity_id")), "seed_entity_id", "left_anti").select(saved.columns)
