"""Loading: idempotent inserts, upserts, edge rollups, entity totals, traversability, purge and rebuild.

Each function builds a new DataFrame from the old ones; ``plans.store.Store`` makes it the next snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import digest_id

MONEY = "decimal(16,2)"


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key, the first in order; equal keys meet after a partial top-1 on the map side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def insert_if_absent(table: DataFrame | None, incoming: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Rows of ``incoming`` to append: the first of each key that ``table`` doesn't have."""
    fresh = first_by(incoming, [key], order)
    return fresh if table is None else fresh.join(table.select(key), key, "left_anti")


def upsert(table: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``incoming`` replaces rows with the same keys and adds the others."""
    return table.join(incoming.select(keys), keys, "left_anti").unionByName(incoming)


def fill_blanks(table: DataFrame, incoming: DataFrame, key: str, columns: list[str], order: list[Column | str]) -> DataFrame:
    """Null columns take the first value, in order, that ``incoming`` has; values stay."""
    ordered = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    first = incoming.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), ordered)).alias(f"_{c}") for c in columns])
    return table.join(first, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def add_aliases(aliases: DataFrame, incoming: DataFrame) -> DataFrame:
    """New aliases of an entity; known (entity, alias) pairs keep what they have."""
    fresh = first_by(incoming, ["entity_id", "normalized_alias"], [F.desc("confidence"), "alias"])
    return aliases.unionByName(fresh.join(aliases.select("entity_id", "normalized_alias"), ["entity_id", "normalized_alias"], "left_anti"))


def rollup_edges(txns: DataFrame, traversable: DataFrame) -> DataFrame:
    """One edge for each (from, to): total, count, first and last day, and whether both ends are traversable and differ.

    ``txns``: from_id, to_id, amount, day. ``traversable``: id. Transactions aggregate before the ends are looked up, so the
    joins see edges, not transactions.
    """
    sums = txns.filter("from_id IS NOT NULL AND to_id IS NOT NULL").groupBy("from_id", "to_id").agg(
        F.sum("amount").cast(MONEY).alias("total_amount"), F.count("*").cast("int").alias("txn_count"), F.min("day").alias("first_date"), F.max("day").alias("last_date")
    )
    open_ids = traversable.select("id").distinct()
    ends = sums.join(open_ids.select(F.col("id").alias("from_id"), F.lit(True).alias("_f")), "from_id", "left").join(open_ids.select(F.col("id").alias("to_id"), F.lit(True).alias("_t")), "to_id", "left")
    direct = F.coalesce(F.col("_f") & F.col("_t"), F.lit(False)) & (F.col("from_id") != F.col("to_id"))
    return ends.select(digest_id(F.col("from_id"), F.col("to_id")).alias("edge_id"), "from_id", "to_id", "total_amount", "txn_count", "first_date", "last_date", direct.alias("is_direct_link"))


def touching(df: DataFrame, ids: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Rows with either end among ``ids``: two semi joins, as an OR of both would compare every row with every id."""
    one = df.join(ids.select(F.col("id").alias(a)), a, "left_semi")
    two = df.join(ids.select(F.col("id").alias(a)), a, "left_anti").join(ids.select(F.col("id").alias(b)), b, "left_semi")
    return one.unionByName(two)


def refresh_edges(edges: DataFrame, txns: DataFrame, traversable: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges at touched ids from the transactions as they are now; all others stay."""
    old = touching(edges, touched)
    return edges.join(old.select("edge_id"), "edge_id", "left_anti").unionByName(rollup_edges(touching(txns, touched), traversable))


def entity_totals(edges: DataFrame) -> DataFrame:
    """Money in and out, degrees (edges, not transactions), first and last day, for each id at an edge. One shuffle."""
    sides = edges.select(F.explode(F.array(
        F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("total_amount").alias("a"), F.col("first_date").alias("d0"), F.col("last_date").alias("d1")),
        F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.col("total_amount").alias("a"), F.col("first_date").alias("d0"), F.col("last_date").alias("d1")),
    )).alias("s")).select("s.*")
    none = F.lit(0).cast(MONEY)
    return sides.groupBy("id").agg(
        F.coalesce(F.sum(F.when(F.col("i") == 1, F.col("a"))), none).cast(MONEY).alias("total_received"), F.coalesce(F.sum(F.when(F.col("o") == 1, F.col("a"))), none).cast(MONEY).alias("total_given"),
        F.sum("i").cast("int").alias("in_degree"), F.sum("o").cast("int").alias("out_degree"), F.min("d0").alias("first_seen"), F.max("d1").alias("last_seen"),
    )


_TOTALS = ["total_received", "total_given", "in_degree", "out_degree", "first_seen", "last_seen"]


def with_totals(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with fresh totals; those at no edge have zeros and no days."""
    out = entities.drop(*_TOTALS).join(entity_totals(edges), "id", "left")
    zero = {"total_received": F.lit(0).cast(MONEY), "total_given": F.lit(0).cast(MONEY), "in_degree": F.lit(0), "out_degree": F.lit(0)}
    return out.withColumns({c: F.coalesce(F.col(c), z) for c, z in zero.items()})


def promote(entities: DataFrame, txns: DataFrame) -> DataFrame:
    """Traversable stays so; whoever has received money becomes so."""
    paid = txns.filter("to_id IS NOT NULL").select(F.col("to_id").alias("id")).distinct().withColumn("_paid", F.lit(True))
    return entities.join(paid, "id", "left").withColumn("is_traversable", F.coalesce("is_traversable", F.lit(False)) | F.coalesce("_paid", F.lit(False))).drop("_paid")


def orphan_edges(edges: DataFrame, txns: DataFrame) -> DataFrame:
    """Edges that no transaction supports."""
    return edges.join(txns.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def orphan_entities(entities: DataFrame, txns: DataFrame, saved: DataFrame | None, source_id: str) -> DataFrame:
    """Entities of a source with no transaction on either side and no saved search: one anti join on the union of ids."""
    used = [txns.select(F.col("from_id").alias("id")), txns.select(F.col("to_id").alias("id"))]
    if saved is not None:
        used.append(saved.select(F.col("seed_entity_id").alias("id")))
    return entities.filter(F.col("source_id") == source_id).join(reduce(DataFrame.unionByName, used), "id", "left_anti")


def purge_source(entities: DataFrame, edges: DataFrame, txns: DataFrame, saved: DataFrame | None, source_id: str, entity_source: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, edges and transactions without a source; totals and edges are rebuilt from what is left.

    ``entity_source``: whose entities go if nothing refers to them any more; the source's own unless given.
    """
    kept = txns.filter(~F.col("source_id").eqNullSafe(F.lit(source_id)))
    left = entities.join(orphan_entities(entities, kept, saved, entity_source or source_id).select("id"), "id", "left_anti")
    return (*rebuild_all(left, kept), kept)


def removed_counts(before: tuple[DataFrame, DataFrame, DataFrame], after: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """One row: how many entities, edges and transactions are gone. Keys: id, edge_id, id."""
    gone = [a.join(b.select(k), k, "left_anti").agg(F.count("*").alias(f"{n}_removed")) for a, b, k, n in zip(before, after, ("id", "edge_id", "id"), ("entities", "edges", "transactions"), strict=True)]
    return reduce(DataFrame.join, gone)  # one row each


def rebuild_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: what a rebuild has written: edges, entities with totals, and traversable ones."""
    a = edges.agg(F.count("*").alias("edges"), F.count_if("is_direct_link").alias("direct_links"))
    b = entities.agg(F.count_if(F.col("in_degree") + F.col("out_degree") > 0).alias("entities_with_totals"), F.count_if("is_traversable").alias("traversable"))
    return a.join(b)  # one row each


def rebuild_all(entities: DataFrame, txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and edges from the transactions alone: traversability first, then edges, then totals."""
    promoted = promote(entities, txns)
    edges = rollup_edges(txns, promoted.filter("is_traversable").select("id"))
    return with_totals(promoted, edges), edges


def registry_keep_best(rows: DataFrame) -> DataFrame:
    """One row a name: the first active one, else the first. ``rows``: name, type, status, pos."""
    return first_by(rows, ["name"], [F.when(F.col("status") == "active", 0).otherwise(1), "pos"]).drop("pos")


def apply_registry(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """Kind, type, status and name of registered committees (joined by normalized_name, which stays); they are traversable."""
    r = registry.select("normalized_name", F.col("name").alias("_name"), F.col("type").alias("_type"), F.col("status").alias("_status"), F.lit(True).alias("_listed"))
    listed = F.col("_listed").isNotNull()
    out = entities.join(r, "normalized_name", "left").withColumns({
        "kind": F.when(listed, "committee").otherwise(F.col("kind")), "committee_type": F.when(listed, F.col("_type")).otherwise(F.col("committee_type")),
        "status": F.when(listed, F.col("_status")).otherwise(F.col("status")), "name": F.when(listed, F.col("_name")).otherwise(F.col("name")),
        "is_traversable": F.coalesce("is_traversable", F.lit(False)) | listed,
    })
    return out.select(entities.columns)


def run_records(runs: DataFrame, source_id: str, started_at: Column) -> DataFrame:
    """Rows for the run log. ``runs``: scope, rows_fetched, rows_inserted, rows_skipped, error. A run failed exactly if it has an error."""
    now = F.current_timestamp()
    return runs.select(
        digest_id(F.lit(source_id), F.col("scope"), now.cast("string")).alias("id"), F.lit(source_id).alias("source_id"), F.when(F.col("error").isNotNull(), "failed").otherwise("succeeded").alias("status"),
        "scope", "rows_fetched", "rows_inserted", "rows_skipped", "error", started_at.alias("started_at"), now.alias("finished_at"),
    )


def run_record(spark, source_id: str, fetched: int, inserted: int, skipped: int, error: str | None = None, scope: str | None = None, started_at: Column | None = None) -> DataFrame:
    """One row for the run log."""
    run = spark.createDataFrame([(scope, fetched, inserted, skipped, error)], "scope string, rows_fetched int, rows_inserted int, rows_skipped int, error string")
    return run_records(run, source_id, F.current_timestamp() if started_at is None else started_at)
