"""A money-flow graph over the star-schema tables: each line item is a transaction between a supplier and a customer.

The supplier (S...) files. An item is an expenditure if it was returned and is large, else a contribution by the customer
(C...). Customers and suppliers are the entities; nations their cities.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.text import directed_ends, row_hash
from ..operators.load import promote, rollup_edges, with_totals
from ..schemas import COMMITTEE_TYPES
from .store import cut, release

MONEY = "decimal(16,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows: filer, counterparty, direction, amount, day, codes and a row hash."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = items.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    large = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 50)
    return rows.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("filer"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("counterparty"),
        F.when(large, "expenditure").otherwise("contribution").alias("direction"), F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("l_shipdate").cast("date").alias("day"),
        F.col("l_linestatus").alias("type_code"), F.col("o_orderpriority").alias("description"), F.concat(F.lit("q"), (F.col("l_linenumber") % 3).cast("string")).alias("source_id"),
        row_hash(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("id"),
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions from one entity to another."""
    rows = filings(spark, sf_dir)
    frm, to = directed_ends(F.col("filer"), F.col("counterparty"), F.col("direction"))
    return rows.select("id", frm.alias("from_id"), to.alias("to_id"), "amount", "day", "direction", "type_code", "description", "source_id")


def parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities before any money."""
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("city"))
    types = F.array(*map(F.lit, COMMITTEE_TYPES))
    customers = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "organization").otherwise("individual").alias("kind"),
        F.col("c_name").alias("name"), F.lit(None).cast("string").alias("committee_type"), F.col("c_nationkey").alias("nation"),
    )
    suppliers = read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("committee").alias("kind"), F.col("s_name").alias("name"),
        F.element_at(types, (F.col("s_suppkey") % 7 + 1).cast("int")).alias("committee_type"), F.col("s_nationkey").alias("nation"),
    )
    rows = customers.unionByName(suppliers).join(nation, "nation", "left").drop("nation")
    return rows.withColumns({"normalized_name": normalize_name(F.col("name")), "is_traversable": F.lit(False), "source_id": F.concat(F.lit("q"), F.substring("id", 1, 1))})


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities with totals, edges, and transactions."""
    txns = flows(spark, sf_dir)
    promoted = promote(parties(spark, sf_dir), txns)
    edges = rollup_edges(txns, promoted.filter("is_traversable").select("id"))
    return with_totals(promoted, edges), edges, txns


@dataclass
class Stored:
    """A graph as its readers use it: edges twice, in order of either end, so that a look at few nodes reads few row groups."""

    entities: DataFrame
    edges: DataFrame
    edges_from: DataFrame
    txns: DataFrame


_STORED: dict[tuple, Stored] = {}


def _state(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """What tells one state of the input tables from another: their files, sizes and times."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for n in names:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in p.getFileSystem(conf).listStatus(p))
    return tuple(out)


def stored_graph(spark: SparkSession, sf_dir: str) -> Stored:
    """The graph, stored once for a state of the tables; hops, crawls, ledgers and searches read it in place of building it."""
    key = (spark.sparkContext.applicationId, _state(spark, sf_dir, ["lineitem", "orders", "customer", "supplier", "nation"]))
    if key not in _STORED:
        txns = flows(spark, sf_dir)
        promoted = promote(parties(spark, sf_dir), txns)
        edges = cut(rollup_edges(txns, promoted.filter("is_traversable").select("id")), "edges")
        entities = cut(with_totals(promoted, edges).repartitionByRange("id").sortWithinPartitions("id"), "entities")
        by = lambda c: cut(edges.repartitionByRange(c, "edge_id").sortWithinPartitions(c), f"edges-{c}")
        name = lambda side: entities.select(F.col("id").alias(f"{side}_id"), F.col("name").alias(f"raw_{side}_name"), *([F.col("city")] if side == "from" else []))
        named = txns.join(name("from"), "from_id").join(name("to"), "to_id")
        _STORED[key] = Stored(entities, by("to_id"), by("from_id"), cut(named.repartitionByRange("to_id", "id").sortWithinPartitions("to_id"), "transactions"))
        release(edges)
    return _STORED[key]


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows between the parties' nations, self-loops among them."""
    txns, who = flows(spark, sf_dir), parties(spark, sf_dir).select("id", "city")
    rows = txns.join(who.withColumnsRenamed({"id": "from_id", "city": "f"}), "from_id").join(who.withColumnsRenamed({"id": "to_id", "city": "t"}), "to_id")
    rows = rows.select(F.col("f").alias("from_id"), F.col("t").alias("to_id"), "amount", "day")
    return rollup_edges(rows, rows.select(F.col("to_id").alias("id")))
