"""The ledger of an entity: one row a counterparty or one a transaction, filtered, sorted and paged, with totals of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import SIMILAR, normalize_name, word_similarity
from ..plans.params import LedgerParams


def _needle(q: str) -> Column:
    return normalize_name(F.lit(q))


def sources(entities: DataFrame, edges: DataFrame, entity: str, p: LedgerParams, edges_from: DataFrame | None = None) -> DataFrame:
    """Counterparties from the edges (``edges_from``: the same in order of from_id, if stored so too). A self-loop is there once for each side asked for. A needle that normalizes to nothing filters nothing."""
    flows = {"in": [("to_id", "from_id", "in")], "out": [("from_id", "to_id", "out")], "all": [("to_id", "from_id", "in"), ("from_id", "to_id", "out")]}[p.direction]
    base = None
    for mine, other, flow in flows:
        side = (edges_from if edges_from is not None and flow == "out" else edges).filter(F.col(mine) == entity).select(F.col(other).alias("entity_id"), F.col("total_amount").alias("amount"), "txn_count", "first_date", "last_date", F.lit(flow).alias("flow"))
        base = side if base is None else base.unionByName(side)
    rows = base.join(entities.select(F.col("id").alias("entity_id"), "name", "normalized_name", "kind", "committee_type"), "entity_id")
    if p.min_amount is not None:
        rows = rows.filter(F.col("amount") >= F.lit(p.min_amount))
    if p.q:
        n = _needle(p.q)
        rows = rows.filter((n == "") | F.contains(F.col("normalized_name"), n) | (word_similarity(F.col("normalized_name"), n) >= SIMILAR))
    return rows.withColumn("is_self", F.col("entity_id") == entity).drop("normalized_name")


def transactions(txns: DataFrame, sources_table: DataFrame, entity: str, p: LedgerParams) -> DataFrame:
    """Line items. A self-loop is there once, as money in. The needle is sought in the upper-cased name as filed."""
    to, frm = F.col("to_id") == entity, F.col("from_id") == entity
    side = {"in": to, "out": frm, "all": to | frm}[p.direction]
    rows = txns.filter(side).select(
        "id", F.when(to, F.col("from_id")).otherwise(F.col("to_id")).alias("counterparty_id"), F.when(to, F.col("raw_from_name")).otherwise(F.col("raw_to_name")).alias("counterparty_name"),
        "amount", "txn_date", F.when(to, "in").otherwise("out").alias("flow"), "txn_type_code", "description", "city", "state_code", "occupation", "source_id",
    )
    if p.min_amount is not None:
        rows = rows.filter(F.col("amount") >= F.lit(p.min_amount))
    if p.q:
        n = _needle(p.q)
        rows = rows.filter((n == "") | F.contains(F.upper("counterparty_name"), n))
    return rows.join(sources_table.select(F.col("id").alias("source_id"), F.col("key").alias("source_key")), "source_id", "left").drop("source_id")


def page(rows: DataFrame, p: LedgerParams) -> DataFrame:
    """Sorted and cut. Days without a value come last either way; ids break all ties, so pages neither repeat nor miss rows."""
    by_source = p.view == "sources"
    name, day = ("name", "last_date") if by_source else ("counterparty_name", "txn_date")
    key = {"name": name, "date": day, "count": "txn_count" if by_source else "amount", "amount": "amount"}[p.sort]
    first = F.desc_nulls_last(key) if p.order == "desc" else F.asc_nulls_last(key)
    return rows.orderBy(first, *(["entity_id", "flow"] if by_source else ["id"])).offset(p.offset).limit(p.limit)


def totals(rows: DataFrame) -> DataFrame:
    """Count and sum over all filtered rows, not just the page."""
    return rows.agg(F.count("*").cast("int").alias("total"), F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(26,2)").cast("string").alias("total_amount"))


#: Rows that an export holds at most.
EXPORT_ROWS = 20_000


def export_csv(rows: DataFrame, path: str, most: int = EXPORT_ROWS) -> None:
    """One file of at most ``most`` rows in the order of ``rows``: every cell quoted, quotes doubled, one header. The view's columns stay in order."""
    cells = rows.limit(most).select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    cells.coalesce(1).write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")
