"""What a source of filings has to offer, and how any such source is loaded."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_name
from ..functions.text import directed_ends
from ..operators.load import insert_if_absent
from ..schemas import RAW_TRANSACTION, conform, digest_id


@runtime_checkable
class Adapter(Protocol):
    """A source: its key and name, and its filings as canonical rows (``schemas.RAW_TRANSACTION``); absent columns are null."""

    key: str
    name: str

    def rows(self, spark: SparkSession) -> DataFrame: ...


def load(spark: SparkSession, adapter: Adapter, known: DataFrame | None = None) -> DataFrame:
    """New transactions of a source: id, from_id, to_id, amount, day, direction, source_id. Rows without a name or an amount are left out;
    ``known`` (id) are skipped. Parties are identified by their normal form."""
    raw = conform(adapter.rows(spark), RAW_TRANSACTION)
    filer, other = normalize_name(F.col("filer_raw")), normalize_name(F.col("counterparty_raw"))
    frm, to = directed_ends(digest_id(F.col("_f")), digest_id(F.col("_c")), F.col("direction"))
    rows = raw.withColumns({"_f": filer, "_c": other}).filter("_f <> '' AND _c <> '' AND amount IS NOT NULL").select(
        F.coalesce("row_hash", digest_id(F.lit(adapter.key), F.col("_f"), F.col("_c"), F.col("amount"), F.col("date"))).alias("id"), frm.alias("from_id"), to.alias("to_id"), "amount", F.col("date").alias("day"), "direction",
        F.lit(adapter.key).alias("source_id"),
    )
    return insert_if_absent(known, rows, "id", ["from_id", "to_id", "amount"])
